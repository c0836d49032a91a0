"""Operators on literal rows: thresholds, ties, quirks and properties."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import cite
from scriptorium.functions.split import recursive_split
from scriptorium.functions.text import normalize_title, surname
from scriptorium.operators import context, enrich, filters, listing, mutate, records, resolve, scoring, search, stats
from scriptorium.schema import FIELD_TYPES, METADATA, RECORD_FIELDS

FIELDS = ["title", "author", "year", "journal", "publisher", "publisher_location", "volume", "issue", "pages", "doi", "type"]
LIBRARY = "id STRING, doc_id BIGINT, added_at TIMESTAMP_NTZ, source STRING, language STRING, " + ", ".join(
    f"{n} {FIELD_TYPES[n].simpleString()}" for n in FIELDS
)


def library(spark, *rows):
    from datetime import datetime

    names = [c.split()[0] for c in LIBRARY.split(", ")]
    filled = [
        {"id": f"d{i}", "doc_id": i, "added_at": datetime(2024, 1, 1 + i), **row} for i, row in enumerate(rows)
    ]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], LIBRARY)


def ids(df):
    return [r.id for r in df.orderBy("id").collect()]


# --- filters ----------------------------------------------------------------------------------


def test_filters_reject_missing_fields(spark):
    lib = library(
        spark, {"author": ["Ada X"], "year": 2000}, {"author": [], "year": 0}, {"journal": "SRC a"}, {"source": "src b", "year": 2010}
    )
    assert ids(lib.filter(filters.author_contains("ADA"))) == ["d0"]
    assert ids(lib.filter(filters.year_between(2000, None))) == ["d0", "d3"]
    assert ids(lib.filter(filters.year_between(None, "2000"))) == ["d0"]
    assert ids(lib.filter(filters.source_contains("Src"))) == ["d2", "d3"]
    assert ids(lib.filter(filters.search_filter({"author": "", "year_min": None}))) == ["d0", "d1", "d2", "d3"]
    assert ids(lib.filter(filters.search_filter({"document_id": "d1"}))) == ["d1"]
    assert ids(lib.filter(filters.exact_filter({"year": "2000"}))) == ["d0"]


def test_metadata_search_lists_each_document_once_unless_asked(spark):
    lib = library(spark, {"title": "t", "author": ["Nox"], "journal": "Nox J"}, {"title": "nox", "author": ["Nox"]})
    assert ids(filters.metadata_search(lib, "NOX")) == ["d0", "d1"]
    assert ids(filters.metadata_search(lib, "nox", dup_quirk=True)) == ["d0", "d0", "d1"]


def test_source_flags():
    assert filters.enabled_sources({"use_crossref": True, "openlib": True, "use_k10plus": False}) == ["crossref", "openlib"]


def test_lookup_gives_empty_values_for_unknown_ids(spark):
    wanted = spark.createDataFrame([("d0",), ("zz",)], "id STRING")
    rows = {r.id: r for r in filters.lookup(library(spark, {"title": "t"}), wanted).collect()}
    assert (rows["d0"].title, rows["d0"].found) == ("t", True)
    assert (rows["zz"].title, rows["zz"].found) == ("", False)


# --- listing ----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ({}, "Unbekannte Quelle"),
        ({"author": ["A"], "year": 1999, "title": "T", "journal": "J", "publisher": "P"}, "A (1999) T: J"),
        ({"author": ["A", "B"], "publisher": "P"}, "A & B P"),
        ({"author": ["A", "B", "C"], "title": "T"}, "A et al. T"),
    ],
)
def test_source_label(spark, row, want):
    assert library(spark, row).select(listing.source_label().alias("l")).first().l == want


@pytest.mark.parametrize(
    ("by", "want"),
    [("added", ["d2", "d1", "d0"]), ("title", ["d1", "d0", "d2"]), ("author", ["d2", "d0", "d1"]), ("year", ["d0", "d1", "d2"])],
)
def test_list_orders(spark, by, want):
    lib = library(spark, {"title": "B", "author": ["Y"], "year": 2001}, {"title": "A", "year": 1999}, {"author": ["X", "A"]})
    assert [r.id for r in listing.sort_listing(lib, by).collect()] == want


def test_recent_documents_and_status(spark):
    lib = library(spark, *[{"title": str(i)} for i in range(6)])
    assert [r.id for r in listing.recent(lib).collect()] == ["d5", "d4", "d3", "d2"]
    asked = spark.createDataFrame([("d0",), ("d1",), ("d9",)], "id STRING")
    status = listing.document_status(asked, lib.filter("id = 'd0'"), lib).orderBy("id").collect()
    assert [tuple(r) for r in status] == [("d0", "complete", False), ("d1", "complete", True), ("d9", "processing", False)]


# --- citations --------------------------------------------------------------------------------

ARTICLE = {"title": "T", "year": 2001, "journal": "J", "volume": "3", "issue": "4", "pages": "1-9", "doi": "10.1/x"}
BOOK = {"title": "T", "publisher": "P", "publisher_location": "Bonn", "doi": "https://doi.org/10.1/x"}


@pytest.mark.parametrize(
    ("style", "names", "want"),
    [
        ("apa", 1, "Last0, F. G."), ("apa", 2, "Last0, F.G. & Last1, F.G."), ("apa", 3, "Last0, F.G., Last1, F.G., & Last2, F.G."),
        ("mla", 1, "Last0, Fn Gn. "), ("mla", 2, "Last0, Fn Gn, and Fn Gn Last1. "), ("mla", 3, "Last0, Fn Gn, et al. "),
        ("chicago", 3, "Last0, Fn Gn, Fn Gn Last1, and Fn Gn Last2. "), ("chicago", 4, "Last0, Fn Gn, et al. "),
        ("harvard", 3, "Last0, F.G., Last1, F.G. and Last2, F.G."), ("harvard", 4, "Last0, F.G. et al."),
        ("ieee", 2, "F. G. Last0 and F. G. Last1, "), ("ieee", 3, "F. G. Last0, F. G. Last1, and F. G. Last2, "),
    ],
)
def test_author_lists(spark, style, names, want):
    row = {"author": [f"Fn Gn Last{i}" for i in range(names)], "title": "T"}
    got = library(spark, row).select(cite.cite(style).alias("c")).first().c
    assert got.startswith(want.replace("F. G.", "F.G.") if style == "apa" else want)


def test_apa_names_every_author(spark):
    row = {"author": [f"A B{i}" for i in range(25)], "title": "T"}
    got = library(spark, row).select(cite.cite("apa").alias("c")).first().c
    assert ", & B24, A.(n.d.). *T*. " in got
    assert all(f"B{i}, A." in got for i in range(25))


@pytest.mark.parametrize(
    ("style", "article", "book"),
    [
        ("apa", "(2001). T. *J*, 3(4), 1-9. https://doi.org/10.1/x", "(n.d.). *T*. P. https://doi.org/10.1/x"),
        ("mla", '"T." *J*, vol. 3, no. 4, 2001, pp. 1-9. https://doi.org/10.1/x.', "*T*. P, n.d.. https://doi.org/10.1/x."),
        ("chicago", '"T." *J* 3, no. 4 (2001): 1-9. https://doi.org/10.1/x.', "*T*. Bonn: P, n.d.. https://doi.org/10.1/x."),
        ("harvard", "(2001) 'T', *J*, 3(4), pp. 1-9. Verfügbar unter: https://doi.org/10.1/x [Zugriff am: --].",
         "(n.d.) *T*, Bonn: P. Verfügbar unter: https://doi.org/10.1/x [Zugriff am: --]."),
        ("ieee", '"T," *J*, vol. 3, no. 4, pp. 1-9, 2001. DOI: https://doi.org/10.1/x.', '"T," P, n.d.. DOI: https://doi.org/10.1/x.'),
        ("unknown", "(2001). T. *J*, 3(4), 1-9. https://doi.org/10.1/x", "(n.d.). *T*. P. https://doi.org/10.1/x"),
    ],
)
def test_styles(spark, style, article, book):
    got = [r.c for r in library(spark, ARTICLE, BOOK).orderBy("id").select(cite.cite(style).alias("c")).collect()]
    assert got == [article, book]


def test_bare_record_in_every_style(spark):
    row = library(spark, {}).select(*[cite.cite(s).alias(s) for s in cite.STYLES]).first()
    assert row.apa == "(n.d.). *Unbekannter Titel*. "
    assert row.mla == "*Unbekannter Titel*. n.d.."
    assert row.chicago == "*Unbekannter Titel*. n.d.."
    assert row.harvard == "(n.d.) *Unbekannter Titel*, "
    assert row.ieee == '"Unbekannter Titel," n.d..'


def test_inline(spark):
    lib = library(spark, {"author": ["A B"], "year": 1999}, {"author": ["A B", "C"]}, {"author": ["  "]}, {})
    got = lib.orderBy("id").select(cite.inline("apa", F.lit("7")).alias("p"), cite.inline("chicago").alias("n"), cite.inline("ieee").alias("i"))
    assert [tuple(r) for r in got.collect()] == [
        ("(B, 1999, S. 7)", "(B 1999)", "[1]"),
        ("(B et al., n.d., S. 7)", "(B et al. n.d.)", "[1]"),
        ("(Unbekannt, n.d., S. 7)", "(Unbekannt n.d.)", "[1]"),
        ("(Unbekannt, n.d., S. 7)", "(Unbekannt n.d.)", "[1]"),
    ]


# --- search and context -----------------------------------------------------------------------


def chunk_rows(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id BIGINT, chunk_id INT, text STRING")


def test_keyword_search_scores_substrings_and_counts_repeats(spark):
    lib = library(spark, {"title": "a"}, {"title": "b"}, {"title": "c"})
    chunks = chunk_rows(spark, "The cathedral", "a dog", "nothing")
    hits = search.keyword_search(lib, chunks, "CAT dog dog", k=5).collect()
    assert [(h.id, round(h.relevance, 3), h.relevance_pct) for h in hits] == [("d1", 0.667, 67), ("d0", 0.333, 33)]


def test_ties_keep_library_order_and_empty_query_finds_nothing(spark):
    lib = library(spark, {"title": "a"}, {"title": "b"}, {"title": "c"})
    chunks = chunk_rows(spark, "x y", "x", "x")
    assert [h.id for h in search.keyword_search(lib, chunks, "x", k=2).collect()] == ["d0", "d1"]
    assert search.keyword_search(lib, chunks, "   ").count() == 0


def test_year_order_only_rearranges_the_hits(spark):
    lib = library(spark, {"year": 1990}, {}, {"year": 2020})
    hits = search.keyword_search(lib, chunk_rows(spark, "x", "x", "x"), "x", k=2)
    assert [h.id for h in search.sort_hits(hits, "date-desc").collect()] == ["d0", "d1"]
    assert [h.id for h in search.sort_hits(hits, "date-asc").collect()] == ["d1", "d0"]


@pytest.mark.parametrize("mode", ["substring", "word"])
def test_batch_search_equals_single_searches(spark, mode):
    texts = ["the cat sat", "cathedral, of", "of of the", "zzz", "a.cat-the"]
    queries = [(0, "cat the the"), (1, "of"), (2, "a"), (3, "  "), (4, "qq")]
    got = search.batch_search(chunk_rows(spark, *texts), spark.createDataFrame(queries, "query_id BIGINT, query STRING"), k=3, mode=mode)
    want = set()
    for qid, q in queries:
        terms = q.lower().split()
        scored = []
        for i, t in enumerate(texts):
            pool = t if mode == "substring" else t.split()
            n = sum(w in pool for w in terms)
            if n:
                scored.append((-n / len(terms), i))
        want |= {(qid, i, round(-s, 9), r + 1) for r, (s, i) in enumerate(sorted(scored)[:3])}
    assert {(r.query_id, r.doc_id, round(r.relevance, 9), r["rank"]) for r in got.collect()} == want


def test_prompt_without_hits(spark):
    lib, chunks = library(spark, {"title": "a"}), chunk_rows(spark, "x")
    row = context.prompt(context.question_context(lib, chunks, "zzz"), "zzz").first()
    assert (row.n_sources, row.prompt, row.answer) == (0, None, context.NO_HITS)


def test_prompt_cuts_long_texts_and_authors(spark):
    lib = library(spark, {"title": "T", "author": list("ABCD"), "year": 1999}, {})
    chunks = chunk_rows(spark, "x" * 1001, "x short")
    text = context.prompt(context.question_context(lib, chunks, "x"), "x?").first().prompt
    assert f"[1] A, B, C et al. (1999): T\n{'x' * 997}...\n" in text
    assert "[2] Unbekannt (n.d.): Unbekanntes Dokument\nx short\n" in text
    assert text.endswith("\n### Frage:\nx?\n\n### Antwort:\n")


# --- changes ----------------------------------------------------------------------------------


def test_upsert_keeps_and_repeats(spark):
    schema = "id STRING, filename STRING, title STRING, added_at INT, updated_at INT"
    stored = spark.createDataFrame([("a", "a.txt", "A", 1, 1), ("b", "b.txt", "B", 1, 1)], schema)
    incoming = spark.createDataFrame([("b", "x.txt", "B2"), ("c", "c.txt", "C")], "id STRING, filename STRING, title STRING")
    once = mutate.upsert(stored, incoming, F.lit(9))
    want = [("a", "a.txt", "A", 1, 1), ("b", "b.txt", "B2", 1, 9), ("c", "c.txt", "C", 9, 9)]
    assert [tuple(r) for r in once.orderBy("id").collect()] == want
    assert [tuple(r) for r in mutate.upsert(once, incoming, F.lit(9)).orderBy("id").collect()] == want


def test_patch_takes_filled_fields_of_known_rows(spark):
    lib = library(spark, {"title": "A", "author": ["X"], "year": 1990}, {"title": "B"})
    forms = spark.createDataFrame(
        [("d0", "", "P Q , R", "2001"), ("d1", "B2", None, "20xx"), ("zz", "Z", None, None)],
        "id STRING, title STRING, authors STRING, year STRING",
    )
    got = mutate.patch(lib, mutate.form_patch(forms)).orderBy("id").select("id", "title", "author", "year").collect()
    assert [tuple(r) for r in got] == [("d0", "A", ["P Q", "R"], 2001), ("d1", "B2", None, None)]


def test_delete_then_recover(spark):
    lib = library(spark, {"title": "A"}, {"title": "B"})
    gone = spark.createDataFrame([("d0",), ("zz",)], "id STRING")
    left = mutate.delete({"library": lib}, gone)["library"]
    assert ids(left) == ["d1"]
    back = mutate.recover(left, lib).orderBy("id").select("id", "recovered").collect()
    assert [tuple(r) for r in back] == [("d0", True), ("d1", False)]


def test_review_drops_failed_uploads(spark):
    staged = spark.createDataFrame([("a", "T", "extracted"), ("b", "U", "failed")], "id STRING, title STRING, status STRING")
    confirmed = spark.createDataFrame([("a", "T2"), ("b", "U2")], "id STRING, title STRING")
    assert [tuple(r) for r in mutate.apply_review(staged, confirmed).select("id", "title").collect()] == [("a", "T2")]


# --- catalogue --------------------------------------------------------------------------------


def parsed(spark, source, *lines):
    frame = spark.createDataFrame([(line,) for line in lines], "raw STRING")
    return frame.select(F.from_json("raw", records.SCHEMAS[source]).alias("r")).select("r.*")


@pytest.mark.parametrize("source", ["crossref", "openalex", "googlebooks", "openlib"])
def test_sparse_and_empty_records(spark, source):
    lines = ['{"title": "T"}', "{}", '{"title": null, "author": [], "authorships": [], "volumeInfo": {}, "ISSN": []}']
    if source == "crossref":
        lines[0] = '{"title": ["T"]}'
    if source == "googlebooks":
        lines[0] = '{"volumeInfo": {"title": "T"}}'
    got = records.NORMALIZERS[source](parsed(spark, source, *lines)).collect()
    assert got[0].title == "T"
    for name in RECORD_FIELDS:
        if name not in ("title", "keywords"):
            assert all(r[name] is None for r in got), name


def test_open_access_record_without_place(spark):
    line = '{"title": "T", "primary_location": {"source": null}, "abstract_inverted_index": {"b": [2], "a": [0, 1], "c": [5]}}'
    row = records.from_openalex(parsed(spark, "openalex", line)).first()
    assert (row.journal, row.abstract) == (None, "a a b   c")


def test_books_isbn_and_subtitle(spark):
    line = (
        '{"volumeInfo": {"title": "T", "subtitle": "S", "publishedDate": "2001-05", "industryIdentifiers": '
        '[{"type": "ISBN_10", "identifier": "1"}, {"type": "ISBN_13", "identifier": "2"}, {"type": "ISBN_13", "identifier": "3"}]}}'
    )
    row = records.from_googlebooks(parsed(spark, "googlebooks", line)).first()
    assert (row.title, row.year, row.isbn) == ("T: S", 2001, "2")


def test_marc_file(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<c xmlns:m="http://x"><m:record><m:controlfield tag="008">240101suuuu    xx</m:controlfield>'
        '<m:datafield tag="245"><m:subfield code="a">T</m:subfield><m:subfield code="c">x</m:subfield><m:subfield code="b">U</m:subfield></m:datafield>'
        '<m:datafield tag="700"><m:subfield code="a">B, 1815-1852</m:subfield></m:datafield><m:datafield tag="100"><m:subfield code="a">A</m:subfield></m:datafield>'
        '<m:datafield tag="264"><m:subfield code="b">Verlag,</m:subfield><m:subfield code="c">c1987</m:subfield></m:datafield>'
        '<m:datafield tag="020"><m:subfield code="z">0</m:subfield></m:datafield><m:datafield tag="020"><m:subfield code="a">316148410X (geb.)</m:subfield></m:datafield>'
        '<m:datafield tag="300"><m:subfield code="a">XI, 99 p.</m:subfield></m:datafield></m:record></c>'
    )
    from scriptorium.sources.files import read_marc

    row = records.from_marc(read_marc(spark, str(tmp_path), records.MARC)).first()
    assert (row.title, row.author, row.year, row.publisher) == ("T U", ["A", "B"], 1987, "Verlag")
    assert (row.isbn, row.page_count, row.language) == ("316148410X", 99, None)


def test_broken_marc_records_leave_the_others_alone(spark, tmp_path):
    from scriptorium.sources.files import broken_marc_records, read_marc

    def record(title, start="<record>", end="</record>"):
        return f'{start}<datafield tag="245"><subfield code="a">{title}</subfield></datafield>{end}'

    header = '<?xml version="1.0"?><collection xmlns="http://x">\n'
    unclosed = '<record><datafield tag="245"><subfield code="a">bad</record>'
    (tmp_path / "a.xml").write_text(header + record("one") + unclosed + record("two", '<record type="B">') + record("no end", end="") + record("three") + "</collection>")
    (tmp_path / "b.xml").write_text(header + record("four &amp; ü", "<m:record>", "</m:record>") + "\n" + record("cut short", '<record type="B">', ""))
    (tmp_path / "c.xml").write_text("")
    (tmp_path / "d.xml").write_text(header + "</collection>")
    titles = {r.title for r in records.from_marc(read_marc(spark, str(tmp_path), records.MARC)).collect()}
    assert titles == {"one", "two", "three", "four & ü"}
    broken = [r.record for r in broken_marc_records(spark, str(tmp_path), records.MARC).collect()]
    assert sorted(w for b in broken for w in ("bad", "no end", "cut short") if w in b) == ["bad", "cut short", "no end"] and len(broken) == 3


def test_list_caps_of_normalisers_are_arguments(spark):
    subjects = [f"s{i}" for i in range(9)]
    rows = spark.createDataFrame([(subjects,)], "subject ARRAY<STRING>")
    missing = {n: F.lit(None).cast(t) for n, t in (f.split(" ", 1) for f in records.OPENLIB.split(", ")) if n != "subject"}
    rows = rows.withColumns(missing)
    assert [len(records.from_openlib(rows, most=m).first().keywords) for m in (2, None)] == [2, 9]
    assert len(records.from_openlib(rows).first().keywords) == 5
    concepts = spark.createDataFrame([([(s,) for s in subjects],)], "concepts ARRAY<STRUCT<display_name: STRING>>")
    work = spark.createDataFrame([], records.OPENALEX).unionByName(concepts, allowMissingColumns=True)
    assert records.from_openalex(work, most=None).first().keywords == subjects


CATALOGUE = "source STRING, rank INT, record_id STRING, " + ", ".join(
    f"{n} {FIELD_TYPES[n].simpleString()}" for n in RECORD_FIELDS
)


def catalogue(spark, *rows):
    names = [c.split()[0] for c in CATALOGUE.split(", ")]
    filled = [{"source": "crossref", "rank": 1, "record_id": f"r{i}", **row} for i, row in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], CATALOGUE)


def test_title_resolution_prefers_score_then_rank(spark):
    lib = library(spark, {"title": "A Theory of Rare Things", "author": ["Ada Lovelace"]}, {"title": "A Theory of Rare Things"}, {"title": ""})
    cat = catalogue(
        spark,
        {"title": "A theory of rare things", "author": ["Augusta Lovelace"], "year": 1900, "rank": 2},
        {"title": "A theory of rare things", "author": ["Augusta Lovelace"], "year": 1900, "rank": 1},
        {"title": "A theory of rare things", "author": ["Other"], "year": 1, "publisher": "P"},
        {"title": "Unrelated words here", "author": ["Ada Lovelace"]},
    )
    got = {r.doc_id: (r.record_id, r.score) for r in resolve.by_title(lib, cat).select("doc_id", "record.record_id", "score").collect()}
    assert got == {0: ("r1", 85.0), 1: ("r2", 60.0)}


@pytest.mark.parametrize("overlap", [0.5, 0.6, 0.8])
def test_similar_titles_match_brute_force(spark, overlap):
    import itertools
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["the"] * 30
    titles = sorted({" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)})
    left, right = titles[:150], titles[150:]
    want = set()
    for a, b in itertools.product(left, right):
        x, y = set(a.split()), set(b.split())
        if len(x & y) >= overlap * len(x | y) - 1e-9:
            want.add((a, b))
    frames = [spark.createDataFrame([(t,) for t in side], "title_lower STRING") for side in (left, right)]
    got = resolve.similar_titles(*frames, overlap).collect()
    assert len(got) == len(set(got)) == len(want) > 5
    assert {tuple(r) for r in got} == want


def test_a_title_that_holds_the_asked_one_is_found(spark):
    lib = library(spark, {"title": "Quantum Chemistry", "author": ["Ada Lovelace"]})
    cat = catalogue(
        spark,
        {"title": "Quantum Chemistry of Large Molecules", "author": ["Augusta Lovelace"], "year": 1900},
        {"title": "Quantum of Chemistry and Large Molecules Everywhere", "author": ["Augusta Lovelace"]},
        {"title": "A Quantum Chemistry of Very Many Large Molecules", "author": ["Other"]},
    )
    assert [r.record_id for r in resolve.by_title(lib, cat).select("record.record_id").collect()] == ["r0"]


def test_a_title_that_stands_in_the_asked_one_is_found(spark):
    long = "Quantum Chemistry of Large Molecules " + "and of very many others " * 500
    lib = library(
        spark, {"title": "Quantum Chemistry of Large Molecules", "author": ["Ada Lovelace"]}, {"title": long, "author": ["Ada Lovelace"]},
        {"title": "Chemistry of Quantum Effects", "author": ["Ada Lovelace"]},
    )
    cat = catalogue(spark, {"title": "Quantum Chemistry", "author": ["Augusta Lovelace"], "year": 1900}, {"title": "Quantum Chemistry", "author": ["Other"]})
    found = resolve.by_title(lib, cat).select("doc_id", "record.record_id").collect()
    assert sorted(tuple(r) for r in found) == [(0, "r0"), (1, "r0")]


def test_phrases_match_brute_force(spark):
    import itertools
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)] + ["the"] * 20
    titles = sorted({" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 8, 60]))) for _ in range(200)})
    left, right = [(t, rng.choice("xy")) for t in titles[::2]], [(t, rng.choice("xy")) for t in titles[1::2]]
    want = {(a, b) for (a, n), (b, m) in itertools.product(left, right) if n == m and (f" {a} " in f" {b} " or f" {b} " in f" {a} ")}
    frames = [spark.createDataFrame(side, "title_lower STRING, name_key STRING") for side in (left, right)]
    got = [tuple(r) for r in resolve.containing_titles(*frames).collect()]
    assert len(got) == len(want) > 5 and set(got) == want


ASKED = "doc_id INT, title STRING, author ARRAY<STRING>"


@pytest.mark.parametrize("similarity", ["levenshtein", "ratio"])
def test_best_records_match_brute_force(spark, similarity):
    """Phrases in titles of every length, with and without authors, at all services."""
    import random

    rng = random.Random(11)
    authors = [None, [], ["Ada Lovelace"], ["Max Born", "Ada Lovelace"], ["A. Born"], ["Plato"], ["Lise Meitner", "Plato"]]
    words = ["in", "of", "quantum", "chemistry", "zur", "Theorie", "ab", "x"]
    titles = [rng.choice([" ", " ", "-", ": "]).join(rng.choices(words, k=rng.choice([1, 1, 2, 3, 5, 9]))) + rng.choice(["", "", "!", " (Nachdruck)"]) for _ in range(260)]
    lib = spark.createDataFrame([(i, t, rng.choice(authors)) for i, t in enumerate(titles[:60])], ASKED)
    fields = {"year": 1900, "journal": "J", "publisher": "P", "doi": "10.1/x", "isbn": "1", "keywords": ["k"]}
    rows = [{"title": t, "source": s, "author": rng.choice(authors), "rank": rng.randint(1, 3)} for t in titles[60:] for s in rng.sample(scoring.SOURCE_ORDER, 2)]
    cat = catalogue(spark, *[{**r, **{n: v for n, v in fields.items() if rng.random() < 0.3}} for r in rows])
    found = resolve.by_title(lib, cat, similarity=similarity).select("doc_id", "source", "record.record_id", "score")

    own, r = lib.select("doc_id", F.col("title").alias("t"), F.col("author").alias("a")), cat.withColumn("record", F.struct("*"))
    x, y = (F.array_distinct(F.split(F.lower(normalize_title(F.col(c))), " ")) for c in ("t", "title"))
    shared = F.size(F.array_intersect(x, y))
    phrase = [F.concat(F.lit(" "), F.lower(normalize_title(F.col(c))), F.lit(" ")) for c in ("t", "title")]
    fits = (shared >= 0.6 * (F.size(x) + F.size(y) - shared) - 1e-9) | F.contains(*phrase) | F.contains(*phrase[::-1])
    first = F.get("a", F.lit(0))
    same = F.when(F.col("source") == "googlebooks", F.exists("author", lambda n: F.lower(n) == F.lower(first)))
    named = same.otherwise(F.exists("author", lambda n: F.lower(surname(n)) == F.lower(surname(first))))
    score = scoring.candidate_score(F.col("source"), F.col, F.col("t"), F.col("a"), similarity).alias("score")
    kept = own.crossJoin(r).filter(fits & (F.coalesce(F.size("a") <= 0, F.lit(True)) | F.coalesce(named, F.lit(False))))
    best = F.min_by(F.struct("record_id", "score"), F.struct(-F.col("score"), "rank", "record_id")).alias("best")
    want = kept.select("doc_id", "source", "rank", "record_id", score).groupBy("doc_id", "source").agg(best).select("doc_id", "source", "best.*").filter("score > 10")
    got, wanted = ({(r.doc_id, r.source): (r.record_id, round(r.score, 6)) for r in df.collect()} for df in (found, want))
    assert len(wanted) > 100 and got == wanted


def test_phrases_that_cannot_win_are_not_paired(spark):
    """A title of one word used to be paired with every title that holds it, and each pair with all names and records."""
    from scriptorium import session

    def record(title, source):
        return {"title": title, "author": ["Ada Lovelace"], "source": source, "year": 1900}

    long = [f"chemistry of the {a} and {b} bodies in all their many known forms" for a in "abcdefghij" for b in "klmnopqrst"]
    lib = spark.createDataFrame([(i, t, ["Ada Lovelace"]) for i, t in enumerate(["Chemistry", *long])], ASKED)
    cat = catalogue(spark, *[record(t, s) for s in ("crossref", "openalex") for t in ["Chemistry", *(t.upper() for t in long)]])
    made = len(session.FOLDERS)
    found = resolve.by_title(lib, cat).select("doc_id", "record.title", "score").collect()
    assert len(found) == 2 * 101 and all(r.score == 85 for r in found)
    pairs = sum(spark.read.parquet(f).count() for f in session.FOLDERS[made:] if "/title-pairs-" in f)
    # Every title and itself, and the long ones that share all words but one.
    assert pairs == sum(len(set(a.split()) & set(b.split())) >= 0.6 * len(set(a.split()) | set(b.split())) for a in long for b in long) + 1


def test_names_that_no_record_has_are_not_asked_under(spark):
    """Titles of unknown authors used to be paired with all similar titles before a name was looked at."""
    from scriptorium import session

    lib = spark.createDataFrame([(i, "Quantum Chemistry", ["Nobody Known" if i else "Ada Lovelace"]) for i in range(2)], ASKED)
    lib = lib.unionByName(spark.createDataFrame([(2, "Chemistry of Quantum", ["Nobody Known"])], ASKED))
    cat = catalogue(spark, {"title": "Quantum Chemistry", "author": ["Augusta Lovelace"]})
    made = len(session.FOLDERS)
    assert [r.doc_id for r in resolve.by_title(lib, cat).collect()] == [0]
    assert sum(spark.read.parquet(f).count() for f in session.FOLDERS[made:] if "/title-pairs-" in f) == 1


def test_title_join_carries_numbers(spark):
    """Titles and records used to travel through the join of askers and answers, some hundred bytes a pair."""
    titles = [(f"r{i}", t) for i, t in enumerate(("A Plain Title", "A Plain Title (Nachdruck)", "Something Else"))]
    cat = spark.createDataFrame(titles, "record_id STRING, title STRING").select(
        F.lit("crossref").alias("source"), F.lit(1).alias("rank"), "record_id", "title", F.array(F.lit("Ada Lovelace")).alias("author"),
        *[F.lit(None).cast(FIELD_TYPES[n]).alias(n) for n in RECORD_FIELDS if n not in ("title", "author")],
    )
    lib = spark.createDataFrame([(1, "A Plain Title", ["Ada Lovelace"]), (2, "a plain title", ["Ada Lovelace"]), (3, "Plain", None)], "doc_id INT, title STRING, author ARRAY<STRING>")
    found = resolve.by_title(lib, cat)
    assert {(r.doc_id, r.record.record_id) for r in found.collect()} >= {(1, "r0"), (2, "r0")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "[left_title" not in plan and "right_title" not in plan


def test_one_title_shared_by_many_rows_meets_once(spark):
    """A third of all rows with one title stay one row in the title join, and every document gets its record."""
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 1000, "The One Title Everyone Uses").otherwise(F.concat(F.lit("Work number "), "id")).alias("title"),
        F.array(F.lit("Ada Lovelace")).alias("author"),
    )
    cat = spark.range(3000).select(
        F.lit("crossref").alias("source"), F.lit(1).alias("rank"), F.concat(F.lit("r"), "id").alias("record_id"),
        F.when(F.col("id") < 1000, "The One Title Everyone Uses").otherwise(F.concat(F.lit("Work number "), "id")).alias("title"),
        F.array(F.lit("Ada Lovelace")).alias("author"),
        *[F.lit(None).cast(FIELD_TYPES[n]).alias(n) for n in RECORD_FIELDS if n not in ("title", "author")],
    )
    found = resolve.by_title(docs, cat)
    assert found.count() == found.select("doc_id").distinct().count() == 3000
    assert found.filter("doc_id < 1000").select("record.record_id").distinct().count() == 1


@pytest.mark.parametrize(
    ("name", "bonus"), [("crossref", 20.0), ("openalex", 20.0), ("googlebooks", 20.0), ("openlib", 20.0), ("k10plus", 20.0)]
)
def test_full_records_get_the_full_bonus(spark, name, bonus):
    row = {
        "title": "T", "year": 1, "publisher": "p", "journal": "j", "doi": "d", "isbn": "i", "issn": "s", "page_count": 1,
        "language": "en", "keywords": ["k"], "cited_by_count": 1,
    }
    cat = catalogue(spark, row)
    got = cat.select(scoring.candidate_bonus(F.lit(name), F.col).alias("c"), scoring.metadata_bonus(F.lit(name), F.col).alias("m"))
    assert tuple(got.first()) == (bonus, bonus)


def _enriched(spark, lib, *matches):
    cat = catalogue(spark, *matches)
    found = cat.select(F.lit(0).cast("bigint").alias("doc_id"), "source", F.struct("rank", "record_id", *RECORD_FIELDS).alias("record"))
    return enrich.enrich(lib, enrich.per_source(lib, found)).first()


def test_weak_match_gives_only_trusted_fields(spark):
    lib = library(spark, {"title": "Alpha Beta", "author": ["Ada Lovelace"]}).select("doc_id", "title", "author")
    row = _enriched(spark, lib, {"title": "Zzzz", "author": ["Q"], "year": 1999, "publisher": "P", "abstract": "no"})
    assert (row.title, row.year, row.publisher, row.abstract, row.enriched_by) == ("Alpha Beta", 1999, "P", None, "crossref")


def test_gate_needs_more_fields(spark):
    lib = library(spark, {"title": "Alpha Beta", "author": ["Ada Lovelace"]}).select("doc_id", "title", "author")
    row = _enriched(spark, lib, {"title": "alpha beta", "author": ["Ada Lovelace"]})
    assert (row.title, row.enriched_by) == ("Alpha Beta", None)


def test_no_match_changes_nothing(spark):
    lib = library(spark, {"title": "Alpha"}, {"title": "Beta"}).select("doc_id", "title", "author")
    cat = catalogue(spark, {"title": "x"}).limit(0)
    found = cat.select(F.lit(0).cast("bigint").alias("doc_id"), "source", F.struct("rank", "record_id", *RECORD_FIELDS).alias("record"))
    rows = enrich.enrich(lib, enrich.per_source(lib, found)).collect()
    assert len(rows) == 2 and all(r.enriched_by is None for r in rows)


# --- statistics -------------------------------------------------------------------------------


def test_histograms_as_maps(spark):
    lib = library(spark, {"year": 2000, "language": "de"}, {"year": 2000}, {"language": "de"}).withColumn("filename", F.lit("a.PDF"))
    got = {r.facet: r.counts for r in stats.histogram_maps(lib).collect()}
    assert got == {"file_type": {".pdf": 3}, "year": {"2000": 2}, "language": {"de": 2}}


def test_metadata_schema_is_complete():
    assert set(RECORD_FIELDS) <= set(METADATA.fieldNames())


# --- splitter ---------------------------------------------------------------------------------


def plain_split(text, size, overlap, separators=("\n\n", "\n", ".", " ", "")):
    """The cut by its definition: first separator that occurs, long pieces by finer ones, short ones packed greedily."""
    separator = next(s for s in separators if s in text)
    finer = separators[separators.index(separator) + 1 :]
    if not separator:
        step = size - overlap
        starts = range(0, max(len(text) - overlap, 1), step) if len(text) > size else [0]
        return [text[i : i + size].strip() for i in starts if text[i : i + size].strip()]
    pieces = [p if i == 0 else separator + p for i, p in enumerate(text.split(separator))]
    chunks, held = [], []
    for piece in [p for p in pieces if p]:
        if len(piece) >= size:
            chunks += ["".join(held), *plain_split(piece, size, overlap, finer)]
            held = []
            continue
        if held and len("".join(held) + piece) > size:
            chunks.append("".join(held))
            while held and (len("".join(held)) > overlap or len("".join(held) + piece) > size):
                held = held[1:]
        held = [*held, piece]
    return [c.strip() for c in [*chunks, "".join(held)] if c.strip()]


def split_texts(spark, texts, size, overlap):
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    got = rows.select("i", recursive_split(F.col("text"), size, overlap).alias("chunks")).collect()
    return [r.chunks for r in sorted(got, key=lambda r: r.i)]


def made_up_texts(alphabet, n, longest, seed):
    import random

    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("size", "overlap"), [(5, 0), (20, 4), (50, 10), (60, 59)])
def test_splitter_equals_its_definition(spark, size, overlap):
    texts = made_up_texts(["a", "bb", ".", " ", "\n", "\n\n", "\u00fc", "\U0001f600", "\u00a0", "word" * 20], 150, 120, size)
    assert split_texts(spark, texts, size, overlap) == [plain_split(t, size, overlap) if t else [] for t in texts]


def test_splitter_covers_the_text(spark):
    texts = made_up_texts("aab .\n", 100, 400, 3)
    # Letters become distinct characters, so that every chunk has one place in the text.
    texts = ["".join(chr(0x4E00 + i) if c in "ab" else c for i, c in enumerate(t)) for t in texts]
    for text, chunks in zip(texts, split_texts(spark, texts, 20, 4), strict=True):
        assert all(0 < len(c) <= 20 and c == c.strip() for c in chunks)
        covered = 0
        for c in chunks:
            letters = [ch for ch in c if ch >= "\u4e00"]
            if not letters:
                continue
            start = text.index(letters[0])
            assert not any(ch >= "\u4e00" for ch in text[covered:start])
            assert covered - start <= 4
            covered = text.index(letters[-1]) + 1
        assert not any(ch >= "\u4e00" for ch in text[covered:])


def test_splitter_prefers_coarse_separators(spark):
    text = "".join(chr(0x4E00 + i) for i in range(25))
    coarse, anywhere = "aaaa\n\nbbbb\n\ncccc", [text[:10], text[7:17], text[14:24], text[21:]]
    assert split_texts(spark, [coarse, None, "", " \n"], 10, 0) == [["aaaa\n\nbbbb", "cccc"], [], [], []]
    assert split_texts(spark, [text], 10, 3) == [anywhere]


def test_splitter_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "x")], "id INT, text STRING")
    plan = docs.select(recursive_split(F.col("text")).alias("c"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


# --- processing -------------------------------------------------------------------------------


def test_process_and_reprocess(spark):
    from scriptorium.operators.processing import process, reprocess

    docs = spark.createDataFrame(
        [("a", "Lovelace_x.txt", "On Rare Things\nby Ada Lovelace\n" + "the of and " * 200), ("b", "b.txt", "12")],
        "id STRING, filename STRING, text STRING",
    )
    cat = catalogue(spark, {"title": "On Rare Things", "author": ["Ada Lovelace"], "year": 1843, "publisher": "P"})
    override = spark.createDataFrame([("a", "On rare things")], "id STRING, title STRING")
    done = process(docs, cat, override)
    row = done.library.filter("id = 'a'").first()
    assert (row.title, row.author, row.year, row.publisher, row.enriched_by) == ("On Rare Things", ["Ada Lovelace"], 1843, "P", "crossref")
    assert row.chunks_count == done.chunks.filter("id = 'a'").count() == 4
    assert done.library.filter("id = 'b'").first().chunks_count == 1
    again = reprocess(docs, spark.createDataFrame([("b",), ("zz",)], "id STRING"))
    assert [r.id for r in again.library.collect()] == ["b"]
