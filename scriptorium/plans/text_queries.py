"""Cleaning, extraction, similarity and small string functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import extract as ex
from scriptorium.functions import fixed_values as v
from scriptorium.functions import similarity as sim
from scriptorium.functions import text as tx
from scriptorium.plans import fixtures as fx
from scriptorium.plans import fixture_sql as sql
from scriptorium.plans.registry import ORACLES, query

LIB = sql.with_views(sql.LIBRARY)
PAPERS = sql.with_views(sql.PAPERS)
BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {BLANKS})), lambda x: x <> '')"


def re2(pattern: str) -> str:
    """A pattern as an SQL literal for the oracle: Unicode words spelled out, quotes doubled."""
    return "'" + pattern.replace(r"\w", r"\p{L}\p{N}_").replace("'", "''") + "'"


def one_byte(expression: str) -> str:
    """The oracle's edit distance counts bytes; give the tables' accented letters one byte each."""
    letters = "äçèéêíñóöüß"
    marks = " || ".join(f"chr({i + 1})" for i in range(len(letters)))
    return f"translate(lower({expression}), '{letters}', {marks})"


def similarity_sql(a: str, b: str) -> str:
    x, y = f"trim({one_byte(a)})", f"trim({one_byte(b)})"
    return f"""(CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN 0.0::DOUBLE WHEN {x} = {y} THEN 1.0::DOUBLE
 ELSE 1.0::DOUBLE - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END)"""


# --- cleaning ---------------------------------------------------------------------------------


@query(
    "clean_text",
    f"""SELECT doc_id, length(c) AS clean_chars, md5(c) AS clean_md5 FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(
 regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '(?m)^\\s+|\\s+$', '', 'g'), {BLANKS}) AS c FROM documents)""",
)
def _(spark, sf):
    cleaned = fx.table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.length("c").cast("bigint").alias("clean_chars"), F.md5("c").alias("clean_md5"))


@query(
    "clean_paragraphs",
    f"""SELECT doc_id, length(c) AS clean_chars, md5(c) AS clean_md5 FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(
 regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '(?m)^[ \\t\\r]+|[ \\t\\r]+$', '', 'g'), {BLANKS}) AS c FROM documents)""",
)
def _(spark, sf):
    cleaned = fx.table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text"), "paragraphs").alias("c"))
    return cleaned.select("doc_id", F.length("c").cast("bigint").alias("clean_chars"), F.md5("c").alias("clean_md5"))


# --- extraction -------------------------------------------------------------------------------

_TOP = "array_to_string(l[1:10], chr(10))"
_MATCHED = ", ".join(f"nullif(trim(regexp_extract({_TOP}, {re2(p)}, 1), {BLANKS}), '')" for p in v.TITLE_PATTERNS)


@query(
    "extract_title",
    PAPERS
    + f"""SELECT doc_id, coalesce({_MATCHED}, list_max(list_transform(list_filter(l, lambda x: length(x) BETWEEN 10 AND 300
  AND NOT regexp_matches(x, {re2(v.NOT_A_TITLE)}) AND NOT regexp_matches(x, {re2(v.NUMBERED_LINE)})),
  lambda x: {{'n': length(x), 'x': x}})).x) AS title
 FROM (SELECT doc_id, ({LINES})[1:20] AS l FROM (SELECT doc_id, text FROM papers UNION ALL SELECT -doc_id - 1, text FROM documents))""",
)
def _(spark, sf):
    raw = fx.table(spark, sf, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    both = fx.papers(spark, sf).select("doc_id", "text").unionByName(raw)
    return both.select("doc_id", ex.title(F.col("text")).alias("title"))


def _names_sql(pattern: str) -> str:
    return f"""list_filter(list_transform(string_split_regex(regexp_extract(h, {re2(pattern)}, 1), {re2(v.AUTHOR_SEPARATOR)}),
  lambda x: trim(x, {BLANKS})), lambda x: length(x) > 3 AND NOT regexp_matches(x, {re2(v.NOT_AN_AUTHOR)}))"""


def _authors_sql(head: str) -> str:
    cases = " ".join(f"WHEN len({_names_sql(p)}) > 0 THEN {_names_sql(p)}" for p in v.AUTHOR_PATTERNS)
    return f"""SELECT doc_id, array_to_string(CASE {cases} END, '; ') AS authors FROM (SELECT doc_id, {head} AS h
 FROM (SELECT doc_id, text FROM papers UNION ALL SELECT -doc_id - 1, text FROM documents))"""


def _papers_and_documents(spark, sf):
    raw = fx.table(spark, sf, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return fx.papers(spark, sf).select("doc_id", "text").unionByName(raw)


@query("extract_authors", PAPERS + _authors_sql("text"))
def _(spark, sf):
    docs = _papers_and_documents(spark, sf)
    return docs.select("doc_id", F.array_join(ex.authors(F.col("text")), "; ").alias("authors"))


@query("extract_authors_whole_text", PAPERS + _authors_sql("text"))
def _(spark, sf):
    docs = _papers_and_documents(spark, sf)
    return docs.select("doc_id", F.array_join(ex.authors(F.col("text"), window=None), "; ").alias("authors"))


def _years_sql(head: str) -> str:
    found = []
    for p in v.YEAR_PATTERNS:
        if p.startswith("(?<="):
            # No look-around in the oracle: double the blanks, then let each year own both of its own.
            found.append(f"regexp_extract_all(regexp_replace({head}, '(\\s)', '\\1\\1', 'g'), '\\s(\\d{{4}})\\s', 1)")
        else:
            found.append(f"regexp_extract_all({head}, {re2(p)}, 1)")
    return f""", found AS (SELECT doc_id, {" || ".join(found)} AS ys FROM papers),
 seen AS (SELECT doc_id, CAST(unnest(ys) AS INTEGER) AS y, unnest(range(len(ys))) AS pos FROM found),
 best AS (SELECT doc_id, y, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS r
  FROM seen WHERE y BETWEEN 1900 AND 2025 GROUP BY doc_id, y)
 SELECT doc_id, y AS year FROM papers LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (doc_id)"""


@query("extract_year", PAPERS.rstrip() + _years_sql("text"))
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.year(F.col("text")).alias("year"))


@query("extract_year_whole_text", PAPERS.rstrip() + _years_sql("text"))
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.year(F.col("text"), window=None).alias("year"))


def _known_sql(head: str, names: list[str]) -> str:
    edge = r"[^\p{L}\p{N}_]"
    return "CASE " + " ".join(
        f"WHEN regexp_matches({head}, '(?i)(?:^|{edge}){n}(?:$|{edge})') THEN '{n}'" for n in names
    )


def _first_plausible_sql(head: str, patterns: list[str], finish: str = "{0}") -> str:
    cases = []
    for p in patterns:
        m = f"trim(regexp_extract({head}, {re2(p)}, 1), {BLANKS})"
        cases.append(f"WHEN length({m}) BETWEEN 4 AND 99 THEN " + finish.format(m))
    return " ".join(cases)


_TAILS = "{0}"
for _tail in v.JOURNAL_TAILS:
    _TAILS = f"regexp_replace({_TAILS}, {re2(_tail).replace('{', '{{').replace('}', '}}')}, '', 'g')"


def _publisher_sql(head: str) -> str:
    return f"{_known_sql(head, v.PUBLISHERS)} {_first_plausible_sql(head, v.PUBLISHER_PATTERNS)} END"


def _journal_sql(head: str) -> str:
    return f"nullif({_known_sql(head, v.JOURNALS)} {_first_plausible_sql(head, v.JOURNAL_PATTERNS, _TAILS)} END, '')"


@query("extract_publisher", PAPERS + f"SELECT doc_id, {_publisher_sql('text')} AS publisher FROM papers")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.publisher(F.col("text")).alias("publisher"))


@query("extract_publisher_whole_text", PAPERS + f"SELECT doc_id, {_publisher_sql('text')} AS publisher FROM papers")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.publisher(F.col("text"), window=None).alias("publisher"))


@query("extract_journal", PAPERS + f"SELECT doc_id, {_journal_sql('text')} AS journal FROM papers")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.journal(F.col("text")).alias("journal"))


@query("extract_journal_whole_text", PAPERS + f"SELECT doc_id, {_journal_sql('text')} AS journal FROM papers")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.journal(F.col("text"), window=None).alias("journal"))


@query("extract_doi", PAPERS + f"SELECT doc_id, nullif(regexp_extract(text, {re2(v.DOI_PATTERN)}, 1), '') AS doi FROM papers")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.doi(F.col("text")).alias("doi"))


_LOOSE = ", ".join(f"nullif(regexp_extract(text, {re2(p)}, 1), '')" for p in v.LOOSE_DOI_PATTERNS)


@query("doi_loose", PAPERS + f"SELECT doc_id, regexp_replace(coalesce({_LOOSE}), '[,;.\\s]+$', '') AS doi FROM papers")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.doi_loose(F.col("text")).alias("doi"))


_ISBN = ", ".join(f"nullif(regexp_extract(text, {re2(p)}, 1), '')" for p in v.ISBN_PATTERNS)


@query("extract_isbn", PAPERS + f"SELECT doc_id, regexp_replace(coalesce({_ISBN}), '[- ]', '', 'g') AS isbn FROM papers")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.isbn(F.col("text")).alias("isbn"))


def _ratio_sql(head: str) -> str:
    def share(words):
        return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))::DOUBLE / len(w)"

    return f"""SELECT doc_id, CASE WHEN len(w) = 0 THEN 'en'
  WHEN abs(de - en) < 0.05::DOUBLE AND de > 0.05::DOUBLE AND en > 0.05::DOUBLE THEN 'mixed' WHEN de > en THEN 'de' ELSE 'en' END AS language
 FROM (SELECT *, {share(v.GERMAN_WORDS)} AS de, {share(v.ENGLISH_WORDS)} AS en
  FROM (SELECT doc_id, text, regexp_extract_all(lower({head}), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents))"""


@query("language_ratio", _ratio_sql("text"))
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", ex.language_ratio(F.col("text")).alias("language"))


@query("language_ratio_whole_text", _ratio_sql("text"))
def _(spark, sf):
    language = ex.language_ratio(F.col("text"), window=None)
    return fx.table(spark, sf, "documents").select("doc_id", language.alias("language"))


def _presence_sql(head: str) -> str:
    def count(words):
        return " + ".join(f"contains(' ' || lower({head}) || ' ', ' {w} ')::INT" for w in words[: v.PRESENCE_WORDS])

    return f"CASE WHEN {count(v.GERMAN_WORDS)} > {count(v.ENGLISH_WORDS)} THEN 'de' ELSE 'en' END"


@query("language_presence", f"SELECT doc_id, {_presence_sql('text')} AS language FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", ex.language_presence(F.col("text")).alias("language"))


@query(
    "language_confusion",
    f"SELECT lang, {_presence_sql('text')} AS detected, count(*) AS documents FROM documents GROUP BY ALL",
)
def _(spark, sf):
    detected = ex.language_presence(F.col("text"), window=None).alias("detected")
    return fx.table(spark, sf, "documents").groupBy("lang", detected).agg(F.count("*").alias("documents"))


def _body(name: str) -> str:
    """The part of a registered oracle after its ``papers`` view, usable as a view itself."""
    body = ORACLES[name][len(PAPERS.rstrip()) :].lstrip()
    return "WITH " + body[1:] if body.startswith(",") else body


_PARTS = {"title": "extract_title", "authors": "extract_authors", "year": "extract_year", "doi": "extract_doi",
          "isbn": "extract_isbn", "journal": "extract_journal", "publisher": "extract_publisher"}


@query(
    "extract_all",
    PAPERS.rstrip()
    + ", "
    + ", ".join(f"q_{field} AS ({_body(name)})" for field, name in _PARTS.items())
    + f", q_language AS ({_ratio_sql('text').replace('FROM documents', 'FROM papers')})"
    + " SELECT doc_id, title, authors AS author, year, language, doi, isbn, journal, publisher FROM papers "
    + " ".join(f"JOIN q_{field} USING (doc_id)" for field in [*_PARTS, "language"]),
)
def _(spark, sf):
    found = ex.extract_all(fx.papers(spark, sf))
    return found.drop("text", "lang", "source").withColumn("author", F.array_join("author", "; "))


# --- page one ---------------------------------------------------------------------------------

_HF = re2("(?i)" + "|".join(["full terms", "conditions of (?:access|use)", "copyright", r"^page \d+", "^issn", "^doi:", r"^\d+$", "all rights reserved"]))
BODY = f"list_filter({LINES}, lambda x: NOT regexp_matches(x, {_HF}))"
BODIES = f"bodies AS (SELECT doc_id, text, {BODY} AS l FROM papers)"
PAGE_TITLE = f"""list_max(list_transform(list_filter(list_transform(l[1:10], lambda x, i: {{'x': x, 'i': i}}),
 lambda s: length(s.x) >= 20 AND NOT regexp_matches(s.x, {re2(v.PAGE_ONE_NOT_A_TITLE)})), lambda s: {{'n': length(s.x), 'i': -s.i, 'x': s.x}})).x"""
PAGE_ONE = sql.with_views(sql.PAPERS, BODIES)


@query("page_title", PAGE_ONE + f"SELECT doc_id, {PAGE_TITLE} AS title FROM bodies")
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.page_title(ex.body_lines(F.col("text"))).alias("title"))


_IRRELEVANT = re2(
    "(?i)full terms|conditions of (?:access|use)|copyright|all rights reserved|Taylor & Francis|elsevier|springer|john wiley|https?://|terms and conditions"
)
_NAME_LINE = re2("|".join(v.PAGE_ONE_NAMES))


@query(
    "page_authors",
    PAGE_ONE.rstrip()
    + f""", titled AS (SELECT doc_id, l, {PAGE_TITLE} AS title FROM bodies),
 placed AS (SELECT *, list_position(list_transform(l, lambda x: contains(x, title)), true) AS pos FROM titled),
 near AS (SELECT *, CASE WHEN pos > 0 AND pos < len(l) THEN list_filter(l[pos + 1:pos + 9], lambda x: length(x) BETWEEN 3 AND 100
   AND (regexp_matches(x, {_NAME_LINE}) OR (regexp_matches(x, {re2(v.PAGE_ONE_DEGREE)}) AND NOT regexp_matches(x, {re2(v.PAGE_ONE_INSTITUTION)})))
   AND NOT regexp_matches(x, {_IRRELEVANT})) END AS names FROM placed)
 SELECT doc_id, array_to_string(CASE WHEN names IS NULL THEN [] WHEN len(names) > 0 THEN list_sort(names)
  ELSE list_sort(list_filter(list_distinct(regexp_extract_all(array_to_string(l[1:30], ' '), {re2(v.PAGE_ONE_ANY_NAME)}, 1)),
   lambda x: NOT regexp_matches(x, {_IRRELEVANT}))) END, '; ') AS authors FROM near""",
)
def _(spark, sf):
    lined = fx.papers(spark, sf).select("doc_id", ex.body_lines(F.col("text")).alias("lines"))
    titled = lined.withColumn("title", ex.page_title(F.col("lines")))
    names = F.array_sort(ex.page_authors(F.col("lines"), F.col("title")))
    return titled.select("doc_id", F.array_join(names, "; ").alias("authors"))


_J = ", ".join(
    f"nullif(regexp_extract(x, {re2(p.replace('(?<![^,' + chr(92) + '.])', ''))}, 0), '')" for p in v.PAGE_ONE_JOURNAL
)


@query(
    "page_journal",
    PAGE_ONE + f"SELECT doc_id, trim(list_filter(list_transform(l[1:10], lambda x: coalesce({_J})), lambda x: x IS NOT NULL)[1]) AS journal FROM bodies",
)
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.page_journal(ex.body_lines(F.col("text"))).alias("journal"))


@query(
    "year_max",
    PAPERS
    + """, y AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '\\d+'), lambda d: length(d) = 4 AND d[1:2] IN ('19', '20')),
  lambda d: CAST(d AS INTEGER)) AS ys FROM papers)
 SELECT doc_id, coalesce(list_max(list_filter(ys, lambda x: x BETWEEN 1990 AND 2030)), ys[1]) AS year FROM y""",
)
def _(spark, sf):
    return fx.papers(spark, sf).select("doc_id", ex.year_max(F.col("text")).alias("year"))


_ANY_NAMES = f"regexp_extract_all(array_to_string(l[1:30], ' '), {re2(v.PAGE_ONE_ANY_NAME)}, 1)"


@query(
    "page_metadata",
    sql.with_views(sql.LIBRARY, sql.PAPERS, BODIES).rstrip()
    + f""", titled AS (SELECT doc_id, text, l, {PAGE_TITLE} AS new_title FROM bodies),
 placed AS (SELECT *, list_position(list_transform(l, lambda x: contains(x, new_title)), true) AS pos FROM titled),
 near AS (SELECT *, CASE WHEN pos > 0 AND pos < len(l) THEN list_filter(l[pos + 1:pos + 9], lambda x: length(x) BETWEEN 3 AND 100
   AND (regexp_matches(x, {_NAME_LINE}) OR (regexp_matches(x, {re2(v.PAGE_ONE_DEGREE)}) AND NOT regexp_matches(x, {re2(v.PAGE_ONE_INSTITUTION)})))
   AND NOT regexp_matches(x, {_IRRELEVANT})) END AS names FROM placed),
 named AS (SELECT *, CASE WHEN names IS NULL THEN [] WHEN len(names) > 0 THEN names
  ELSE list_filter(list_filter({_ANY_NAMES}, lambda x, i: list_position({_ANY_NAMES}, x) = i), lambda x: NOT regexp_matches(x, {_IRRELEVANT})) END AS found FROM near),
 q_doi AS (SELECT doc_id, regexp_replace(coalesce({_LOOSE}), '[,;.\\s]+$', '') AS new_doi FROM papers),
 q_journal AS (SELECT doc_id, trim(list_filter(list_transform(l[1:10], lambda x: coalesce({_J})), lambda x: x IS NOT NULL)[1]) AS new_journal FROM bodies),
 q_year AS (SELECT doc_id, coalesce(list_max(list_filter(ys, lambda x: x BETWEEN 1990 AND 2030)), ys[1]) AS new_year
  FROM (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '\\d+'), lambda d: length(d) = 4 AND d[1:2] IN ('19', '20')),
   lambda d: CAST(d AS INTEGER)) AS ys FROM papers))
 SELECT o.doc_id, CASE WHEN new_title IS NOT NULL AND NOT regexp_matches(new_title, {_IRRELEVANT})
   AND (coalesce(o.title, '') = '' OR length(new_title) > length(o.title)) THEN new_title ELSE o.title END AS title,
  array_to_string(CASE WHEN len(o.author) > 0 THEN o.author WHEN len(found) > 0 THEN found END, '; ') AS author,
  coalesce(new_doi, o.doi) AS doi, coalesce(new_journal, o.journal) AS journal, coalesce(new_year, o.year) AS year
 FROM library o JOIN named USING (doc_id) JOIN q_doi USING (doc_id) JOIN q_journal USING (doc_id) JOIN q_year USING (doc_id)""",
)
def _(spark, sf):
    own = fx.library(spark, sf).select("doc_id", "title", "author", "doi", "journal", "year")
    merged = ex.page_metadata(fx.papers(spark, sf).select("doc_id", "text").join(own, "doc_id"))
    return merged.select("doc_id", "title", F.array_join("author", "; ").alias("author"), "doi", "journal", "year")


@query(
    "validate_metadata",
    LIB
    + f"""SELECT doc_id, t AS title,
 array_to_string(CASE WHEN len(k) > 0 THEN k ELSE author END, '; ') AS author
 FROM (SELECT doc_id, author, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t,
  list_filter(author, lambda a: length(a) BETWEEN 3 AND 100 AND NOT regexp_matches(a, {_IRRELEVANT})) AS k
  FROM (SELECT l.doc_id, CASE WHEN l.journal IS NOT NULL THEN list_append(l.author, 'Springer ' || l.journal) ELSE ['ab'] END AS author, d.text
   FROM library l JOIN documents d USING (doc_id)))""",
)
def _(spark, sf):
    own = fx.library(spark, sf).select(
        "doc_id",
        F.when(
            F.col("journal").isNotNull(), F.array_append(F.coalesce("author", F.array().cast("array<string>")), F.concat(F.lit("Springer "), "journal"))
        )
        .otherwise(F.array(F.lit("ab")))
        .alias("author"),
    )
    docs = own.join(fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("title")), "doc_id")
    return ex.validate_metadata(docs).select("doc_id", "title", F.array_join("author", "; ").alias("author"))


@query(
    "split_authors",
    LIB
    + f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(p, '[,;]\\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS pdf,
 array_to_string(list_transform(string_split(o, ';'), lambda x: trim(x)), '|') AS office,
 array_to_string(list_transform(string_split(f, ','), lambda x: trim(x)), '|') AS form
 FROM (SELECT doc_id, array_to_string(author, '; ') || ', Max Planck,' AS p, array_to_string(author, '; ') AS o,
  array_to_string(author, ' , ') AS f FROM library)""",
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    listed = F.concat(F.array_join("author", "; "), F.lit(", Max Planck,"))
    return lib.select(
        "doc_id",
        F.array_join(tx.split_names(listed, "pdf"), "|").alias("pdf"),
        F.array_join(tx.split_names(F.array_join("author", "; "), "office"), "|").alias("office"),
        F.array_join(tx.split_names(F.array_join("author", " , "), "form"), "|").alias("form"),
    )


@query(
    "fill_missing",
    sql.with_views(sql.LIBRARY, sql.PAPERS).rstrip()
    + f""", qt AS ({_body("extract_title")}), qa AS ({_body("extract_authors")})
 SELECT l.doc_id, CASE WHEN keep AND l.title <> '' THEN l.title ELSE qt.title END AS title,
 CASE WHEN len(l.author) > 0 THEN array_to_string(l.author, '; ') ELSE qa.authors END AS author, CASE WHEN language = 'es' THEN 'auto' ELSE language END AS language,
 nullif(substr(lower(regexp_extract(filename, '^.+(\\.[^./]+)$', 1)), 2), '') AS file_type,
 CAST(CASE WHEN keep THEN page_count ELSE greatest(1, length(d.text) // 2000) END AS BIGINT) AS page_count
 FROM (SELECT *, journal IS NOT NULL AS keep FROM library) l JOIN documents d ON d.doc_id = l.doc_id
  JOIN qt ON qt.doc_id = -l.doc_id - 1 JOIN qa ON qa.doc_id = -l.doc_id - 1""",
)
def _(spark, sf):
    keep = F.col("journal").isNotNull()
    lib = fx.library(spark, sf).select(
        "doc_id", "filename", "author",
        F.when(keep, F.col("title")).alias("title"),
        F.when(F.col("language") != "es", F.col("language")).alias("language"),
        F.when(keep, F.col("page_count")).alias("page_count"),
    )
    docs = lib.join(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    filled = ex.fill_missing(docs)
    return filled.select("doc_id", "title", F.array_join("author", "; ").alias("author"), "language", "file_type", "page_count")


# --- similarity -------------------------------------------------------------------------------


@query(
    "string_similarity",
    LIB
    + f"""SELECT doc_id, {similarity_sql("title", "reverse(title)")} AS reversed, {similarity_sql("title", "'  ' || title")} AS padded,
 {similarity_sql("title", "journal")} AS against_journal FROM library""",
)
def _(spark, sf):
    title = F.col("title")
    return fx.library(spark, sf).select(
        "doc_id",
        sim.string_similarity(title, F.reverse(title)).alias("reversed"),
        sim.string_similarity(title, F.concat(F.lit("  "), title)).alias("padded"),
        sim.string_similarity(title, F.col("journal")).alias("against_journal"),
    )


# One title is the beginning of the other, so the longest common block is the shorter one.
@query("sequence_ratio", LIB + """SELECT doc_id, CASE WHEN coalesce(trim(title), '') = '' THEN 0.0::DOUBLE
 ELSE 2.0::DOUBLE * length(trim(title)) / (2 * length(trim(title)) + length(' (Nachdruck)')) END AS ratio FROM library""")
def _(spark, sf):
    title = F.col("title")
    ratio = sim.sequence_ratio(title, F.concat(title, F.lit(" (Nachdruck)")))
    return fx.library(spark, sf).select("doc_id", ratio.alias("ratio"))


def author_similarity_sql(found: str, original: str) -> str:
    s = similarity_sql("f", "o")
    best = f"list_transform(list_filter({found}, lambda f: coalesce(f, '') <> ''), lambda f: coalesce(list_max(list_transform({original}, lambda o: {s})), 0.0::DOUBLE))"
    return f"(CASE WHEN len({found}) > 0 THEN list_sum({best}) / len({found}) ELSE 0.0::DOUBLE END)"


@query(
    "author_similarity",
    LIB
    + f"""SELECT doc_id, {author_similarity_sql("p", "author")} AS similarity
 FROM (SELECT doc_id, author, ['Ada Lovelace', 'Max Borne', 'grace hopper'] AS p FROM library)""",
)
def _(spark, sf):
    found = F.array(*[F.lit(n) for n in ("Ada Lovelace", "Max Borne", "grace hopper")])
    return fx.library(spark, sf).select("doc_id", sim.author_similarity(found, F.col("author")).alias("similarity"))


# --- keys, names, sizes -----------------------------------------------------------------------


@query(
    "document_id",
    LIB
    + """SELECT doc_id, substr(md5(concat_ws('_', filename, file_size, epoch_us(added_at))), 1, 12) AS by_file,
 substr(md5(concat_ws('_', filename, file_size, epoch_us(added_at), md5(title))), 1, 12) AS by_content FROM library""",
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    mtime = F.unix_micros(F.col("added_at").cast("timestamp"))
    args = (F.col("filename"), F.col("file_size"), mtime)
    return lib.select(
        "doc_id",
        tx.document_id(*args).alias("by_file"),
        tx.document_id(*args, content_md5=F.md5("title")).alias("by_content"),
    )


@query(
    "content_hash",
    "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents",
)
def _(spark, sf):
    text = F.col("text")
    return fx.table(spark, sf, "documents").select(
        "doc_id", *[tx.content_hash(text, a).alias(a) for a in ("md5", "sha1", "sha256")]
    )


@query("exact_duplicates", "SELECT md5(text) AS md5, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf):
    hashed = fx.table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("md5"))
    return hashed.groupBy("md5").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


@query(
    "cache_key",
    LIB
    + """, k AS (SELECT doc_id, concat_ws('_', nullif(title, ''), nullif(array_to_string(author, '_'), '')) AS a FROM library),
 f AS (SELECT doc_id, CASE WHEN length('CrossRef_query_' || a) > 100 THEN 'CrossRef_query_' || md5(a) ELSE 'CrossRef_query_' || a END AS key, a FROM k)
 SELECT doc_id, key, CASE WHEN length(regexp_replace(a, '[^\\p{L}\\p{N}_-]', '_', 'g')) > 100
  THEN substr(regexp_replace(a, '[^\\p{L}\\p{N}_-]', '_', 'g'), 1, 50) || '_' || md5(a) ELSE regexp_replace(a, '[^\\p{L}\\p{N}_-]', '_', 'g') END AS file_key FROM f""",
)
def _(spark, sf):
    joined = F.array_join("author", "_")
    raw = F.concat_ws("_", F.nullif(F.col("title"), F.lit("")), joined)
    return fx.library(spark, sf).select(
        "doc_id",
        tx.cache_key("CrossRef", "query", F.col("title"), joined).alias("key"),
        tx.cache_file_key(raw).alias("file_key"),
    )


@query(
    "human_size",
    """SELECT doc_id, CASE WHEN b = 0 THEN '0 B' WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0::DOUBLE)
  WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0::DOUBLE) WHEN b < 1099511627776 THEN printf('%.2f GB', b / 1073741824.0::DOUBLE)
  ELSE printf('%.2f TB', b / 1099511627776.0::DOUBLE) END AS size FROM (SELECT doc_id, n_chars * n_chars * n_chars // 64 AS b FROM documents)""",
)
def _(spark, sf):
    size = F.floor(F.pow("n_chars", F.lit(3)) / 64).cast("bigint")
    return fx.table(spark, sf, "documents").select("doc_id", tx.human_size(size).alias("size"))


@query("safe_filename", LIB + """SELECT doc_id, coalesce(nullif(trim(translate(n, '<>:"/\\|?*', '_________'), ' '), ''), 'unnamed_file') AS name
 FROM (SELECT doc_id, CASE WHEN doi IS NULL THEN '  ' ELSE ' ' || doi || ':' || title || '?.pdf ' END AS n FROM library)""")
def _(spark, sf):
    name = F.when(F.col("doi").isNull(), "  ").otherwise(F.concat(F.lit(" "), "doi", F.lit(":"), "title", F.lit("?.pdf ")))
    return fx.library(spark, sf).select("doc_id", tx.safe_filename(name).alias("name"))


@query(
    "normalize_title",
    "SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM documents",
)
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", tx.normalize_title(F.col("text")).alias("title"))


@query(
    "surname",
    LIB + "SELECT doc_id, array_to_string(list_transform(author, lambda a: string_split_regex(a, '\\s+')[-1]), ', ') AS surnames FROM library",
)
def _(spark, sf):
    return fx.library(spark, sf).select("doc_id", F.array_join(F.transform("author", tx.surname), ", ").alias("surnames"))
