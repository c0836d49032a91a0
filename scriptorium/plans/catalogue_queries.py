"""Catalogue records: normalising, resolving, scoring, enriching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import enrich, mutate, processing, records, resolve, scoring
from scriptorium.plans import fixtures as fx
from scriptorium.plans import fixture_sql as sql
from scriptorium.plans.chunk_queries import recursive_cut
from scriptorium.plans.registry import ORACLES, query
from scriptorium.plans.text_queries import author_similarity_sql, similarity_sql
from scriptorium.schema import RECORD_FIELDS

LIB = sql.with_views(sql.LIBRARY)
CAT = sql.with_views(sql.LIBRARY, sql.CATALOGUE)
LISTS = ("author", "keywords")


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.array_join(n, "; ") for n in LISTS if n in df.columns})


def _flat_sql(fields: dict[str, str]) -> str:
    types = {"year": "INTEGER", "page_count": "BIGINT", "cited_by_count": "BIGINT", "is_open_access": "BOOLEAN"}
    out = []
    for name in RECORD_FIELDS:
        value = fields.get(name, "NULL")
        if name in LISTS:
            out.append(f"array_to_string({value}, '; ') AS {name}" if value != "NULL" else f"CAST(NULL AS VARCHAR) AS {name}")
        else:
            out.append(f"CAST({value} AS {types.get(name, 'VARCHAR')}) AS {name}")
    return ", ".join(out)


# --- normalising: raw service records built from the library, read back with the service's schema ---


def _parsed(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("doc_id", F.from_json(F.to_json("raw"), records.SCHEMAS[source]).alias("r")).select("doc_id", "r.*")


@query(
    "normalize_crossref",
    LIB
    + "SELECT doc_id, 'crossref' AS source, "
    + _flat_sql({"title": "title", "author": "author", "journal": "journal", "year": "year", "publisher": "publisher", "doi": "doi", "issn": "CASE WHEN issue IS NOT NULL THEN '1234-567' || (doc_id % 10) END", "type": "type", "abstract": "publisher_location"})
    + " FROM library",
)
def _(spark, sf):
    given = F.transform("author", lambda a: F.nullif(F.regexp_replace(a, " ?[^ ]+$", ""), F.lit("")))
    family = F.transform("author", lambda a: F.element_at(F.split(a, " "), -1))
    raw = F.struct(
        F.array("title").alias("title"),
        F.zip_with(given, family, lambda g, f: F.struct(g.alias("given"), f.alias("family"))).alias("author"),
        F.when(F.col("journal").isNotNull(), F.array("journal")).alias("container-title"),
        F.struct(F.array(F.array("year")).alias("date-parts")).alias("published"),
        F.col("publisher"), F.col("doi").alias("DOI"),
        F.when(F.col("issue").isNotNull(), F.array(F.concat(F.lit("1234-567"), F.col("doc_id") % 10))).alias("ISSN"),
        F.col("type"), F.col("publisher_location").alias("abstract"),
    )
    return _flat(records.from_crossref(_parsed(fx.library(spark, sf).select("doc_id", raw.alias("raw")), "crossref"), ["doc_id"]))


@query(
    "normalize_openalex",
    LIB
    + "SELECT doc_id, 'openalex' AS source, "
    + _flat_sql({"title": "title", "author": "author", "journal": "journal", "year": "year", "publisher": "CASE WHEN journal IS NOT NULL THEN 'Press ' || source END", "doi": "doi", "issn": "CASE WHEN journal IS NOT NULL THEN '1111-2222' END", "type": "type", "cited_by_count": "doc_id", "keywords": "['k1', language, 'k2']", "is_open_access": "page_count > 1"})
    + " FROM library",
)
def _(spark, sf):
    place = F.struct(
        F.col("journal").alias("display_name"),
        F.lit("1111-2222").alias("issn_l"),
        F.struct(F.concat(F.lit("Press "), "source").alias("display_name")).alias("host_organization"),
    )
    raw = F.struct(
        "title", "doi", "type",
        F.transform("author", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"),
        F.col("year").alias("publication_year"),
        F.struct(F.when(F.col("journal").isNotNull(), place).alias("source")).alias("primary_location"),
        F.col("doc_id").alias("cited_by_count"),
        F.transform(F.array(F.lit("k1"), "language", F.lit("k2"), F.lit("k3")), lambda k: F.struct(k.alias("display_name"))).alias("concepts"),
        F.struct((F.col("page_count") > 1).alias("is_oa")).alias("open_access"),
    )
    return _flat(records.from_openalex(_parsed(fx.library(spark, sf).select("doc_id", raw.alias("raw")), "openalex"), ["doc_id"]))


@query(
    "normalize_googlebooks",
    LIB
    + "SELECT doc_id, 'googlebooks' AS source, "
    + _flat_sql({"title": "title || coalesce(': ' || journal, '')", "author": "author", "year": "year", "publisher": "publisher", "isbn": "coalesce(isbn, '3161484100')", "page_count": "page_count", "language": "language", "keywords": "[type, source]", "abstract": "publisher_location"})
    + " FROM library",
)
def _(spark, sf):
    ten = F.struct(F.lit("ISBN_10").alias("type"), F.lit("3161484100").alias("identifier"))
    thirteen = F.struct(F.lit("ISBN_13").alias("type"), F.col("isbn").alias("identifier"))
    info = F.struct(
        "title", F.col("journal").alias("subtitle"), F.col("author").alias("authors"),
        F.concat("year", F.lit("-05-01")).alias("publishedDate"), "publisher",
        F.when(F.col("isbn").isNotNull(), F.array(ten, thirteen)).otherwise(F.array(ten)).alias("industryIdentifiers"),
        F.col("page_count").alias("pageCount"), "language", F.array("type", "source").alias("categories"),
        F.col("publisher_location").alias("description"),
    )
    raw = F.struct(info.alias("volumeInfo"))
    return _flat(records.from_googlebooks(_parsed(fx.library(spark, sf).select("doc_id", raw.alias("raw")), "googlebooks"), ["doc_id"]))


@query(
    "normalize_openlib",
    LIB
    + "SELECT doc_id, 'openlib' AS source, "
    + _flat_sql({"title": "title", "author": "author", "year": "coalesce(year, 1950)", "publisher": "publisher", "isbn": "isbn", "page_count": "page_count", "language": "CASE language WHEN 'en' THEN 'en/de' WHEN 'de' THEN 'de/de' ELSE language || '/de' END", "keywords": "[type, source, 's3', 's4', 's5']"})
    + " FROM library",
)
def _(spark, sf):
    code = F.when(F.col("language") == "en", "eng").when(F.col("language") == "de", "deu").otherwise(F.col("language"))
    raw = F.struct(
        "title", F.col("author").alias("author_name"), F.col("year").alias("first_publish_year"),
        F.array(F.lit(1999), F.lit(1950)).alias("publish_year"),
        F.when(F.col("publisher").isNotNull(), F.array("publisher", F.lit("Other"))).alias("publisher"),
        F.when(F.col("isbn").isNotNull(), F.array("isbn", F.lit("0"))).alias("isbn"),
        F.array(code, F.lit("ger")).alias("language"), F.col("page_count").alias("number_of_pages_median"),
        F.array("type", "source", F.lit("s3"), F.lit("s4"), F.lit("s5"), F.lit("s6")).alias("subject"),
    )
    return _flat(records.from_openlib(_parsed(fx.library(spark, sf).select("doc_id", raw.alias("raw")), "openlib"), ["doc_id"]))


@query(
    "normalize_marc",
    LIB
    + "SELECT doc_id, 'k10plus' AS source, "
    + _flat_sql({"title": "CASE WHEN title = '' THEN 'Band 1' ELSE title || ' Band 1' END", "author": "author", "year": "coalesce(year, 1977)", "publisher": "coalesce(publisher, 'Verlag') || ' '", "isbn": "isbn", "page_count": "page_count", "language": "CASE language WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' ELSE language || ' ' END", "keywords": "[type, source]"})
    + " FROM library",
)
def _(spark, sf):
    def esc(c):
        c = F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
        return F.regexp_replace(c, ">", "&gt;")

    def field(tag, code, value):
        text = F.concat(F.lit(f'<datafield tag="{tag}"><subfield code="{code}">'), value, F.lit("</subfield></datafield>"))
        return F.coalesce(text, F.lit(""))

    code = F.when(F.col("language") == "en", "eng").when(F.col("language") == "de", "ger").otherwise(F.rpad("language", 3, " "))
    control = F.concat(F.lit("240101s"), F.coalesce(F.col("year").cast("string"), F.lit("uuuu")), F.repeat(F.lit("x"), F.lit(24)), code, F.lit("yy"))
    people = F.array_join(
        F.transform(
            "author", lambda a, i: F.concat(F.when(i == 0, '<datafield tag="100">').otherwise('<datafield tag="700">'), F.lit('<subfield code="a">'), a, F.lit(", 1815-1852</subfield></datafield>"))
        ),
        "",
    )
    xml = F.concat(
        F.lit('<record><controlfield tag="001">x</controlfield><controlfield tag="008">'), control, F.lit("</controlfield>"),
        field("020", "a", F.concat(F.col("isbn"), F.lit(" (geb.)"))), F.coalesce(people, F.lit("")),
        F.lit('<datafield tag="245"><subfield code="a">'), esc(F.col("title")), F.lit('</subfield><subfield code="b">Band 1</subfield><subfield code="c">x</subfield></datafield>'),
        F.lit('<datafield tag="264"><subfield code="b">'), F.coalesce("publisher", F.lit("Verlag")), F.lit(' :,</subfield><subfield code="c">[1977]</subfield></datafield>'),
        field("300", "a", F.concat(F.lit("XII, "), F.col("page_count"), F.lit(" Seiten"))),
        field("650", "a", F.col("type")), field("650", "a", F.col("source")), F.lit("</record>"),
    )
    options = {"rowTag": "record", "attributePrefix": "_", "valueTag": "_VALUE", "ignoreSurroundingSpaces": "false"}
    parsed = fx.library(spark, sf).select("doc_id", F.from_xml(xml, records.MARC, options).alias("r")).select("doc_id", "r.*")
    return _flat(records.from_marc(parsed, ["doc_id"]))


@query(
    "abstract_rebuild",
    "SELECT item_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' ') AS abstract FROM benchmark",
)
def _(spark, sf):
    """Word positions of every benchmark text as an inverted index, put back together."""
    placed = fx.table(spark, sf, "benchmark").select(
        "item_id", F.posexplode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("at", "word")
    )
    index = (
        placed.groupBy("item_id", "word")
        .agg(F.array_sort(F.collect_list("at")).alias("positions"))
        .groupBy("item_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "positions"))).alias("index"))
    )
    return index.select("item_id", records.rebuild_abstract(F.col("index")).alias("abstract"))


# --- scoring ----------------------------------------------------------------------------------


def _bonus_sql(weights: dict[str, int], prefix: str) -> str:
    parts = []
    for name, points in weights.items():
        c = f"{prefix}{name}"
        has = f"len({c}) > 0" if name in LISTS else (f"{c} <> 0" if name in ("year", "page_count", "cited_by_count") else f"{c} <> ''")
        parts.append(f"CASE WHEN {has} THEN {points}.0::DOUBLE ELSE 0.0::DOUBLE END")
    return "(" + " + ".join(parts) + ")"


def _metadata_score_sql(r: str, title: str, author: str, source: str) -> str:
    bonus = " ".join(f"WHEN '{s}' THEN {_bonus_sql(w, r)}" for s, w in scoring.METADATA_BONUS.items())
    return f"""({similarity_sql(f"{r}title", title)} * 50 + CASE WHEN len({r}author) > 0 AND len({author}) > 0
  THEN {author_similarity_sql(f"{r}author", author)} * 30 ELSE 0.0::DOUBLE END + CASE {source} {bonus} END)"""


def _candidate_bonus_sql(r: str, source: str) -> str:
    bonus = " ".join(f"WHEN '{s}' THEN {_bonus_sql(dict.fromkeys(w, 5), r)}" for s, w in scoring.CANDIDATE_BONUS.items())
    return f"CASE {source} {bonus} ELSE {_bonus_sql(scoring.METADATA_BONUS['k10plus'], r)} END"


def _candidate_author_sql(r: str, author: str, source: str) -> str:
    surname_hit = f"len(list_filter({r}author, lambda f: len(list_filter({author}, lambda o: contains(lower(o), lower(string_split(f, ' ')[-1])))) > 0)) > 0"
    name_hit = f"len(list_filter({r}author, lambda f: len(list_filter({author}, lambda o: contains(lower(o), lower(f)) OR contains(lower(f), lower(o)))) > 0)) > 0"
    return f"""CASE WHEN coalesce(len({r}author), 0) = 0 OR coalesce(len({author}), 0) = 0 THEN 0.0::DOUBLE
  WHEN {source} = 'k10plus' THEN {author_similarity_sql(f"{r}author", author)} * 30
  WHEN {source} = 'crossref' THEN CASE WHEN {surname_hit} THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END
  ELSE CASE WHEN {name_hit} THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END END"""


def _candidate_score_sql(r: str, title: str, author: str, source: str) -> str:
    return f"""({similarity_sql(f"{r}title", title)} * 50 + {_candidate_author_sql(r, author, source)} + {_candidate_bonus_sql(r, source)})"""


SCORED = f"""scored AS (SELECT c.*, l.title AS own_title, l.author AS own_author,
 {_candidate_score_sql("c.", "l.title", "l.author", "c.source")} AS score FROM catalogue c JOIN library l USING (doc_id))"""
BEST = f"""best AS (SELECT * FROM scored WHERE score > 10 QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY score DESC, rank, record_id) = 1)"""
SCORED_VIEWS = sql.with_views(sql.LIBRARY, sql.CATALOGUE, SCORED)
BEST_VIEWS = sql.with_views(sql.LIBRARY, sql.CATALOGUE, SCORED, BEST)


def _candidates(spark, sf, similarity: str = "levenshtein") -> DataFrame:
    """Every catalogue record beside its document."""
    own = fx.library(spark, sf).select("doc_id", F.col("title").alias("own_title"), F.col("author").alias("own_author"))
    paired = fx.catalogue(spark, sf).join(own, "doc_id")
    score = scoring.candidate_score(F.col("source"), F.col, F.col("own_title"), F.col("own_author"), similarity)
    return paired.withColumn("score", score)


def _matches(spark, sf) -> DataFrame:
    """Best accepted candidate per document and source."""
    record = F.struct("rank", "record_id", *RECORD_FIELDS)
    order = F.struct((-F.col("score")).alias("s"), "rank", "record_id")
    return (
        _candidates(spark, sf)
        .groupBy("doc_id", "source")
        .agg(F.min_by(F.struct("score", record.alias("record")), order).alias("best"))
        .select("doc_id", "source", "best.score", "best.record")
        .filter(F.col("score") > resolve.MIN_SCORE)
    )


@query("score_candidates", SCORED_VIEWS + "SELECT record_id, source, round(score, 6) AS score FROM scored")
def _(spark, sf):
    return _candidates(spark, sf).select("record_id", "source", F.round("score", 6).alias("score"))


@query("score_candidates_ratio")
def _(spark, sf):
    return _candidates(spark, sf, "ratio").select("record_id", "source", F.round("score", 6).alias("score"))


@query(
    "score_metadata",
    CAT
    + f"""SELECT c.record_id, c.source, round({_metadata_score_sql("c.", "l.title", "l.author", "c.source")}, 6) AS score
 FROM catalogue c JOIN library l USING (doc_id)""",
)
def _(spark, sf):
    own = fx.library(spark, sf).select("doc_id", F.col("title").alias("own_title"), F.col("author").alias("own_author"))
    score = scoring.metadata_score(F.col("source"), F.col, F.col("own_title"), F.col("own_author"))
    return fx.catalogue(spark, sf).join(own, "doc_id").select("record_id", "source", F.round(score, 6).alias("score"))


@query("best_candidate", BEST_VIEWS + "SELECT doc_id, source, record_id, round(score, 6) AS score FROM best")
def _(spark, sf):
    return _matches(spark, sf).select("doc_id", "source", "record.record_id", F.round("score", 6).alias("score"))


# --- resolving --------------------------------------------------------------------------------

DOI_KEY_SQL = "lower(nullif(regexp_extract({0}, '10\\.\\d{{4,9}}/[-._;()/:a-zA-Z0-9]+'), ''))"
ISBN_KEY_SQL = "nullif(regexp_replace({0}, '[^0-9X]', '', 'g'), '')"
BY_DOI = f"""by_doi AS (SELECT l.doc_id, c.source, c.record_id FROM library l JOIN catalogue c
  ON {DOI_KEY_SQL.format("l.doi")} = {DOI_KEY_SQL.format("c.doi")} WHERE c.source IN ('crossref', 'openalex')
 QUALIFY row_number() OVER (PARTITION BY l.doc_id, c.source ORDER BY c.rank, c.record_id) = 1)"""
BY_ISBN = f"""by_isbn AS (SELECT l.doc_id, c.source, c.record_id FROM library l JOIN catalogue c
  ON {ISBN_KEY_SQL.format("l.isbn")} = {ISBN_KEY_SQL.format("c.isbn")} WHERE c.source IN ('googlebooks', 'openlib', 'k10plus')
 QUALIFY row_number() OVER (PARTITION BY l.doc_id, c.source ORDER BY c.rank, c.record_id) = 1)"""
WORDS_SQL = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"
PHRASE_SQL = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
BY_TITLE = f"""asked AS (SELECT doc_id, title, lower(title) AS t, author FROM library WHERE title <> ''),
records AS (SELECT *, lower(title) AS t FROM catalogue WHERE title <> ''),
lt AS (SELECT t, {WORDS_SQL.format("t")} AS w FROM (SELECT DISTINCT t FROM asked)),
rt AS (SELECT t, {WORDS_SQL.format("t")} AS w FROM (SELECT DISTINCT t FROM records)),
pairs AS (SELECT lt.t AS a, rt.t AS b, len(list_intersect(lt.w, rt.w)) AS s, len(lt.w) AS x, len(rt.w) AS y FROM lt, rt
  WHERE len(lt.w) >= 0.6 * len(rt.w) AND len(rt.w) >= 0.6 * len(lt.w) AND s > 0 AND s >= 0.6 * (x + y - s)
 UNION SELECT lt.t, rt.t, 0, 0, 0 FROM lt, rt WHERE len(lt.w) > 0 AND len(rt.w) > 0
  AND (contains(' ' || {PHRASE_SQL.format("rt.t")} || ' ', ' ' || {PHRASE_SQL.format("lt.t")} || ' ')
   OR contains(' ' || {PHRASE_SQL.format("lt.t")} || ' ', ' ' || {PHRASE_SQL.format("rt.t")} || ' '))),
title_pairs AS (SELECT DISTINCT a, b FROM pairs),
candidates AS (SELECT q.doc_id, r.source, r.record_id, r.rank,
  {_candidate_score_sql("r.", "q.title", "q.author", "r.source")} AS score
  FROM asked q JOIN title_pairs p ON p.a = q.t JOIN records r ON r.t = p.b
  WHERE q.author IS NULL OR len(list_filter(r.author, lambda x: CASE WHEN r.source = 'googlebooks' THEN lower(x) = lower(q.author[1])
    ELSE lower(string_split(x, ' ')[-1]) = lower(string_split(q.author[1], ' ')[-1]) END)) > 0),
by_title AS (SELECT * FROM candidates WHERE score > 10
 QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY score DESC, rank, record_id) = 1)"""


@query("resolve_doi", sql.with_views(sql.LIBRARY, sql.CATALOGUE, BY_DOI) + "SELECT * FROM by_doi")
def _(spark, sf):
    found = resolve.by_doi(fx.library(spark, sf), fx.catalogue(spark, sf))
    return found.select("doc_id", "source", "record.record_id")


@query("resolve_isbn", sql.with_views(sql.LIBRARY, sql.CATALOGUE, BY_ISBN) + "SELECT * FROM by_isbn")
def _(spark, sf):
    found = resolve.by_isbn(fx.library(spark, sf), fx.catalogue(spark, sf))
    return found.select("doc_id", "source", "record.record_id")


@query(
    "resolve_title",
    sql.with_views(sql.LIBRARY, sql.CATALOGUE, BY_TITLE) + "SELECT doc_id, source, record_id, round(score, 6) AS score FROM by_title",
)
def _(spark, sf):
    found = resolve.by_title(fx.library(spark, sf), fx.catalogue(spark, sf))
    return found.select("doc_id", "source", "record.record_id", F.round("score", 6).alias("score"))


@query(
    "resolve_all",
    sql.with_views(sql.LIBRARY, sql.CATALOGUE, BY_DOI, BY_ISBN, BY_TITLE)
    + """SELECT doc_id, source, 'doi' AS via, record_id FROM by_doi UNION ALL SELECT doc_id, source, 'isbn', record_id FROM by_isbn
 UNION ALL SELECT t.doc_id, t.source, 'title', t.record_id FROM by_title t JOIN library l USING (doc_id)
 WHERE CASE WHEN t.source IN ('crossref', 'openalex') THEN l.doi IS NULL WHEN t.source IN ('openlib', 'k10plus')
  THEN NOT EXISTS (SELECT 1 FROM by_isbn i WHERE i.doc_id = t.doc_id AND i.source = t.source) ELSE l.isbn IS NULL END""",
)
def _(spark, sf):
    found = resolve.resolve(fx.library(spark, sf), fx.catalogue(spark, sf))
    return found.select("doc_id", "source", "via", "record.record_id")


# --- enriching --------------------------------------------------------------------------------

_OWN = {"title", "author", "doi", "isbn", "page_count", "language"}
BASE = (
    "base AS (SELECT doc_id, "
    + ", ".join(n if n in _OWN else f"CAST(NULL AS {'INTEGER' if n == 'year' else 'BIGINT' if n == 'cited_by_count' else 'BOOLEAN' if n == 'is_open_access' else 'VARCHAR[]' if n == 'keywords' else 'VARCHAR'}) AS {n}" for n in RECORD_FIELDS)
    + " FROM library)"
)


def _present_sql(name: str, c: str) -> str:
    if name in LISTS:
        return f"coalesce(len({c}) > 0, false)"
    if name in ("year", "page_count", "cited_by_count"):
        return f"coalesce({c} <> 0, false)"
    if name == "is_open_access":
        return f"coalesce({c}, false)"
    return f"coalesce({c} <> '', false)"


def _weak_sql(name: str) -> str:
    sources = [s for s, names in enrich.WEAK_FIELDS.items() if name in names]
    return "source IN (" + ", ".join(f"'{s}'" for s in sources) + ")" if sources else "false"


MERGED = f"""rated AS (SELECT r.doc_id, r.source, {", ".join(f"r.{n} AS r_{n}" for n in RECORD_FIELDS)}, {", ".join(f"b.{n} AS b_{n}" for n in RECORD_FIELDS)},
  {_metadata_score_sql("r.", "b.title", "b.author", "r.source")} AS record_score FROM best r JOIN base b USING (doc_id)),
mixed AS (SELECT doc_id, source, record_score, b_title, b_author,
  {", ".join(f"CASE WHEN {_present_sql(n, f'r_{n}')} AND (record_score > 70 OR {_weak_sql(n)}) THEN r_{n} ELSE b_{n} END AS {n}" for n in RECORD_FIELDS)} FROM rated),
merged AS (SELECT *, {_metadata_score_sql("", "b_title", "b_author", "source")} AS score,
  list_position(['crossref', 'openlib', 'k10plus', 'googlebooks', 'openalex'], source) AS place FROM mixed)"""
TOP = "top AS (SELECT * FROM merged QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, place) = 1)"
_FIELD_PICKS = ", ".join(
    f"arg_min(CASE WHEN {_present_sql(n, n)} THEN {{'v': {n}, 's': score}} END, CASE WHEN {_present_sql(n, n)} THEN {{'s': -score, 'p': place}} END) AS {n}"
    for n in enrich.COMBINED_FIELDS
)
PICKS = f"picks AS (SELECT doc_id, {_FIELD_PICKS} FROM merged GROUP BY doc_id)"
_RESULT = ", ".join(
    f"CASE WHEN t.score > 70 THEN CASE WHEN {_present_sql(n, f't.{n}')} THEN t.{n} ELSE b.{n} END "
    + (f"WHEN p.{n}.v IS NOT NULL AND (p.{n}.s > 30 OR NOT {_present_sql(n, f'b.{n}')}) THEN p.{n}.v " if n in enrich.COMBINED_FIELDS else "")
    + f"ELSE b.{n} END AS {n}"
    for n in RECORD_FIELDS
)
RESULT = f"result AS (SELECT b.doc_id, t.source AS by_source, t.score, {_RESULT} FROM base b JOIN top t USING (doc_id) JOIN picks p USING (doc_id))"


def _filled_sql(prefix: str) -> str:
    return " + ".join(f"{_present_sql(n, prefix + n)}::INT" for n in RECORD_FIELDS)


MERGED_VIEWS = sql.with_views(sql.LIBRARY, sql.CATALOGUE, SCORED, BEST, BASE, MERGED)
RESULT_VIEWS = sql.with_views(sql.LIBRARY, sql.CATALOGUE, SCORED, BEST, BASE, MERGED, TOP, PICKS, RESULT)
_SHOWN = ["title", "author", "year", "publisher", "journal", "doi", "isbn", "issn", "page_count", "language", "keywords", "type"]


def _shown_sql(prefix: str) -> str:
    return ", ".join(f"array_to_string({prefix}{n}, '; ') AS {n}" if n in LISTS else f"{prefix}{n} AS {n}" for n in _SHOWN)


def _base(spark, sf) -> DataFrame:
    return fx.library(spark, sf).select("doc_id", "title", "author", "doi", "isbn", "page_count", "language")


def _merged(spark, sf) -> DataFrame:
    return enrich.per_source(_base(spark, sf), _matches(spark, sf))


@query(
    "enrich_source",
    MERGED_VIEWS + f"SELECT doc_id, source, round(record_score, 6) AS record_score, round(score, 6) AS score, {_shown_sql('')} FROM merged",
)
def _(spark, sf):
    merged = _merged(spark, sf)
    return _flat(
        merged.select("doc_id", "source", F.round("record_score", 6).alias("record_score"), F.round("score", 6).alias("score"), *[f"merged.{n}" for n in _SHOWN])
    )


@query(
    "best_source",
    sql.with_views(sql.LIBRARY, sql.CATALOGUE, SCORED, BEST, BASE, MERGED, TOP) + "SELECT doc_id, source, round(score, 6) AS score FROM top",
)
def _(spark, sf):
    return enrich.best_source(_merged(spark, sf)).select("doc_id", "source", F.round("score", 6).alias("score"))


@query(
    "best_field_value",
    sql.with_views(sql.LIBRARY, sql.CATALOGUE, SCORED, BEST, BASE, MERGED, PICKS)
    + "SELECT doc_id, "
    + ", ".join(f"array_to_string({n}.v, '; ') AS {n}" if n in LISTS else f"{n}.v AS {n}" for n in enrich.COMBINED_FIELDS)
    + " FROM picks",
)
def _(spark, sf):
    found = enrich.best_fields(_merged(spark, sf))
    return _flat(found.select("doc_id", *[F.col(f"field_{n}.value").alias(n) for n in enrich.COMBINED_FIELDS]))


@query("enrich_best", RESULT_VIEWS + f"SELECT doc_id, by_source AS enriched_by, {_shown_sql('r.')} FROM result r JOIN base b USING (doc_id) WHERE score > 70 AND {_filled_sql('r.')} > {_filled_sql('b.')}")
def _(spark, sf):
    done = enrich.enrich(_base(spark, sf), _merged(spark, sf))
    return _flat(done.filter("enriched_by <> 'combined'").select("doc_id", "enriched_by", *_SHOWN))


@query("enrich_combine", RESULT_VIEWS + f"SELECT doc_id, 'combined' AS enriched_by, {_shown_sql('r.')} FROM result r JOIN base b USING (doc_id) WHERE score <= 70 AND {_filled_sql('r.')} > {_filled_sql('b.')}")
def _(spark, sf):
    done = enrich.enrich(_base(spark, sf), _merged(spark, sf))
    return _flat(done.filter("enriched_by = 'combined'").select("doc_id", "enriched_by", *_SHOWN))


@query(
    "enrich_gate",
    RESULT_VIEWS
    + f"""SELECT b.doc_id, coalesce({_filled_sql('r.')} > {_filled_sql('b.')}, false) AS changed,
 CASE WHEN {_filled_sql('r.')} > {_filled_sql('b.')} THEN r.title ELSE b.title END AS title FROM base b LEFT JOIN result r USING (doc_id)""",
)
def _(spark, sf):
    done = enrich.enrich(_base(spark, sf), _merged(spark, sf))
    return done.select("doc_id", F.col("enriched_by").isNotNull().alias("changed"), "title")


RESOLVED = """resolved AS (SELECT doc_id, source, record_id FROM by_doi UNION ALL SELECT doc_id, source, record_id FROM by_isbn
 UNION ALL SELECT t.doc_id, t.source, t.record_id FROM by_title t JOIN library l USING (doc_id)
 WHERE CASE WHEN t.source IN ('crossref', 'openalex') THEN l.doi IS NULL WHEN t.source IN ('openlib', 'k10plus')
  THEN NOT EXISTS (SELECT 1 FROM by_isbn i WHERE i.doc_id = t.doc_id AND i.source = t.source) ELSE l.isbn IS NULL END)"""
FOUND = "best AS (SELECT r.doc_id, c.* EXCLUDE (doc_id) FROM resolved r JOIN catalogue c USING (record_id))"


@query(
    "resolve_and_enrich",
    sql.with_views(sql.LIBRARY, sql.CATALOGUE, BY_DOI, BY_ISBN, BY_TITLE, RESOLVED, FOUND, BASE, MERGED, TOP, PICKS, RESULT)
    + f""", gated AS (SELECT r.* FROM result r JOIN base b USING (doc_id) WHERE {_filled_sql('r.')} > {_filled_sql('b.')})
 SELECT doc_id, CASE WHEN score > 70 THEN by_source ELSE 'combined' END AS enriched_by, {_shown_sql('')} FROM gated
 UNION ALL SELECT doc_id, NULL, {_shown_sql('')} FROM base WHERE doc_id NOT IN (SELECT doc_id FROM gated)""",
)
def _(spark, sf):
    """Resolve against the catalogue and enrich, end to end."""
    base = _base(spark, sf)
    matches = resolve.resolve(base, fx.catalogue(spark, sf))
    return _flat(enrich.enrich(base, enrich.per_source(base, matches)).select("doc_id", "enriched_by", *_SHOWN))


@query("process_documents")
def _(spark, sf):
    """Whole documents through extraction, catalogue look-up, enrichment and chunking."""
    own = fx.library(spark, sf).select("doc_id", "id", "filename", "doi", "isbn")
    docs = fx.table(spark, sf, "documents").select("doc_id", "text").join(own, "doc_id").drop("doc_id")
    done = processing.process(docs, fx.catalogue(spark, sf).drop("doc_id"))
    return done.library.select("id", "title", "language", "year", "publisher", "file_type", "page_count", "enriched_by", "chunks_count")


@query(
    "reprocess",
    recursive_cut().rstrip()
    + f""", counted AS (SELECT doc_id, count(*) AS n FROM recursive_chunks GROUP BY doc_id), filled AS ({ORACLES["fill_missing"]}),
 own AS ({sql.with_views(sql.LIBRARY)} SELECT * FROM library), {sql.DELETE_IDS}
 SELECT o.doc_id AS id, o.filename, CASE WHEN d.doc_id IS NULL THEN o.title ELSE f.title END AS title,
  CASE WHEN d.doc_id IS NULL THEN array_to_string(o.author, '; ') ELSE f.author END AS author,
  CASE WHEN d.doc_id IS NULL THEN o.page_count ELSE f.page_count END AS page_count,
  CASE WHEN d.doc_id IS NULL THEN -1 ELSE coalesce(n, 0) END AS chunks_count, d.doc_id IS NOT NULL AS updated
 FROM own o JOIN filled f USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM delete_ids) d USING (doc_id) LEFT JOIN counted USING (doc_id)""",
)
def _(spark, sf):
    """Listed documents through the pipeline again, from what the reader left; the others stay as they are stored."""
    lib = fx.library(spark, sf).withColumnRenamed("id", "name").withColumn("id", F.col("doc_id"))
    stored = lib.select("id", "filename", "title", "author", "page_count", F.lit(-1).cast("bigint").alias("chunks_count"), "added_at", F.col("added_at").alias("updated_at"))
    keep = F.col("journal").isNotNull()
    read = lib.select(
        "id", "filename", "author", F.when(keep, F.col("title")).alias("title"),
        F.when(F.col("language") != "es", F.col("language")).alias("language"), F.when(keep, F.col("page_count")).alias("page_count"),
    )
    texts = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    ids = fx.delete_ids(spark, sf).select(F.col("doc_id").alias("id"))
    again = processing.reprocess(read.join(texts, "id"), ids)
    merged = mutate.upsert(stored, again.library, F.lit("2030-01-01 00:00:00").cast("timestamp_ntz"))
    updated = (F.col("updated_at") > F.col("added_at")).alias("updated")
    return merged.select("id", "filename", "title", F.array_join("author", "; ").alias("author"), "page_count", "chunks_count", updated)
