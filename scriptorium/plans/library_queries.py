"""Filters, listings, statistics and table changes over the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import lines as text_lines
from scriptorium.functions.text import (
    display_time,
    extension,
    file_type_label,
    language_label,
    page_estimate,
    reader_for,
)
from scriptorium.operators import filters, listing, mutate, stats
from scriptorium.operators.search import year_facet
from scriptorium.plans import fixtures as fx
from scriptorium.plans import fixture_sql as sql
from scriptorium.plans.registry import query

LIB = sql.with_views(sql.LIBRARY)
LIB_CHUNKS = sql.with_views(sql.LIBRARY, sql.CHUNKS)


def _sql_or(*conditions: str) -> str:
    return "(" + " OR ".join(f"coalesce({c}, false)" for c in conditions) + ")"


AUTHOR_HAS = "len(list_filter(author, lambda a: contains(lower(a), '{0}'))) > 0"
SUFFIX = "lower(regexp_extract(filename, '^.+(\\.[^./]+)$', 1))"


@query("filter_author", LIB + f"SELECT doc_id, id FROM library WHERE {AUTHOR_HAS.format('grace')}")
def _(spark, sf):
    return fx.library(spark, sf).filter(filters.author_contains("Grace")).select("doc_id", "id")


@query("filter_year_range", LIB + "SELECT doc_id, year FROM library WHERE year BETWEEN 1995 AND 2010")
def _(spark, sf):
    return fx.library(spark, sf).filter(filters.year_between(1995, "2010")).select("doc_id", "year")


@query(
    "filter_source",
    LIB
    + "SELECT doc_id, source FROM library WHERE "
    + _sql_or("contains(lower(journal), 'src1')", "contains(lower(publisher), 'src1')", "contains(lower(source), 'src1')"),
)
def _(spark, sf):
    return fx.library(spark, sf).filter(filters.source_contains("SRC1")).select("doc_id", "source")


@query(
    "filter_document",
    LIB + "SELECT id, title FROM library WHERE id = (SELECT min(id) FROM library WHERE language = 'de')",
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    wanted = lib.filter("language = 'de'").agg(F.min("id").alias("id"))
    return lib.join(F.broadcast(wanted), "id", "left_semi").select("id", "title")


@query(
    "filter_exact",
    LIB + "SELECT doc_id, type, language, year FROM library WHERE year = 2000 AND language = 'en'",
)
def _(spark, sf):
    keep = filters.exact_filter({"year": "2000", "type": "", "language": "en"})
    return fx.library(spark, sf).filter(keep).select("doc_id", "type", "language", "year")


@query(
    "metadata_search",
    LIB
    + "SELECT doc_id, title FROM library WHERE "
    + _sql_or("contains(lower(title), 'on')", AUTHOR_HAS.format("on"), "contains(lower(journal), 'on')", "contains(lower(publisher), 'on')"),
)
def _(spark, sf):
    return filters.metadata_search(fx.library(spark, sf), "On").select("doc_id", "title")


@query(
    "metadata_search_filtered",
    LIB
    + "SELECT doc_id, title FROM library WHERE type = 'article' AND "
    + _sql_or("contains(lower(title), 'src')", AUTHOR_HAS.format("src"), "contains(lower(journal), 'src')", "contains(lower(publisher), 'src')"),
)
def _(spark, sf):
    return filters.metadata_search(fx.library(spark, sf), "src", {"type": "article"}).select("doc_id", "title")


@query(
    "irrelevant_lines",
    sql.with_views(sql.LINES)
    + "SELECT doc_id, line_no, line FROM lines WHERE regexp_matches(line, '(?i)"
    + "|".join(f"(?:{p})" for p in text_lines.IRRELEVANT_PATTERNS)
    + "')",
)
def _(spark, sf):
    return fx.lines(spark, sf).filter(text_lines.is_irrelevant(F.col("line"))).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line"
    )


@query(
    "header_footer",
    sql.with_views(sql.LINES)
    + "SELECT doc_id, CAST(count(*) AS BIGINT) AS body_lines FROM lines WHERE NOT regexp_matches(line, '(?i)"
    + "|".join(f"(?:{p})" for p in text_lines.HEADER_FOOTER_PATTERNS)
    + "') GROUP BY doc_id",
)
def _(spark, sf):
    body = fx.lines(spark, sf).filter(~text_lines.is_header_footer(F.col("line")))
    return body.groupBy("doc_id").agg(F.count("*").alias("body_lines"))


@query(
    "document_lookup",
    LIB
    + """SELECT r.id, coalesce(title, '') AS title, coalesce(journal, '') AS journal, year, title IS NOT NULL AS found
 FROM (SELECT id FROM library WHERE doc_id IN (SELECT doc_id FROM labels)
       UNION ALL SELECT 'missing-' || item_id FROM benchmark) r LEFT JOIN library USING (id)""",
)
def _(spark, sf):
    known = fx.index_subset(spark, sf).select("id")
    unknown = fx.table(spark, sf, "benchmark").select(F.concat(F.lit("missing-"), "item_id").alias("id"))
    found = filters.lookup(fx.library(spark, sf), known.unionByName(unknown))
    return found.select("id", "title", "journal", "year", "found")


@query(
    "chunk_filter",
    sql.with_views(sql.CHUNKS) + "SELECT doc_id, chunk_id FROM chunks WHERE contains(lower(text), 'thinor')",
)
def _(spark, sf):
    return fx.chunks(spark, sf).filter(filters.chunk_contains("Thinor")).select("doc_id", "chunk_id")


@query(
    "list_filters",
    LIB
    + f"""SELECT doc_id, type, year FROM library WHERE year < 2020 AND NOT type IN ('article', 'book', 'thesis')
 AND {_sql_or("contains(lower(title), 'e')", AUTHOR_HAS.format("e"))}""",
)
def _(spark, sf):
    keep = filters.list_filter("E", "older", "other")
    return fx.library(spark, sf).filter(keep).select("doc_id", "type", "year")


@query("needs_ocr", "SELECT doc_id, length(trim(text)) < 100 AS needs_ocr FROM documents")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", filters.needs_ocr(F.col("text")).alias("needs_ocr"))


@query(
    "upload_accept",
    LIB
    + f"SELECT doc_id, filename, {SUFFIX} IN ('.pdf', '.docx', '.epub', '.pptx', '.txt') AND file_size <= 5000 AS accepted FROM library",
)
def _(spark, sf):
    lib = fx.library(spark, sf)
    accepted = filters.upload_accepted(F.col("filename"), F.col("file_size"), 5000)
    return lib.select("doc_id", "filename", accepted.alias("accepted"))


@query("page_estimate", "SELECT doc_id, CAST(greatest(1, length(text) // 2000) AS BIGINT) AS page_count FROM documents")
def _(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", page_estimate(F.col("text")).alias("page_count"))


@query(
    "format_route",
    LIB
    + f"""SELECT filename, {SUFFIX} AS extension, CASE {SUFFIX} WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx'
 WHEN '.epub' THEN 'epub' WHEN '.pptx' THEN 'pptx' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'text'
 WHEN '.csv' THEN 'text' END AS reader
 FROM (SELECT filename FROM library UNION ALL SELECT 'img' || page_id || '.PNG' FROM pages)""",
)
def _(spark, sf):
    others = fx.table(spark, sf, "pages").select(F.concat(F.lit("img"), "page_id", F.lit(".PNG")).alias("filename"))
    names = fx.library(spark, sf).select("filename").unionByName(others)
    name = F.col("filename")
    return names.select("filename", extension(name).alias("extension"), reader_for(name).alias("reader"))


LISTING_SQL = """SELECT doc_id, CASE WHEN title <> '' THEN title ELSE filename END AS title,
 array_to_string(coalesce(author, ['Unbekannt']), '; ') AS author,
 coalesce(CAST(year AS VARCHAR), 'Unbekannt') AS year, coalesce(journal, publisher, 'Unbekannt') AS source FROM library"""


@query("library_listing", LIB + LISTING_SQL)
def _(spark, sf):
    lib = fx.library(spark, sf).withColumn("source", F.lit(None).cast("string"))
    return listing.listing(lib).select("doc_id", "title", F.array_join("author", "; ").alias("author"), "year", "source")


LABEL_SQL = """CASE WHEN concat_ws(' ', CASE len(author) WHEN 1 THEN author[1]
   WHEN 2 THEN author[1] || ' & ' || author[2] ELSE author[1] || ' et al.' END,
  '(' || year || ')', nullif(concat_ws(': ', nullif(title, ''), coalesce(journal, publisher)), '')) = ''
 THEN 'Unbekannte Quelle' ELSE concat_ws(' ', CASE len(author) WHEN 1 THEN author[1]
   WHEN 2 THEN author[1] || ' & ' || author[2] ELSE author[1] || ' et al.' END,
  '(' || year || ')', nullif(concat_ws(': ', nullif(title, ''), coalesce(journal, publisher)), '')) END"""


@query("source_label", LIB + f"SELECT doc_id, {LABEL_SQL} AS label FROM library")
def _(spark, sf):
    return fx.library(spark, sf).select("doc_id", listing.source_label().alias("label"))


@query(
    "recent_documents",
    LIB
    + """SELECT id, title, coalesce(array_to_string(author, ', '), '') AS authors,
 coalesce(journal, publisher, '') || coalesce(', ' || year, '') AS place
 FROM library ORDER BY added_at DESC, id LIMIT 4""",
)
def _(spark, sf):
    return listing.recent(listing.card_line(fx.library(spark, sf))).select("id", "title", "authors", "place")


@query(
    "recent_searches",
    sql.with_views(sql.SEARCH_LOG)
    + "SELECT user_id, search_type, query FROM search_log ORDER BY ts DESC, event_id DESC LIMIT 5",
)
def _(spark, sf):
    return listing.recent_searches(fx.search_log(spark, sf)).select("user_id", "search_type", "query")


_SORTS = {
    "added": "added_at DESC, id", "title": "title ASC NULLS LAST, id",
    "author": "author[1] ASC NULLS LAST, id", "year": "year DESC NULLS LAST, id",
}


def _register_order(by: str, order: str) -> None:
    @query(f"list_sorted_{by}", LIB + f"SELECT id, title, author[1] AS first_author, year FROM library ORDER BY {order}")
    def _(spark, sf):
        listed = listing.sort_listing(fx.library(spark, sf), by)
        return listed.select("id", "title", F.get("author", F.lit(0)).alias("first_author"), "year")


for _by, _order in _SORTS.items():
    _register_order(_by, _order)


@query(
    "document_status",
    LIB.rstrip()
    + ", "
    + sql.INDEX_SUBSET
    + """
 SELECT r.id, CASE WHEN i.id IS NOT NULL OR m.id IS NOT NULL THEN 'complete' ELSE 'processing' END AS status,
  m.id IS NOT NULL AND i.id IS NULL AS reload
 FROM (SELECT id FROM library UNION ALL SELECT 'new-' || item_id FROM benchmark) r
 LEFT JOIN (SELECT id FROM index_subset) i USING (id) LEFT JOIN (SELECT id FROM library) m USING (id)""",
)
def _(spark, sf):
    lib = fx.library(spark, sf).select("id")
    fresh = fx.table(spark, sf, "benchmark").select(F.concat(F.lit("new-"), "item_id").alias("id"))
    return listing.document_status(lib.unionByName(fresh), fx.index_subset(spark, sf), lib)


@query(
    "library_totals",
    LIB_CHUNKS
    + """SELECT CAST(count(*) AS BIGINT) AS total_documents, CAST(sum(page_count) AS BIGINT) AS total_pages,
 CAST((SELECT count(*) FROM chunks) AS BIGINT) AS total_chunks FROM library""",
)
def _(spark, sf):
    return stats.library_totals(fx.library(spark, sf), stats.chunk_counts(fx.chunks(spark, sf)))


FILE_TYPES_SQL = f"SELECT {SUFFIX} AS file_type, count(*) AS documents FROM library GROUP BY 1"
YEARS_SQL = "SELECT CAST(year AS VARCHAR) AS year, count(*) AS documents FROM library WHERE year IS NOT NULL GROUP BY 1"
LANGUAGES_SQL = "SELECT language, count(*) AS documents FROM library GROUP BY 1"


@query("stats_file_types", LIB + FILE_TYPES_SQL)
def _(spark, sf):
    return stats.file_types(fx.library(spark, sf))


@query("stats_years", LIB + YEARS_SQL)
def _(spark, sf):
    return stats.years(fx.library(spark, sf))


@query("stats_languages", LIB + LANGUAGES_SQL)
def _(spark, sf):
    return stats.languages(fx.library(spark, sf))


@query(
    "stats_grouping_sets",
    LIB
    + f"""SELECT 'file_type' AS facet, file_type AS value, documents FROM ({FILE_TYPES_SQL})
 UNION ALL SELECT 'year', year, documents FROM ({YEARS_SQL})
 UNION ALL SELECT 'language', language, documents FROM ({LANGUAGES_SQL})""",
)
def _(spark, sf):
    return stats.histograms(fx.library(spark, sf))


@query(
    "storage_used",
    """WITH t AS (SELECT CAST(sum(n_chars) AS BIGINT) AS b FROM documents)
 SELECT b AS total_bytes, CASE WHEN b < 1024 THEN printf('%.2f B', b::DOUBLE)
  WHEN b < 1024 ** 2 THEN printf('%.2f KB', b / 1024.0::DOUBLE)
  WHEN b < 1024 ** 3 THEN printf('%.2f MB', b / (1024.0::DOUBLE ** 2))
  ELSE printf('%.2f GB', b / (1024.0::DOUBLE ** 3)) END AS storage_used FROM t""",
)
def _(spark, sf):
    return stats.storage_used(fx.table(spark, sf, "documents"), "n_chars")


@query(
    "chunk_counts",
    sql.with_views(sql.CHUNKS) + "SELECT doc_id, count(*) AS chunks_count FROM chunks GROUP BY doc_id",
)
def _(spark, sf):
    return stats.chunk_counts(fx.chunks(spark, sf))


@query("year_facet", LIB + "SELECT DISTINCT year FROM library WHERE year IS NOT NULL")
def _(spark, sf):
    return year_facet(fx.library(spark, sf))


@query(
    "format_added_at", LIB + "SELECT doc_id, strftime(added_at, '%Y-%m-%d %H:%M:%S') AS added FROM library"
)
def _(spark, sf):
    return fx.library(spark, sf).select("doc_id", display_time(F.col("added_at")).alias("added"))


@query(
    "display_labels",
    LIB
    + f"""SELECT doc_id, CASE language WHEN 'de' THEN 'Deutsch' WHEN 'en' THEN 'Englisch' ELSE language END AS language,
 upper(substr({SUFFIX}, 2)) AS file_type FROM library""",
)
def _(spark, sf):
    return fx.library(spark, sf).select(
        "doc_id",
        language_label(F.col("language")).alias("language"),
        file_type_label(F.col("filename")).alias("file_type"),
    )


_ROW_FIELDS = {
    "title": "title", "author": "array_to_string(author, ', ')", "year": "CAST(year AS VARCHAR)",
    "language": "language", "journal": "journal", "publisher": "publisher",
    "publisher_location": "publisher_location", "volume": "volume", "issue": "issue", "pages": "pages",
    "doi": "doi", "isbn": "isbn", "type": "type", "page_count": "CAST(page_count AS VARCHAR)",
    "filename": "filename", "file_size": "CAST(file_size AS VARCHAR)", "source": "source",
}


@query(
    "metadata_rows",
    LIB
    + "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, {v} AS value FROM library" for k, v in _ROW_FIELDS.items())
    + ") WHERE value IS NOT NULL",
)
def _(spark, sf):
    return listing.metadata_rows(fx.library(spark, sf), "doc_id")


# --- table changes ---------------------------------------------------------------------------

UPSERT_SQL = """SELECT coalesce(o.id, n.id) AS id, coalesce(o.filename, n.filename) AS filename,
 coalesce(n.title, o.title) AS title, CAST(coalesce(o.added_at, TIMESTAMP '2030-01-01') AS VARCHAR) AS added_at,
 CAST(CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE o.added_at END AS VARCHAR) AS updated_at
 FROM (SELECT * FROM index_subset) o FULL OUTER JOIN
  (SELECT id, 'copy-' || filename AS filename, 'New ' || title AS title FROM library WHERE language <> 'en') n ON o.id = n.id"""


@query("library_upsert", sql.with_views(sql.LIBRARY, sql.INDEX_SUBSET) + UPSERT_SQL)
def _(spark, sf):
    columns = ["id", "filename", "title", "added_at", F.col("added_at").alias("updated_at")]
    stored = fx.index_subset(spark, sf).select(*columns)
    incoming = fx.library(spark, sf).filter("language <> 'en'").select(
        "id", F.concat(F.lit("copy-"), "filename").alias("filename"), F.concat(F.lit("New "), "title").alias("title")
    )
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    merged = mutate.upsert(stored, incoming, now)
    return merged.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("added_at", "updated_at")})


PATCH_SQL = """SELECT doc_id, coalesce(p.title, l.title) AS title,
 array_to_string(coalesce(CASE WHEN p.authors IS NOT NULL THEN list_transform(string_split(p.authors, ','), lambda a: trim(a)) END, l.author), '; ') AS author,
 coalesce(CAST(p.year AS INTEGER), l.year) AS year FROM library l LEFT JOIN patches p USING (doc_id)"""


@query("metadata_patch", sql.with_views(sql.LIBRARY, sql.PATCHES) + PATCH_SQL)
def _(spark, sf):
    changes = mutate.form_patch(fx.patches(spark, sf), "doc_id")
    patched = mutate.patch(fx.library(spark, sf), changes, "doc_id")
    return patched.select("doc_id", "title", F.array_join("author", "; ").alias("author"), "year")


@query(
    "delete_cascade",
    sql.with_views(sql.LIBRARY, sql.CHUNKS, sql.DELETE_IDS)
    + """SELECT 'library' AS table_name, doc_id, CAST(1 AS BIGINT) AS n FROM library WHERE doc_id NOT IN (SELECT doc_id FROM delete_ids)
 UNION ALL SELECT 'chunks', doc_id, count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM delete_ids) GROUP BY doc_id""",
)
def _(spark, sf):
    tables = {"library": fx.library(spark, sf), "chunks": fx.chunks(spark, sf)}
    kept = mutate.delete(tables, fx.delete_ids(spark, sf), "doc_id")
    counted = [
        df.groupBy(F.lit(name).alias("table_name"), "doc_id").agg(F.count("*").alias("n")) for name, df in kept.items()
    ]
    return counted[0].unionByName(counted[1])


@query(
    "recover_missing",
    sql.with_views(sql.LIBRARY, sql.INDEX_SUBSET)
    + """SELECT id, filename, false AS recovered FROM index_subset UNION ALL
 SELECT id, filename, true FROM library WHERE doc_id NOT IN (SELECT doc_id FROM index_subset)""",
)
def _(spark, sf):
    return mutate.recover(fx.index_subset(spark, sf), fx.library(spark, sf)).select("id", "filename", "recovered")


REVIEW_SQL = """SELECT doc_id, coalesce(p.title, l.title) AS title, coalesce(CAST(p.year AS INTEGER), l.year) AS year
 FROM library l LEFT JOIN patches p USING (doc_id) WHERE l.file_size >= 100"""


@query("review_apply", sql.with_views(sql.LIBRARY, sql.PATCHES) + REVIEW_SQL)
def _(spark, sf):
    staged = fx.library(spark, sf).withColumn("status", F.when(F.col("file_size") < 100, "failed").otherwise("extracted"))
    confirmed = mutate.form_patch(fx.patches(spark, sf).drop("authors"), "doc_id")
    return mutate.apply_review(staged, confirmed, "doc_id").select("doc_id", "title", "year")


@query(
    "metadata_override",
    sql.with_views(sql.LIBRARY, sql.PATCHES)
    + """SELECT doc_id, coalesce(p.title, l.title) AS title, coalesce(CAST(p.year AS INTEGER), l.year) AS year
 FROM library l LEFT JOIN patches p USING (doc_id)""",
)
def _(spark, sf):
    override = mutate.form_patch(fx.patches(spark, sf).drop("authors"), "doc_id")
    return mutate.patch(fx.library(spark, sf), override, "doc_id").select("doc_id", "title", "year")


@query(
    "reprocess_selection",
    sql.with_views(sql.DELETE_IDS) + "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM delete_ids)",
)
def _(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return mutate.select_for_reprocessing(docs, fx.delete_ids(spark, sf), "doc_id").select("doc_id", "n_chars")
