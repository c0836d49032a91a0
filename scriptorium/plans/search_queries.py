"""Search, question context and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import cite
from scriptorium.operators import context, search
from scriptorium.plans import fixtures as fx
from scriptorium.plans import fixture_sql as sql
from scriptorium.plans.library_queries import LABEL_SQL
from scriptorium.plans.registry import query

VIEWS = sql.with_views(sql.LIBRARY, sql.CHUNKS)
LIB = sql.with_views(sql.LIBRARY)
QUERY = "the thinor and quevi"
FILTERS = {"author": "lovelace", "year_min": "1995", "source": "src"}
QUESTION = "was ist das thinor and the"


def _relevance_sql(text: str) -> str:
    terms = text.lower().split()
    return "(" + " + ".join(f"contains(lower(text), '{t}')::INT" for t in terms) + f") / {len(terms)}::DOUBLE"


def _hits_sql(text: str, k: int, where: str = "true") -> str:
    return f"""SELECT doc_id, id, chunk_id, relevance, text, title, author, year, journal, publisher, added_at FROM
 (SELECT *, {_relevance_sql(text)} AS relevance FROM chunks) JOIN library USING (doc_id)
 WHERE relevance > 0 AND {where} ORDER BY relevance DESC, added_at, id, chunk_id LIMIT {k}"""


WHERE = """len(list_filter(author, lambda a: contains(lower(a), 'lovelace'))) > 0 AND year >= 1995 AND
 (coalesce(contains(lower(journal), 'src'), false) OR coalesce(contains(lower(publisher), 'src'), false)
  OR contains(lower(source), 'src'))"""
HIT_COLUMNS = ["id", "chunk_id", "relevance", "text", "source_label", "relevance_pct"]
HIT_SQL = f"SELECT id, chunk_id, relevance, text, {LABEL_SQL} AS source_label, CAST(round(relevance * 100) AS BIGINT) AS relevance_pct"


@query("keyword_search", VIEWS + f"{HIT_SQL} FROM ({_hits_sql(QUERY, 10, WHERE)})")
def _(spark, sf):
    hits = search.keyword_search(fx.library(spark, sf), fx.search_index(spark, sf), QUERY, FILTERS)
    return hits.select(*HIT_COLUMNS)


@query("keyword_search_scan", VIEWS + f"{HIT_SQL} FROM ({_hits_sql(QUERY, 10, WHERE)})")
def _(spark, sf):
    hits = search.keyword_search(fx.library(spark, sf), fx.chunks(spark, sf), QUERY, FILTERS)
    return hits.select(*HIT_COLUMNS)


@query("semantic_search", VIEWS + f"{HIT_SQL} FROM ({_hits_sql(QUERY, 20)})")
def _(spark, sf):
    hits = search.semantic_search(fx.library(spark, sf), fx.search_index(spark, sf), QUERY, k=20)
    return hits.select(*HIT_COLUMNS)


@query(
    "search_sorted_by_year",
    VIEWS
    + f"""SELECT id, chunk_id, year, row_number() OVER (ORDER BY coalesce(year, 0) DESC, relevance DESC, added_at, id, chunk_id)
 AS position FROM ({_hits_sql(QUERY, 10)})""",
)
def _(spark, sf):
    hits = search.keyword_search(fx.library(spark, sf), fx.search_index(spark, sf), QUERY)
    ordered = search.sort_hits(hits, "date-desc")
    # Ten rows: their position shows the order.
    listed = ordered.groupBy().agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.coalesce("year", F.lit(0))).alias("y"), (-F.col("relevance")).alias("r"), "added_at", "id", "chunk_id", "year"
                )
            )
        ).alias("hits")
    )
    return listed.select(F.posexplode("hits").alias("p", "h")).select(
        "h.id", "h.chunk_id", "h.year", (F.col("p") + 1).cast("bigint").alias("position")
    )


@query(
    "batch_search",
    sql.with_views(sql.CHUNKS, sql.QUERY_SET)
    + """, terms AS (SELECT query_id, unnest(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '')) AS term FROM query_set),
 counted AS (SELECT query_id, term, count(*) AS times FROM terms GROUP BY ALL),
 sizes AS (SELECT query_id, sum(times) AS n FROM counted GROUP BY ALL),
 hits AS (SELECT query_id, doc_id, chunk_id, sum(times) AS m FROM counted, chunks WHERE contains(lower(text), term) GROUP BY ALL)
 SELECT query_id, doc_id, chunk_id, m::DOUBLE / n::DOUBLE AS relevance,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY m DESC, doc_id, chunk_id) AS INTEGER) AS rank
 FROM hits JOIN sizes USING (query_id) QUALIFY rank <= 10""",
)
def _(spark, sf):
    return search.batch_search(fx.chunks(spark, sf), fx.query_set(spark, sf))


@query(
    "batch_search_words",
    sql.with_views(sql.CHUNKS, sql.QUERY_SET)
    + """, terms AS (SELECT query_id, unnest(list_filter(string_split_regex(lower(query), '\\s+'), lambda w: w <> '')) AS term FROM query_set),
 counted AS (SELECT query_id, term, count(*) AS times FROM terms GROUP BY ALL),
 sizes AS (SELECT query_id, sum(times) AS n FROM counted GROUP BY ALL),
 postings AS (SELECT DISTINCT doc_id, chunk_id, unnest(string_split_regex(lower(text), '\\s+')) AS term FROM chunks),
 hits AS (SELECT query_id, doc_id, chunk_id, sum(times) AS m FROM counted JOIN postings USING (term) GROUP BY ALL)
 SELECT query_id, doc_id, chunk_id, m::DOUBLE / n::DOUBLE AS relevance,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY m DESC, doc_id, chunk_id) AS INTEGER) AS rank
 FROM hits JOIN sizes USING (query_id) QUALIFY rank <= 10""",
)
def _(spark, sf):
    return search.batch_search(fx.chunks(spark, sf), fx.query_set(spark, sf), mode="word")


# --- question context ------------------------------------------------------------------------

CONTEXT_SQL = f"""context AS (SELECT CAST(row_number() OVER (ORDER BY relevance DESC, added_at, id, chunk_id) AS INTEGER) AS source_no,
 doc_id, id, chunk_id, relevance, text, coalesce(author, ['Unbekannt']) AS author,
 coalesce(CAST(year AS VARCHAR), 'n.d.') AS year, coalesce(title, 'Unbekanntes Dokument') AS title
 FROM ({_hits_sql(QUESTION, 5)}))"""


def _context(spark, sf):
    return context.question_context(fx.library(spark, sf), fx.search_index(spark, sf), QUESTION)


@query(
    "qa_context",
    sql.with_views(sql.LIBRARY, sql.CHUNKS, CONTEXT_SQL)
    + "SELECT source_no, id, chunk_id, text, array_to_string(author, '; ') AS author, year, title, '' AS page FROM context",
)
def _(spark, sf):
    return _context(spark, sf).select(
        "source_no", "id", "chunk_id", "text", F.array_join("author", "; ").alias("author"), "year", "title", "page"
    )


@query(
    "qa_prompt",
    sql.with_views(sql.LIBRARY, sql.CHUNKS, CONTEXT_SQL)
    + f"""SELECT CAST(count(*) AS BIGINT) AS n_sources, '{context.INSTRUCTION}' || chr(10) || chr(10) || chr(10) || '### Quellen:' || chr(10) || chr(10)
 || string_agg('[' || source_no || '] ' || array_to_string(author[1:3], ', ') || CASE WHEN len(author) > 3 THEN ' et al.' ELSE '' END
  || ' (' || year || ')' || CASE WHEN title <> '' THEN ': ' || title ELSE '' END || chr(10)
  || CASE WHEN length(b) > 1000 THEN substr(b, 1, 997) || '...' ELSE b END || chr(10), chr(10) ORDER BY source_no)
 || chr(10) || chr(10) || '### Frage:' || chr(10) || '{QUESTION}' || chr(10) || chr(10) || '### Antwort:' || chr(10) AS prompt
 FROM (SELECT *, trim(text, ' ' || chr(10) || chr(9)) AS b FROM context)""",
)
def _(spark, sf):
    return context.prompt(_context(spark, sf), QUESTION).select("n_sources", "prompt")


# --- citations -------------------------------------------------------------------------------

def _last(name: str) -> str:
    return f"string_split_regex({name}, '\\s+')[-1]"


def _first(name: str) -> str:
    return f"array_to_string(string_split_regex({name}, '\\s+')[1:-2], ' ')"


def _single(name: str) -> str:
    return f"len(string_split_regex({name}, '\\s+')) = 1"


def _inits(name: str, glue: str) -> str:
    return f"array_to_string(list_transform(string_split_regex({name}, '\\s+')[1:-2], lambda p: p[1] || '.'), '{glue}')"


LAST_FIRST = f"CASE WHEN {_single('author[1]')} THEN author[1] ELSE {_last('author[1]')} || ', ' || {_first('author[1]')} END"
LAST_INITIALS = f"CASE WHEN {_single('x')} THEN x ELSE {_last('x')} || ', ' || {_inits('x', '')} END"
INITIALS_LAST = f"CASE WHEN {_single('x')} THEN x ELSE {_inits('x', ' ')} || ' ' || {_last('x')} END"
A_LAST_INITIALS = f"list_transform(author, lambda x: {LAST_INITIALS})"
A_INITIALS_LAST = f"list_transform(author, lambda x: {INITIALS_LAST})"
YEAR = "coalesce(CAST(year AS VARCHAR), 'n.d.')"
DOI = "'https://doi.org/' || doi"
ARTICLE = "(type = 'article' OR journal IS NOT NULL)"
VOL_ISS = "', ' || volume || coalesce('(' || issue || ')', '')"

AUTHORS = {
    "apa": f"""CASE len(author) WHEN 1 THEN ({A_LAST_INITIALS})[1] WHEN 2 THEN array_to_string({A_LAST_INITIALS}, ' & ')
  ELSE array_to_string(({A_LAST_INITIALS})[1:-2], ', ') || ', & ' || ({A_LAST_INITIALS})[-1] END""",
    "mla": f"""CASE len(author) WHEN 1 THEN {LAST_FIRST} || '. ' WHEN 2 THEN {LAST_FIRST} || ', and ' || author[2] || '. '
  ELSE {LAST_FIRST} || ', et al. ' END""",
    "chicago": f"""CASE len(author) WHEN 1 THEN {LAST_FIRST} || '. ' WHEN 2 THEN {LAST_FIRST} || ', and ' || author[2] || '. '
  WHEN 3 THEN {LAST_FIRST} || ', ' || author[2] || ', and ' || author[3] || '. ' ELSE {LAST_FIRST} || ', et al. ' END""",
    "harvard": f"""CASE len(author) WHEN 1 THEN ({A_LAST_INITIALS})[1] WHEN 2 THEN array_to_string({A_LAST_INITIALS}, ' and ')
  WHEN 3 THEN ({A_LAST_INITIALS})[1] || ', ' || ({A_LAST_INITIALS})[2] || ' and ' || ({A_LAST_INITIALS})[3]
  ELSE ({A_LAST_INITIALS})[1] || ' et al.' END""",
    "ieee": f"""CASE len(author) WHEN 1 THEN ({A_INITIALS_LAST})[1] WHEN 2 THEN array_to_string({A_INITIALS_LAST}, ' and ')
  ELSE array_to_string(({A_INITIALS_LAST})[1:-2], ', ') || ', and ' || ({A_INITIALS_LAST})[-1] END || ', '""",
}
CITATION = {
    "apa": f"""coalesce({AUTHORS['apa']}, '') || '(' || {YEAR} || '). ' || CASE WHEN {ARTICLE} THEN title || '. ' ELSE '*' || title || '*. ' END
 || CASE WHEN journal IS NOT NULL THEN '*' || journal || '*' || {VOL_ISS} || coalesce(', ' || pages, '') || '.'
  WHEN publisher IS NOT NULL THEN publisher || '.' ELSE '' END || coalesce(' ' || {DOI}, '')""",
    "mla": f"""coalesce({AUTHORS['mla']}, '') || CASE WHEN {ARTICLE} THEN '"' || title || '." ' ELSE '*' || title || '*. ' END
 || coalesce('*' || journal || '*, vol. ' || volume || coalesce(', no. ' || issue, '') || ', ', '') || coalesce(publisher || ', ', '')
 || {YEAR} || CASE WHEN journal IS NOT NULL THEN coalesce(', pp. ' || pages, '') ELSE '' END || coalesce('. ' || {DOI}, '') || '.'""",
    "chicago": f"""coalesce({AUTHORS['chicago']}, '') || CASE WHEN {ARTICLE} THEN '"' || title || '." ' ELSE '*' || title || '*. ' END
 || CASE WHEN journal IS NOT NULL THEN '*' || journal || '* ' || volume || coalesce(', no. ' || issue || ' ', '') || '(' || {YEAR} || ')'
  || coalesce(': ' || pages, '') || '.' ELSE coalesce(coalesce(publisher_location || ': ', '') || publisher || ', ', '') || {YEAR} || '.' END
 || coalesce(' ' || {DOI} || '.', '')""",
    "harvard": f"""coalesce({AUTHORS['harvard']}, '') || '(' || {YEAR} || ') ' || CASE WHEN {ARTICLE} THEN '''' || title || ''', ' ELSE '*' || title || '*, ' END
 || CASE WHEN journal IS NOT NULL THEN '*' || journal || '*' || {VOL_ISS} || coalesce(', pp. ' || pages, '') || '.'
  WHEN publisher IS NOT NULL THEN coalesce(publisher_location || ': ', '') || publisher || '.' ELSE '' END
 || coalesce(' Verfügbar unter: ' || {DOI} || ' [Zugriff am: --].', '')""",
    "ieee": f"""coalesce({AUTHORS['ieee']}, '') || '"' || title || '," ' || CASE WHEN journal IS NOT NULL THEN '*' || journal || '*, vol. ' || volume
  || coalesce(', no. ' || issue, '') || coalesce(', pp. ' || pages, '') || ', ' || {YEAR} || '.'
  ELSE coalesce(publisher || ', ', '') || {YEAR} || '.' END || coalesce(' DOI: ' || {DOI} || '.', '')""",
}


def _register_style(style: str) -> None:
    @query(f"cite_{style}", LIB + f"SELECT doc_id, {CITATION[style]} AS citation FROM library")
    def _(spark, sf):
        return fx.library(spark, sf).select("doc_id", cite.cite(style).alias("citation"))


for _style in cite.STYLES:
    _register_style(_style)

_STYLE_OF = "CASE language WHEN 'de' THEN 'MLA' WHEN 'en' THEN 'Chicago' WHEN 'fr' THEN 'ieee' ELSE 'vancouver' END"


@query(
    "cite_all",
    LIB
    + f"""SELECT doc_id, CASE language WHEN 'de' THEN {CITATION['mla']} WHEN 'en' THEN {CITATION['chicago']}
 WHEN 'fr' THEN {CITATION['ieee']} ELSE {CITATION['apa']} END AS citation FROM library""",
)
def _(spark, sf):
    return fx.library(spark, sf).select("doc_id", cite.cite_by(F.expr(_STYLE_OF)).alias("citation"))


WHO = f"CASE WHEN author IS NULL THEN 'Unbekannt' WHEN len(author) > 1 THEN {_last('author[1]')} || ' et al.' ELSE {_last('author[1]')} END"


@query(
    "cite_inline",
    LIB
    + f"""SELECT doc_id, '(' || {WHO} || ', ' || {YEAR} || coalesce(', S. ' || pages, '') || ')' AS apa,
 '(' || {WHO} || coalesce(' ' || pages, '') || ')' AS mla, '(' || {WHO} || ' ' || {YEAR} || coalesce(', ' || pages, '') || ')' AS chicago,
 '(' || {WHO} || ', ' || {YEAR} || coalesce(': ' || pages, '') || ')' AS harvard, '[' || coalesce(pages, '1') || ']' AS ieee FROM library""",
)
def _(spark, sf):
    styles = [cite.inline(s, F.col("pages")).alias(s) for s in cite.STYLES]
    return fx.library(spark, sf).select("doc_id", *styles)


@query(
    "cite_short",
    LIB
    + """, s AS (SELECT *, list_transform(author, lambda a: string_split(a, ' ')[-1]) AS l FROM library)
 SELECT doc_id, regexp_replace(concat_ws(' ', CASE WHEN len(l) = 1 THEN l[1] || ','
   WHEN len(l) > 1 THEN array_to_string(list_transform(l[1:-2], lambda x: x || ','), ' ') || ' & ' || l[-1] END || CASE WHEN len(l) = 1 THEN ' ' ELSE '' END,
  '(' || year || ').', '*' || title || '*.', coalesce(journal, publisher), 'https://doi.org/' || doi), ' {2,}', ' ', 'g') AS citation FROM s""",
)
def _(spark, sf):
    return fx.library(spark, sf).select("doc_id", cite.short_form().alias("citation"))


@query(
    "bibliography",
    sql.with_views(sql.LIBRARY, sql.CHUNKS, CONTEXT_SQL)
    + f"""SELECT first_hit, id, {CITATION['apa']} AS citation
 FROM (SELECT id, min(source_no) AS first_hit FROM context GROUP BY id) JOIN library USING (id)""",
)
def _(spark, sf):
    used = context.bibliography(_context(spark, sf), fx.library(spark, sf))
    return used.select("first_hit", "id", "citation")
