"""The same derived tables as ``fixtures`` written as SQL for the oracle."""

from __future__ import annotations

from scriptorium.plans.fixtures import AUTHOR_POOL, SOURCES


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LIBRARY = f"""library AS (
 SELECT doc_id, substr(md5('doc' || doc_id || '_' || n_chars), 1, 12) AS id,
  'doc' || doc_id || {sql_list([".pdf", ".docx", ".epub", ".pptx", ".TXT"])}[doc_id % 5 + 1] AS filename,
  CASE WHEN length(trim(regexp_extract(text, '^[\\p{{L}} ]+'))) <= 300 THEN trim(regexp_extract(text, '^[\\p{{L}} ]+')) ELSE 'doc' || doc_id END AS title,
  CASE WHEN doc_id % 11 <> 0 THEN {sql_list(AUTHOR_POOL)}[doc_id % 7 + 1 : doc_id % 7 + doc_id % 4 + 1] END AS author,
  CASE WHEN doc_id % 13 <> 0 THEN CAST(1990 + doc_id % 35 AS INTEGER) END AS year,
  CASE WHEN doc_id % 3 = 0 THEN source END AS journal,
  CASE WHEN doc_id % 3 = 1 THEN 'Press ' || source END AS publisher,
  CASE WHEN doc_id % 4 = 0 THEN '10.1234/' || source || '.' || doc_id END AS doi,
  CASE WHEN doc_id % 4 = 1 THEN '978' || lpad(CAST(doc_id AS VARCHAR), 10, '0') END AS isbn,
  greatest(1, n_chars // 2000) AS page_count,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS BIGINT)) AS added_at,
  ['article', 'book', 'thesis', 'other'][doc_id % 4 + 1] AS type,
  CAST(doc_id % 50 + 1 AS VARCHAR) AS volume,
  CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 12 + 1 AS VARCHAR) END AS issue,
  CASE WHEN doc_id % 5 <> 0 THEN '10-20' END AS pages,
  CASE WHEN doc_id % 6 = 1 THEN 'Berlin' END AS publisher_location,
  lang AS language, source, n_chars AS file_size
 FROM documents)"""

CHUNKS = """chunks AS (
 SELECT doc_id, CAST(k AS INTEGER) AS chunk_id, substr(text, 800 * k + 1, 1000) AS text
 FROM (SELECT doc_id, text, unnest(range(CAST(ceil(greatest(length(text) - 200, 1) / 800.0) AS BIGINT))) AS k
       FROM documents))"""

PAPERS = """papers AS (
 SELECT doc_id, lang, source, concat_ws(chr(10), substr(text, 1, 60),
  ['Authors: Ada Lovelace, Kurt Goedel', 'Author: Emmy Noether and Max Born', 'by Grace Hopper'][doc_id % 3 + 1],
  CASE WHEN doc_id % 2 = 0 THEN '(' || (1990 + doc_id % 35) || ')' ELSE 'Published ' || (1985 + doc_id % 40) END,
  CASE WHEN doc_id % 4 = 0 THEN 'doi: 10.1234/' || source || '.' || doc_id
       WHEN doc_id % 4 = 1 THEN 'ISBN 978-3-16-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '-X' END,
  ['Springer', 'published by Invented House.', 'Journal of Imaginary Results.'][doc_id % 5 + 1],
  substr(text, 61)) AS text
 FROM documents)"""

CATALOGUE = f"""catalogue AS (
 SELECT {sql_list(SOURCES)}[source_order] AS source, CAST(rank AS INTEGER) AS rank, doc_id,
  {sql_list(SOURCES)}[source_order] || '-' || doc_id || '-' || rank AS record_id,
  CASE rank WHEN 1 THEN substr(title, 1, greatest(length(title) - source_order, 0))
            WHEN 2 THEN title || ' (Nachdruck)' ELSE reverse(title) END AS title,
  CASE WHEN rank <= 2 THEN author END AS author,
  CAST(1990 + doc_id % 35 + rank - 1 AS INTEGER) AS year,
  CASE WHEN rank <= 2 THEN publisher END AS publisher, CASE WHEN rank = 1 THEN journal END AS journal,
  CASE WHEN rank = 1 THEN doi END AS doi, CASE WHEN rank = 1 THEN isbn END AS isbn,
  CASE WHEN rank = 1 AND doc_id % 2 = 0 THEN '1234-5678' END AS issn,
  CASE WHEN rank = 1 THEN page_count END AS page_count, CASE WHEN rank = 1 THEN language END AS language,
  CASE WHEN rank = 1 AND journal IS NOT NULL THEN [journal, 'catalogue'] END AS keywords,
  CAST(NULL AS VARCHAR) AS abstract, CASE WHEN rank = 1 THEN type END AS type,
  CASE WHEN rank = 1 THEN doc_id % 4 END AS cited_by_count, CAST(NULL AS BOOLEAN) AS is_open_access
 FROM library, (SELECT unnest(range(1, 6)) AS source_order), (SELECT unnest(range(1, 4)) AS rank)
 WHERE source_order = 1 OR (source_order = 2 AND language IN ('en', 'de'))
  OR (source_order = 3 AND language IN ('de', 'fr')) OR (source_order = 4 AND language IN ('en', 'fr', 'es'))
  OR (source_order = 5 AND language IN ('en', 'es')))"""

SEARCH_LOG = "search_log AS (SELECT event_id, user_id, ts, event_type AS search_type, props AS query FROM events)"
FETCH_REQUESTS = "fetch_requests AS (SELECT 'lookup_' || user_id AS key, ts FROM events)"
CACHE_ROWS = """cache_rows AS (SELECT 'lookup_' || user_id AS key, CASE WHEN event_type <> 'error' THEN props ELSE '' END AS value,
  ts + INTERVAL 24 HOUR AS expiry FROM events)"""
PATCHES = """patches AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'patched ' || doc_id END AS title,
  CASE WHEN toxic = 1 THEN '2000' END AS year,
  CASE WHEN quality = 0 THEN ' Rosalind Franklin , Max Born' END AS authors FROM labels)"""
DELETE_IDS = "delete_ids AS (SELECT doc_id FROM labels WHERE toxic = 1)"
INDEX_SUBSET = "index_subset AS (SELECT * FROM library WHERE doc_id IN (SELECT doc_id FROM labels))"
LINES = """lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""
QUERY_SET = "query_set AS (SELECT item_id AS query_id, text AS query FROM benchmark)"


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
