"""Chunking and chunk annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import annotate as an
from scriptorium.functions import extract as ex
from scriptorium.functions import fixed_values as v
from scriptorium.operators import chunking
from scriptorium.plans import fixtures as fx
from scriptorium.plans import fixture_sql as sql
from scriptorium.plans.registry import ORACLES, query
from scriptorium.plans.text_queries import _presence_sql

VIEWS = sql.with_views(sql.CHUNKS)
HEAD = "text"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@query("chunk_fixed", VIEWS + "SELECT doc_id, chunk_id, text FROM chunks")
def _(spark, sf):
    return fx.chunks(spark, sf)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def recursive_cut(size: int = 1000, overlap: int = 200) -> str:
    """Views of the recursive cut: ``t0`` to ``t4`` texts to be cut, ``r0`` to ``r3`` runs of short pieces, ``cut`` the chunks.

    A run is packed by one recursion step a chunk: ``base`` is where the chunk begins, ``cum`` where the run's pieces end.
    """
    views = ["t0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, text FROM documents WHERE text <> '')"]
    separators = ["\n\n", "\n", ".", " "]
    for level, separator in enumerate(separators):
        sep = f"({_quoted(separator)})"
        views += [
            f"""p{level} AS (SELECT doc_id, path, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (SELECT doc_id, path, list_filter(
   list_transform(string_split(text, {sep}), lambda x, i: CASE WHEN i = 1 THEN x ELSE {sep} || x END), lambda x: x <> '') AS pieces FROM t{level}))""",
            f"t{level + 1} AS (SELECT doc_id, list_append(path, i) AS path, piece AS text FROM p{level} WHERE length(piece) >= {size})",
            f"""r{level} AS (SELECT doc_id, list_append(path, min(i)) AS path, string_agg(piece, '' ORDER BY i) AS text, list(ends ORDER BY i) AS cum
  FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, path, run ORDER BY i) AS ends FROM (SELECT *,
   sum((length(piece) >= {size})::INT) OVER (PARTITION BY doc_id, path ORDER BY i) AS run FROM p{level}) WHERE length(piece) < {size})
  GROUP BY doc_id, path, run)""",
        ]
    runs = " UNION ALL ".join(f"SELECT * FROM r{level}" for level in range(len(separators)))
    next_base = f"list_min(list_filter(cum, lambda x: x >= greatest(ends - {overlap}, after - {size})))"
    step = size - overlap
    views += [
        f"runs AS (SELECT doc_id, path, text, list_transform(list_prepend(0, cum), lambda x: CAST(x AS BIGINT)) AS cum FROM ({runs}))",
        f"""packed AS (SELECT *, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS base, list_max(list_filter(cum, lambda x: x <= {size})) AS ends,
   list_min(list_filter(cum, lambda x: x > {size})) AS after FROM runs
  UNION ALL SELECT doc_id, path, text, cum, n + 1, base, list_max(list_filter(cum, lambda x: x <= base + {size})),
   list_min(list_filter(cum, lambda x: x > base + {size})) FROM (SELECT * REPLACE ({next_base} AS base) FROM packed WHERE after IS NOT NULL))""",
        f"""cut AS (SELECT doc_id, path, n, substring(text, base + 1, ends - base) AS text FROM packed
  UNION ALL SELECT doc_id, path, n, substring(text, n * {step} + 1, {size}) FROM (SELECT doc_id, path, text,
   unnest(range(CAST(ceil((length(text) - {size}) / {step}) AS BIGINT) + 1)) AS n FROM t{len(separators)}))""",
        """recursive_chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path, n) - 1 AS INTEGER) AS chunk_id, text
  FROM (SELECT doc_id, path, n, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM cut) WHERE text <> '')""",
    ]
    return "WITH RECURSIVE " + ",\n ".join(views) + " "


@query("chunk_recursive", recursive_cut() + "SELECT doc_id, chunk_id, text FROM recursive_chunks")
def _(spark, sf):
    return chunking.recursive_chunks(fx.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query(
    "chunk_language",
    f"""SELECT doc_id, CASE WHEN given IN ('auto', 'mixed') THEN {_presence_sql('text')} ELSE given END AS language
 FROM (SELECT *, CASE lang WHEN 'es' THEN 'auto' WHEN 'fr' THEN 'mixed' ELSE lang END AS given FROM documents)""",
)
def _(spark, sf):
    given = F.when(F.col("lang") == "es", "auto").when(F.col("lang") == "fr", "mixed").otherwise(F.col("lang"))
    docs = fx.table(spark, sf, "documents")
    return docs.select("doc_id", ex.chunk_language(given, F.col("text")).alias("language"))


@query(
    "chunk_tokens",
    VIEWS + f"SELECT doc_id, chunk_id, CAST(len(regexp_extract_all({HEAD}, '{an.TOKEN}')) AS INTEGER) AS token_count FROM chunks",
)
def _(spark, sf):
    return fx.chunks(spark, sf).select("doc_id", "chunk_id", an.token_count(F.col("text")).alias("token_count"))


def _distinct_in_order(found: str) -> str:
    return f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"


@query(
    "chunk_entities",
    VIEWS
    + " UNION ALL ".join(
        f"SELECT doc_id, chunk_id, '{kind}' AS entity_type, array_to_string({_distinct_in_order('f')}, '|') AS mentions "
        f"FROM (SELECT doc_id, chunk_id, regexp_extract_all({HEAD}, '{pattern}') AS f FROM chunks) WHERE len(f) > 0"
        for kind, pattern in an.ENTITY_PATTERNS.items()
    ),
)
def _(spark, sf):
    found = fx.chunks(spark, sf).select("doc_id", "chunk_id", F.explode(an.entities(F.col("text"))).alias("entity_type", "m"))
    return found.select("doc_id", "chunk_id", "entity_type", F.array_join("m", "|").alias("mentions"))


@query(
    "chunk_keywords",
    VIEWS
    + f"""SELECT doc_id, chunk_id, array_to_string(({_distinct_in_order('w')})[1:20], ' ') AS keywords
 FROM (SELECT doc_id, chunk_id, list_filter(regexp_extract_all(lower({HEAD}), '{an.WORD}'),
  lambda x: length(x) >= 4 AND x NOT IN {_in(an.STOP_WORDS)}) AS w FROM chunks)""",
)
def _(spark, sf):
    return fx.chunks(spark, sf).select("doc_id", "chunk_id", F.array_join(an.keywords(F.col("text")), " ").alias("keywords"))


_ANY = "|".join(f"(?:{p})" for p in an.ENTITY_PATTERNS.values())


@query(
    "chunk_summary",
    VIEWS
    + f""", s AS (SELECT doc_id, chunk_id, list_filter(list_transform(regexp_extract_all({HEAD}, '{an.SENTENCE}'),
   lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS s FROM chunks),
 r AS (SELECT doc_id, chunk_id, s[1] AS f, list_max(list_filter(list_transform(list_filter(s, lambda x: x <> s[1]),
   lambda x: {{'n': len(regexp_extract_all(x, '{_ANY}')), 'x': x}}), lambda c: c.n > 0)).x AS o FROM s)
 SELECT doc_id, chunk_id, coalesce(CASE WHEN length(f) + length(o) <= 280 THEN f || ' ' || o ELSE f END, '') AS summary FROM r""",
)
def _(spark, sf):
    return fx.chunks(spark, sf).select("doc_id", "chunk_id", an.summary(F.col("text")).alias("summary"))


def _sentiment_sql(table: str) -> str:
    def count(words):
        return f"len(list_filter(w, lambda x: x IN {_in(words)}))::DOUBLE"

    return f"""SELECT doc_id, chunk_id, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE round({count(v.POSITIVE_WORDS)} / len(w), 3) END AS positive,
 CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE round({count(v.NEGATIVE_WORDS)} / len(w), 3) END AS negative,
 CASE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE round(1.0::DOUBLE - ({count(v.POSITIVE_WORDS)} / len(w) + {count(v.NEGATIVE_WORDS)} / len(w)), 3) END AS neutral
 FROM (SELECT doc_id, chunk_id, list_filter(regexp_extract_all(lower({HEAD}), '{an.WORD}'), lambda x: x NOT IN {_in(an.STOP_WORDS)}) AS w FROM {table})"""


_MOOD = "CASE doc_id % 3 WHEN 0 THEN ' good schlecht excellent' WHEN 1 THEN ' awful' ELSE '' END"


@query(
    "chunk_sentiment",
    sql.with_views(sql.CHUNKS, f"moody AS (SELECT doc_id, chunk_id, text || {_MOOD} AS text FROM chunks)") + _sentiment_sql("moody"),
)
def _(spark, sf):
    mood = F.when(F.col("doc_id") % 3 == 0, " good schlecht excellent").when(F.col("doc_id") % 3 == 1, " awful").otherwise("")
    moody = fx.chunks(spark, sf).withColumn("text", F.concat("text", mood))
    return moody.select("doc_id", "chunk_id", an.sentiment(F.col("text")).alias("s")).select("doc_id", "chunk_id", "s.*")


_KINDS = " + ".join(f"regexp_matches({HEAD}, '{p}')::INT" for p in an.ENTITY_PATTERNS.values())


def _view(name: str) -> str:
    body = ORACLES[name][len(VIEWS.rstrip()) :].lstrip()
    return "WITH " + body[1:] if body.startswith(",") else body


@query(
    "chunks_improved",
    VIEWS.rstrip()
    + f""", q_tokens AS ({_view("chunk_tokens")}), q_keywords AS ({_view("chunk_keywords")}), q_summary AS ({_view("chunk_summary")}),
 q_sentiment AS ({_sentiment_sql("chunks")}), q_kinds AS (SELECT doc_id, chunk_id, CAST({_KINDS} AS INTEGER) AS n_entity_types FROM chunks)
 SELECT doc_id, chunk_id, token_count, CAST(CASE WHEN keywords = '' THEN 0 ELSE len(string_split(keywords, ' ')) END AS INTEGER) AS n_keywords,
  n_entity_types, summary, positive, negative, neutral, true AS improved
 FROM q_tokens JOIN q_keywords USING (doc_id, chunk_id) JOIN q_summary USING (doc_id, chunk_id)
  JOIN q_sentiment USING (doc_id, chunk_id) JOIN q_kinds USING (doc_id, chunk_id)""",
)
def _(spark, sf):
    done = chunking.annotate_and_improve(fx.chunks(spark, sf))
    return done.select(
        "doc_id", "chunk_id", "token_count", F.size("keywords").alias("n_keywords"), F.size("entities").alias("n_entity_types"),
        "summary", "sentiment.positive", "sentiment.negative", "sentiment.neutral", "improved",
    )


def _over(name: str) -> str:
    """The SQL of a query on chunks, over the recursive ones."""
    return f"({_view(name)})".replace("FROM chunks", "FROM recursive_chunks")


@query(
    "chunk_documents",
    recursive_cut()
    + f"""SELECT doc_id, chunk_id, language, token_count, keywords, CAST(length(text) AS INTEGER) AS n_chars FROM recursive_chunks
 JOIN (SELECT doc_id, {_presence_sql('text')} AS language FROM documents) USING (doc_id)
 JOIN {_over("chunk_tokens")} USING (doc_id, chunk_id) JOIN {_over("chunk_keywords")} USING (doc_id, chunk_id)""",
)
def _(spark, sf):
    """Language, recursive cut and annotations of whole documents in one pass."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "text", F.lit("auto").alias("language"))
    done = chunking.chunk_documents(docs, "doc_id")
    return done.select("doc_id", "chunk_id", "language", "token_count", F.array_join("keywords", " ").alias("keywords"), F.length("text").alias("n_chars"))
