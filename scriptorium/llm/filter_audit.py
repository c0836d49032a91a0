"""Audit of filters that run in a row: what each removes at each place of every order, and its fair share of all removals.

Each document fails a set of filters, a mask of bits; per part the table comes down to at most 2 ** n cells of
(mask, count, good, toxic). A recursive query starts from the empty prefix and all masks, and extends every prefix by
each unused letter; a row carries the letters applied so far as bits, so that a level of the recursion says for each
prefix and mask what this step does: keep, remove, or meet what an earlier filter has removed. Its size, all prefixes
times 2 ** n masks (10,432 rows for five filters), depends on the number of filters only. The cells of the parts join it
by mask, one sum per part and prefix follows, and each order reads its five prefixes.

The filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capital letters A-Z > 5 * code points;
D holds one of ``#$%&*|``; E equal to the text of a smaller id anywhere in the table. Words are maximal runs of
other than ASCII white space, case kept. Equal texts are found by their SHA-256: rows are counted per digest and id
first, so a text that a third of all rows share is spread by id and comes down to one row per part before digests meet.

Defined results: a null text is empty, a null part is the empty string, and both are then one with rows that have them
so; a null id is neither smaller than another nor has a smaller one, and has no label; rows that share an id are
counted each, and do not make each other duplicates; of several label rows of an id a 1 counts; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.tables import written

FILTERS = "ABCDE"
WHITE = r"[\x20\x09-\x0D]+"
MIN_WORDS = 50


def failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 of the filters A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, WHITE, -1), "")
    n = F.size(words)
    fails = [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < 65 * n,
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    total = F.when(fails[0], 1).otherwise(0)
    for i, fail in enumerate(fails[1:], 1):
        total = total + F.when(fail, 1 << i).otherwise(0)
    return total


def mask_cells(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "source") -> DataFrame:
    """part, mask, n, good and toxic: the counts of documents of each part that fail exactly the filters of ``mask``."""
    whole = F.coalesce(docs[text], F.lit(""))
    marks = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[part], F.lit("")).alias("part"), failures(whole).alias("mask"), F.unhex(F.sha2(whole, 256)).alias("digest")
    )
    known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    # One row per digest and id first: the copies of a text are spread by their ids.
    cell = ["digest", "part", "mask", "good", "toxic"]
    single = (
        marks.join(known, F.col("id") == F.col("label_id"), "left")
        .select("id", "digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
        .groupBy("id", *cell)
        .agg(F.count("*").alias("n"))
    )
    # The least id of a cell and how many rows have it: struct minima, so both steps combine on the map side.
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least")
    cells = written(single.groupBy(*cell).agg(F.sum("n").alias("n"), least, F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id")), "audit-cells")
    first = cells.groupBy(F.col("digest").alias("first_digest")).agg(F.min("least.id").alias("first_id"))
    original = F.col("no_id") + F.when(F.col("least.id") == F.col("first_id"), F.col("least.n")).otherwise(0)
    split = F.explode(
        F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - original).alias("n")))
    )
    return (
        cells.join(first, F.col("digest") == F.col("first_digest"))
        .select("part", "good", "toxic", split.alias("cell"))
        .select("part", "cell.mask", "cell.n", (F.col("good") * F.col("cell.n")).alias("good"), (F.col("toxic") * F.col("cell.n")).alias("toxic"))
        .groupBy("part", "mask")
        .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        .where("n > 0")
    )


def enumerated(spark: SparkSession, letters: str = FILTERS) -> DataFrame:
    """prefix, letter, bit, step, mask, before: each prefix of each order of ``letters`` with each mask, by a recursive query.

    ``before`` holds the bits of the filters applied earlier, ``applied`` those and this step's.
    """
    values = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {values}),
        cells AS (SELECT CAST(id AS INT) AS mask FROM range({1 << len(letters)})),
        steps(prefix, letter, bit, step, mask, before, applied) AS (
            SELECT CAST('' AS STRING), CAST('' AS STRING), 0, 0, mask, 0, 0 FROM cells
            UNION ALL
            SELECT concat(s.prefix, f.letter), f.letter, f.bit, s.step + 1, s.mask, s.applied, s.applied | f.bit
            FROM steps s JOIN filters f ON (s.applied & f.bit) = 0
        )
        SELECT prefix, letter, bit, step, mask, before, applied FROM steps WHERE step > 0""")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", part: str = "source") -> DataFrame:
    """One row per part, filter_order and step with the counts of documents; see the module and the names of the columns."""
    steps = written(enumerated(docs.sparkSession), "audit-steps")
    cells = mask_cells(docs, labels, text, id_col, part)
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    removes = fails & ~gone
    # The enumeration is bounded by the number of filters: sent to every task.
    count = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0))
    sums = (
        cells.join(F.broadcast(steps), "mask")
        .groupBy("part", "prefix", "letter", "step")
        .agg(
            count(F.col("mask").bitwiseAND(F.col("applied")) == 0).alias("kept"),
            count(removes).alias("removed"),
            count(fails & gone).alias("redundant"),
            count(F.col("mask") == F.col("bit")).alias("unique_fails"),
            count(removes, "good").alias("good_lost"),
            count(removes, "toxic").alias("toxic_lost"),
        )
    )
    # A prefix of k letters begins (n - k)! orders.
    orders = F.factorial(F.lit(len(FILTERS)) - F.col("step"))
    sums = written(sums, "audit-prefixes")
    shares = sums.groupBy(F.col("part").alias("share_part"), F.col("letter").alias("share_letter")).agg(F.sum(F.col("removed") * orders).alias("shapley"))
    places = steps.where(F.col("step") == len(FILTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    places = places.select("filter_order", F.explode(F.sequence(F.lit(1), F.length("filter_order"))).alias("at"))
    places = places.withColumn("begins", F.expr("substring(filter_order, 1, at)"))
    return (
        sums.join(F.broadcast(places), F.col("prefix") == F.col("begins"))
        .join(shares, (F.col("part") == F.col("share_part")) & (F.col("letter") == F.col("share_letter")))
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
w AS (
  SELECT d.*, list_filter(regexp_split_to_array(d.t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, coalesce(d.doc_id > f.first_id, false) AS e,
    coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM d JOIN firsts f ON d.t = f.t LEFT JOIN l ON d.doc_id = l.doc_id
),
m AS (
  SELECT part, good, toxic,
    (CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN e THEN 16 ELSE 0 END) AS mask
  FROM w
),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND a.bit <> e.bit AND b.bit <> c.bit AND b.bit <> d.bit AND b.bit <> e.bit
    AND c.bit <> d.bit AND c.bit <> e.bit AND d.bit <> e.bit
),
places AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(list_slice(bits, 1, step)) - bits[step] AS INT) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, places GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
