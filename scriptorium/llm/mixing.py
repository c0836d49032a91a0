"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's documents are put in a fixed order; each is expected ``rate`` = target / source size times, the
prefix sums of that are shifted by one random offset per source (a digest of seed and source, so reruns agree),
and a document is emitted once for each integer that its stretch crosses. Ordering by size within a source
keeps the words taken near the target.

The prefix sum has two levels: rows are counted by (source, size class, digest bucket), the counts are summed up
within a source, and only a bucket's rows are numbered one by one. A source that holds most rows is thus spread
over `BUCKETS` times as many groups as it has size classes.

Defined results: a null text has size 0 and is emitted at its source's rate; a null source is a source of its
own, the last; a source without words has target 0 and is not taken; equal rows count one by one; a null id is
a value like any other; extra columns stay, whatever their names (those of this module's own columns, which
begin with an underscore, are replaced); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix-1"
_WORD = "[^\\x20\\x09-\\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _unit(value: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source of ``sizes`` (source, source_size): shares by weight, at most ``most`` times its size.

    Weights go round in the order of sources (code points, null last). Resharing the excess until nobody is above
    ends at one level: a source takes the lesser of level times weight and its cap. In the order of cap per
    weight, the capped sources come first, so prefix sums give the level. One row per source meets here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)).withColumn(
        "cap", F.lit(float(most)) * F.col("source_size")
    )
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    # The first source whose cap is not below the level that remains for it and the later ones sets the level;
    # the levels of later ones are not above it.
    leveled = weighed.withColumn("own_level", level).withColumn(
        "level", F.max(F.when(F.col("own_level") * F.col("weight") <= F.col("cap"), F.col("own_level"))).over(whole)
    )
    return leveled.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED
) -> DataFrame:
    """``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies``, the times that the mix takes the row."""
    size = size_of(F.col(text))
    rows = (
        docs.withColumn("_size", size)
        # Size classes are doublings; the digest of the id spreads equal sizes.
        .withColumn("_class", F.length(F.bin("_size")))
        .withColumn("_digest", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
        .withColumn("_tie", F.md5(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("_bucket", (F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int") % BUCKETS).cast("int"))
    )
    bucket = [F.col(source).alias("source"), F.col("_class").alias("class"), F.col("_bucket").alias("bucket")]
    counts = rows.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum("_size").alias("words"))
    sizes = counts.groupBy("source").agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, most)
    order = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).select(
        F.col("source").alias("_b_source"), F.col("class").alias("_b_class"), F.col("bucket").alias("_b_bucket"), "base"
    )
    plan = bases.join(goal, F.col("_b_source").eqNullSafe(F.col("source"))).select(
        "_b_source", "_b_class", "_b_bucket", F.col("base").alias("_base"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target")
    )
    within = Window.partitionBy(F.col(source), "_class", "_bucket").orderBy("_size", "_digest", "_tie")
    numbered = rows.withColumn("_place", F.row_number().over(within) - 1)
    joined = numbered.join(
        plan,
        numbered[source].eqNullSafe(plan["_b_source"]) & (numbered["_class"] == plan["_b_class"]) & (numbered["_bucket"] == plan["_b_bucket"]),
    )
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col(source), F.lit("\x00"))))
    place = F.col("_base") + F.col("_place")
    copies = F.floor(rate * (place + 1) + offset) - F.floor(rate * place + offset)
    return joined.select(
        *docs.columns, "_size", "_source_size", "_target", F.least(copies, F.lit(most)).cast("long").alias("_copies")
    )


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    taken = mix(docs, **options).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


#: The query's rows in SQL: the same order, offsets and prefix sums, with plain windows over a whole source.
SQL = r"""
WITH sized AS (
    SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), ordered AS (
    SELECT *, row_number() OVER (
        PARTITION BY source
        ORDER BY length(bin(size)), ('0x' || substr(digest, 1, 4))::BIGINT % 64, size, digest, md5(coalesce(text, ''))) - 1 AS place
    FROM sized
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM sources
), leveled AS (
    SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
              / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
    FROM weighed WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
), goals AS (
    SELECT source, source_size,
           least(cap, (max(CASE WHEN own_level * weight <= cap THEN own_level END) OVER ()) * weight) AS target,
           ('0x' || substr(md5('mix-1' || chr(31) || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift
    FROM leveled
), rated AS (
    SELECT o.doc_id, o.size, o.place, g.source_size, g.target, g.shift,
           CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate
    FROM ordered o JOIN goals g ON o.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (least(floor(rate * (place + 1) + shift) - floor(rate * place + shift), 3) * size)::BIGINT AS taken
FROM rated
"""
