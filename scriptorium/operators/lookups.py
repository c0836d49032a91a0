"""Which look-ups went to the service when answers are kept for a fixed time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut_lineage

# Fixed value: seconds an answer stays valid.
TTL_SECONDS = 86_400
# Time slots per validity period. Work on one key is split by slot.
SLOTS = 96


def _next_fetch(times: DataFrame, ttl: int) -> DataFrame:
    """For every request the first one of its key after its answer would expire: ``(key, us, next)``.

    The expiry falls into a time slot; the answer is in that slot or is the first request of the next
    slot that has any. Slots of a key are independent, so a busy key spreads over many tasks.
    """
    width = max(ttl // SLOTS, 1)
    slot = F.floor(F.col("at") / width)
    requests = times.select("key", F.col("us").alias("at"), F.col("us").alias("request"), F.lit(None).cast("bigint").alias("of"))
    probes = times.select("key", (F.col("us") + ttl).alias("at"), F.lit(None).cast("bigint").alias("request"), F.col("us").alias("of"))
    points = requests.unionByName(probes).withColumn("slot", slot)
    # Later requests come first; at equal times the probe comes before the request, which still counts as a hit.
    later = (
        Window.partitionBy("key", "slot")
        .orderBy(F.desc("at"), F.col("of").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = points.withColumn("in_slot", F.min("request").over(later)).filter("of IS NOT NULL")
    first_of_slot = points.groupBy("key", "slot").agg(F.min("request").alias("first"))
    after = (
        Window.partitionBy("key").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    )
    following = first_of_slot.select("key", "slot", F.min("first").over(after).alias("after_slot"))
    return within.join(following, ["key", "slot"]).select(
        "key", F.col("of").alias("us"), F.coalesce("in_slot", "after_slot").alias("next")
    )


def fetches(requests: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """``(key, ts)`` of the requests that fetched: the first, then each first one after the last fetch expired.

    Hits do not prolong an answer, so the fetches form a chain. The chain is followed by doubling: knowing
    the first ``n`` fetches of every key and where ``n`` steps lead from any request gives the first
    ``2n``. All steps are joins on ``(key, time)``, which no key can make hot; the number of rounds grows
    with the logarithm of the time span.
    """
    ttl = ttl_seconds * 1_000_000
    times = requests.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).distinct()
    jump = cut_lineage(_next_fetch(times, ttl), "lookup-jumps")
    span = jump.agg((F.max("us") - F.min("us")).alias("span")).first()["span"] or 0
    rounds = max(1, math.ceil(math.log2(span // ttl + 2)))
    chain = jump.groupBy("key").agg(F.min("us").alias("us"))
    for turn in range(rounds):
        step = jump.filter("next IS NOT NULL")
        reached = chain.join(step, ["key", "us"]).select("key", F.col("next").alias("us"))
        chain = cut_lineage(chain.unionByName(reached), "lookup-chain")
        if turn < rounds - 1:
            onward = step.select("key", F.col("us").alias("next"), F.col("next").alias("far"))
            jump = cut_lineage(step.join(onward, ["key", "next"]).select("key", "us", F.col("far").alias("next")), "lookup-jumps")
    return chain.select("key", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"))


def outcomes(requests: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Hits and fetches per key; of several requests at one instant the first fetches, the others hit.

    If ``requests`` has a column ``kept``, answers where it is false or null are empty and not kept: requests fetch until
    one brings an answer. At one instant the answer that is kept comes first.
    """
    asked = requests.groupBy("key").agg(F.count("*").alias("asked"))
    if "kept" not in requests.columns:
        fetched = fetches(requests, ttl_seconds).groupBy("key").agg(F.count("*").alias("fetched"))
        return asked.join(fetched, "key").select("key", "fetched", (F.col("asked") - F.col("fetched")).alias("hits"))
    keeping = F.coalesce("kept", F.lit(False))
    ttl = ttl_seconds * 1_000_000
    # Written once: kept fetches are counted, and cover the empty answers that their validity touches.
    kept = cut_lineage(fetches(requests.where(keeping), ttl_seconds).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), "lookup-kept")
    # Kept fetches of a key lie further apart than the validity: a slot as long as that holds one at most, and only that one
    # and the one of the slot before can cover a request. So cover has one row for a slot, two rows for a fetch.
    slot = F.floor(F.col("us") / ttl)
    touched = kept.select("key", F.col("us").alias("since"), F.explode(F.array(slot, slot + 1)).alias("slot"), slot.alias("own"))
    cover = touched.groupBy("key", "slot").agg(
        F.max(F.when(F.col("slot") == F.col("own"), F.col("since"))).alias("here"),
        F.max(F.when(F.col("slot") != F.col("own"), F.col("since"))).alias("before"),
    )
    times = requests.where(~keeping).select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    # Requests of one instant are one row, so that a busy instant meets its cover once.
    empty = times.groupBy("key", "us").agg(F.count("*").alias("n")).withColumn("slot", slot)
    covers = F.coalesce(F.col("us") >= F.col("here"), F.lit(False)) | F.coalesce(F.col("us") <= F.col("before") + ttl, F.lit(False))
    # The size of what was exploded is not known to the planner: the shuffle keeps it off the driver.
    met = empty.join(cover.hint("merge"), ["key", "slot"]).where(covers)
    covered = met.groupBy("key").agg(F.sum("n").alias("covered"))
    total = requests.groupBy("key").agg(F.count("*").alias("asked"), F.count_if(keeping).alias("asked_kept"))
    joined = total.join(kept.groupBy("key").agg(F.count("*").alias("n_kept")), "key", "left").join(covered, "key", "left")
    hits = F.when(F.col("n_kept").isNull(), 0).otherwise(F.col("asked_kept") - F.col("n_kept") + F.coalesce("covered", F.lit(0)))
    return joined.select("key", (F.col("asked") - hits).alias("fetched"), hits.cast("bigint").alias("hits"))


def clear(cache: DataFrame, prefix: str | None = None) -> DataFrame:
    """Cache rows that stay after clearing a key prefix, or none."""
    return cache.filter(~F.col("key").startswith(prefix)) if prefix else cache.limit(0)


def live(cache: DataFrame, now) -> DataFrame:
    """Entries that have not expired and hold a value."""
    return cache.filter((F.col("expiry") >= now) & F.col("value").isNotNull() & (F.col("value") != ""))
