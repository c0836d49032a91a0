"""Helpers of the training-data operators: written intermediate tables and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import cut_lineage


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: lost executors re-read files, lineage ends here."""
    return cut_lineage(df, name)


_HELD: dict[str, tuple[object, object]] = {}


def held(kind: str, key: object, build):
    """What ``build`` makes for ``key``, kept by this Python worker until another operator or key takes its place.

    Workers serve one stage after another: one cache at a time bounds their memory.
    """
    known = _HELD.get(kind)
    if known is None or known[0] is not key:
        _HELD.clear()
        _HELD[kind] = (key, build())
    return _HELD[kind][1]


def cut_at(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows' ``sizes`` add up to ``most`` or less, or that are one row."""
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches whose texts take about ``most`` bytes at most, or that are one row: what a task holds at a time."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            yield from cut_at(batch, sizes, most)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: bigint): one row (node, component) for each node with an edge.

    ``component`` is the smallest node of the component. Large-star and small-star steps in turn
    (Kiveris et al., 2014) pull every node to the least one it knows; each round is a written table, so neither
    lineage nor driver memory grows, and no neighbour list is ever gathered: a step is a minimum with partial
    aggregation and an equality join whose large keys the adaptive planner can split.
    """
    links = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    for _ in range(rounds):
        links = written(_small_star(_large_star(links)), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the least of the node and its neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("least"))
    return (
        both.where("b > a")
        .join(least, F.col("a") == F.col("node"))
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, link to the least of the smaller neighbours."""
    least = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    moved = links.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct()
