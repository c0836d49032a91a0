"""Embedding near-duplicates by PCA-ordered tiles.

Unit vectors are turned into the principal axes of all of them, so that the leading components carry most of a
product. The vectors of a group (equal label, equal number of components) are ordered by the first axis, cut into
chunks, and every two chunks that can hold a pair within the threshold form a tile. In a tile, products are summed
over leading blocks of components; the rest is at most the product of the suffix norms (Cauchy-Schwarz), and pairs
that cannot reach the threshold any more are dropped before the next block. What remains is verified by the cosine
of the original vectors in double precision. A tile returns its vectors' link counts and a spanning forest, never
its pairs.

Equal vectors of a group are one representative with a count. A group that holds most rows only has more tiles of
the same bounded size.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and rows without a
label, link with nothing and are their own component; a null vec_id is a row without links to report but keeps
its component null; rows that share a vec_id and are linked count as other vectors; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.near_text import _forest
from scriptorium.llm.tables import components, written
from scriptorium.llm.vectors import cosines, matrix, principal_axes, unit, usable

CHUNK = 2048
#: Components summed before pairs are dropped, again and again.
BLOCK = 8
_SLACK = 1e-9


def close_pairs(a: np.ndarray, b: np.ndarray, za: np.ndarray, zb: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i of a, j of b) of the pairs at the threshold or above; i < j where a and b are the same rows."""
    dims = za.shape[1]
    found_i, found_j = [], []
    ends = [*range(BLOCK, dims, BLOCK), dims]
    # The norms of what is left after each block.
    squares_a, squares_b = np.cumsum(za[:, ::-1] ** 2, axis=1)[:, ::-1], np.cumsum(zb[:, ::-1] ** 2, axis=1)[:, ::-1]
    rest = lambda squares, end: np.sqrt(squares[:, end]) if end < dims else np.zeros(len(squares))
    step = max(1, 2_000_000 // max(len(b), 1))
    for top in range(0, len(a), step):
        part = slice(top, top + step)
        first = ends[0]
        dot = za[part, :first] @ zb[:, :first].T
        reach = dot + np.outer(rest(squares_a[part], first), rest(squares_b, first))
        i, j = np.nonzero(reach >= threshold - _SLACK)
        if same:
            i, j = i[top + i < j], j[top + i < j]
        dot, i = dot[i, j], i + top
        for start, end in zip(ends, ends[1:], strict=False):
            if not len(i):
                break
            dot = dot + np.einsum("ij,ij->i", za[i, start:end], zb[j, start:end])
            keep = dot + rest(squares_a, end)[i] * rest(squares_b, end)[j] >= threshold - _SLACK
            i, j, dot = i[keep], j[keep], dot[keep]
        for at in range(0, len(i), 200_000):
            i_at, j_at = i[at : at + 200_000], j[at : at + 200_000]
            sure = cosines(a[i_at], b[j_at]) >= threshold
            found_i.append(i_at[sure])
            found_j.append(j_at[sure])
    none = [np.zeros(0, dtype=np.int64)]
    return np.concatenate(found_i or none), np.concatenate(found_j or none)


def _representatives(rows: DataFrame) -> DataFrame:
    """One row for each different vector of a group: rep (a number for it), label, dims, vector, least vec_id, copies."""
    grouped = (
        rows.where(usable(F.col("vector")) & F.col("label").isNotNull())
        .groupBy("label", "vector")
        .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    )
    return grouped.withColumn("dims", F.size("vector")).withColumn("rep", F.monotonically_increasing_id())


def near_duplicates(
    frame: DataFrame, threshold: float = 0.98, vector: str = "embedding", id_col: str = "vec_id", label: str = "label", chunk: int = CHUNK
) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of each row of ``frame``."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    rows = frame.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    reps = written(_representatives(rows), "representatives")
    axes = {d: principal_axes(reps.where(F.col("dims") == d), "vector", d) for d in (r["dims"] for r in reps.select("dims").distinct().collect())}
    placed = written(_chunked(reps, axes, chunk), "chunks")
    tiled = written(_tiles(placed, threshold), "tiles")
    found = written(_compare(tiled, axes, threshold), "found")

    linked = found.groupBy("rep").agg(F.sum("partners").alias("partners"))
    classes = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = reps.join(classes, F.col("rep") == F.col("node"), "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    answers = (
        named.join(least, "component")
        .join(linked, "rep", "left")
        .select(
            F.col("label").alias("_label"),
            F.col("vector").alias("_vector"),
            (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("_links"),
            "component_id",
        )
    )
    joined = rows.join(answers, (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")), "left")
    own = F.when(F.col("_label").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )


def _chunked(reps: DataFrame, axes: dict[int, np.ndarray], chunk: int) -> DataFrame:
    """Representatives with ``first`` (the leading component) and ``chunk``: its place along the first axis within the group.

    Chunk borders are approximate quantiles of each group; a stretch that still holds too many vectors (many
    with nearly the same leading component) is split by number.
    """

    def run(batches):
        for batch in batches:
            values, dims = batch.column("vector"), batch.column("dims").to_numpy()
            first = np.zeros(batch.num_rows)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                first[at] = unit(matrix(values.take(pa.array(at)))) @ axes[int(d)][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=[*batch.schema.names, "first"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    led = written(reps.mapInArrow(run, f"{schema}, first double"), "led")
    sizes = led.groupBy("label", "dims").agg(F.count("*").alias("n"), F.percentile_approx("first", [i / 256 for i in range(1, 256)], 2000).alias("quantiles"))
    # Every k-th of the 255 quantiles is a border, so that a stretch has about ``chunk`` vectors.
    stride = F.greatest(F.floor(F.lit(256.0 * chunk) / F.col("n")), F.lit(1)).cast("int")
    borders = sizes.withColumn("stride", stride).select(
        F.col("label").alias("_label"),
        F.col("dims").alias("_dims"),
        F.filter("quantiles", lambda x, i: (i + 1) % F.col("stride") == 0).alias("borders"),
    )
    stretched = led.join(borders, (F.col("label") == F.col("_label")) & (F.col("dims") == F.col("_dims"))).withColumn(
        "stretch", F.size(F.filter("borders", lambda x: x < F.col("first")))
    )
    stretched = stretched.drop("_label", "_dims", "borders")
    crowded = stretched.groupBy("label", "dims", "stretch").agg(F.ceil(F.count("*") / (2.0 * chunk)).cast("int").alias("parts"))
    return stretched.join(crowded, ["label", "dims", "stretch"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))


def _tiles(placed: DataFrame, threshold: float) -> DataFrame:
    """The rows of each tile: (label, dims, tile, side, rep, copies, vector).

    Unit vectors at the threshold differ by at most sqrt(2 - 2 * threshold) in any component, so chunks
    further apart along the first axis make no tile.
    """
    reach = math.sqrt(2 - 2 * threshold) + _SLACK
    chunks = placed.groupBy("label", "dims", "stretch", "part").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    left = chunks.select("label", "dims", F.struct("stretch", "part").alias("a"), F.col("high").alias("a_high"))
    right = chunks.select("label", "dims", F.struct("stretch", "part").alias("b"), F.col("low").alias("b_low"))
    pairs = left.join(right, ["label", "dims"]).where((F.col("a") <= F.col("b")) & (F.col("b_low") - F.col("a_high") <= reach))
    tile = F.struct("a", "b").alias("tile")
    sides = pairs.select("label", "dims", F.col("a").alias("chunk"), tile, F.lit(0).alias("side")).union(
        pairs.where("a <> b").select("label", "dims", F.col("b").alias("chunk"), tile, F.lit(1).alias("side"))
    )
    rows = placed.select("label", "dims", F.struct("stretch", "part").alias("chunk"), "rep", "copies", "vector")
    return rows.join(sides, ["label", "dims", "chunk"]).select("label", "dims", "tile", "side", "rep", "copies", "vector")


def _compare(tiled: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """For each linked vector of a tile: rep, partners (links it has there, copies counted) and root of its forest."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        x = matrix(table.column("vector"))
        z = unit(x) @ axes[x.shape[1]]
        cut = int(np.searchsorted(table.column("side").to_numpy(), 1))
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        if cut == len(x):
            i, j = close_pairs(x, x, z, z, threshold, same=True)
        else:
            i, j = close_pairs(x[:cut], x[cut:], z[:cut], z[cut:], threshold, same=False)
            j = j + cut
        partners = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        at = np.flatnonzero(partners)
        root = _forest(len(x), i, j)
        return pa.table({"rep": rep[at], "partners": partners[at].astype(np.int64), "root": rep[root[at]]})

    return tiled.groupBy("label", "dims", "tile").applyInArrow(compare, "rep long, partners long, root long")


#: All pairs of equal labels, and a recursive walk over the links.
SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links,
       (SELECT min(other) FROM reach r WHERE r.vec_id = e.vec_id) AS component_id,
       e.vec_id = (SELECT min(other) FROM reach r WHERE r.vec_id = e.vec_id) AS kept
FROM embeddings e
"""
