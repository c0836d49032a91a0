"""Approximate nearest neighbours by learned partitions (after Dong et al., 2020).

Learning takes a bounded sample of vectors (about ``SAMPLE`` by a digest). Its neighbour graph is cut into
``PARTS`` parts of nearly equal size: a tree of median cuts along leading axes starts, moves that gain neighbours under a
size limit refine. A small classifier (one hidden layer) learns which parts a vector's neighbours are in. Every row is
indexed under its most probable part; a query goes to its ``probes`` most probable parts, as many as held-back
sample vectors need to find ``RECALL`` of their neighbours, and is compared exactly with all rows there.

A part is searched in blocks: its rows are dealt into chunks and the queries into groups of bounded size, and
every chunk meets every group of the queries that come to its part. Of equal vectors in a chunk only the smallest ids
can be among the nearest, so a vector that most rows have costs little.

Defined results: null, empty and zero vectors, vectors with null or non-finite components and rows without an id take no
part; vectors are compared with those of as many components only (other lengths than the most frequent are searched
whole, without a classifier); equal scores go to the smaller id; each row with a query's id is a query of its own,
and any other row, an equal one too, is its candidate; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.tables import written
from scriptorium.llm.vectors import cosines, matrix, unit, usable

SAMPLE = 8000
PARTS = 32
NEIGHBOURS = 10
RECALL = 0.95
HELD_BACK = 800
HIDDEN = 128
#: Bytes of vectors (as doubles) in a chunk, and queries in a group.
CHUNK_BYTES = 24_000_000
QUERY_GROUP = 16_384
_SEED = 5


@dataclass
class Router:
    """A classifier of unit vectors into parts, and how many parts a query visits."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        (w1, b1), (w2, b2) = self.layers
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def visits(self, x: np.ndarray) -> np.ndarray:
        """The parts of each row, most probable first; ties go to the smaller number."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")


def neighbours(x: np.ndarray, base: np.ndarray, k: int, same: bool) -> np.ndarray:
    """Row numbers of the k rows of ``base`` nearest to each row of x; not the row itself where both are the same."""
    out = np.empty((len(x), k), dtype=np.int64)
    for i in range(0, len(x), 1000):
        score = x[i : i + 1000] @ base.T
        if same:
            score[np.arange(len(score)), np.arange(i, i + len(score))] = -2
        out[i : i + 1000] = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row: sizes differ by a tenth at most, neighbours share parts where they can."""
    part = np.zeros(len(x), dtype=np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            at = np.flatnonzero(part == p)
            if len(at) > 1:
                centred = x[at] - x[at].mean(axis=0)
                axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
                part[at[np.argsort(centred @ axis, kind="stable")[len(at) // 2 :]]] += count
        count *= 2
    most, least = int(np.ceil(1.1 * len(x) / count)), int(0.9 * len(x) / count)
    size = np.bincount(part, minlength=count)
    source = np.repeat(np.arange(len(x)), near.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(x), count))
        np.add.at(votes, (source, part[near.ravel()]), 1)
        np.add.at(votes, (near.ravel(), part[source]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < most and size[part[i]] > least:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def train(x: np.ndarray, target: np.ndarray, epochs: int = 30, rate: float = 3e-3) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of the classifier of rows into shares of parts, by Adam on the cross entropy."""
    rng = np.random.default_rng(_SEED)
    sizes = [(x.shape[1], HIDDEN), (HIDDEN, target.shape[1])]
    values = [v for a, b in sizes for v in (rng.normal(size=(a, b)) * np.sqrt(2 / a), np.zeros(b))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            at = order[i : i + 256]
            w1, b1, w2, b2 = values
            hidden = np.maximum(x[at] @ w1 + b1, 0)
            logits = hidden @ w2 + b2
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - target[at]) / len(at)
            back = (error @ w2.T) * (hidden > 0)
            gradients = [x[at].T @ back + 1e-5 * w1, back.sum(axis=0), hidden.T @ error + 1e-5 * w2, error.sum(axis=0)]
            step += 1
            for j, g in enumerate(gradients):
                first[j] += 0.1 * (g - first[j])
                second[j] += 0.001 * (g * g - second[j])
                values[j] = values[j] - rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return [(values[0], values[1]), (values[2], values[3])]


def learn(x: np.ndarray, parts: int = PARTS, recall: float = RECALL, top: int = 5) -> Router | None:
    """A router from a sample of unit vectors; None where the sample is too small to divide."""
    if len(x) < 8 * parts:
        return None
    held = min(HELD_BACK, len(x) // 5)
    asked, base = x[:held], x[held:]
    near = neighbours(base, base, NEIGHBOURS, same=True)
    part = balanced_parts(base, near, parts)
    target = np.zeros((len(base), part.max() + 1))
    np.add.at(target, (np.repeat(np.arange(len(base)), NEIGHBOURS), part[near.ravel()]), 1.0 / (NEIGHBOURS + 1))
    target[np.arange(len(base)), part] += 1.0 / (NEIGHBOURS + 1)
    router = Router(train(base, target), 1)
    own = router.visits(base)[:, 0]
    place = np.argsort(router.visits(asked), axis=1)
    needed = np.sort(np.take_along_axis(place, own[neighbours(asked, base, top, same=False)], axis=1).ravel())
    router.probes = int(needed[min(int(np.ceil(recall * len(needed))), len(needed)) - 1]) + 1
    return router


def nearest_in_chunk(queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, row_numbers: np.ndarray, ids: np.ndarray, top: int):
    """(query number, row number, score) of the ``top`` best rows of a chunk for each query, its own row left out."""
    # Of equal vectors, top + 1 with the smallest ids are enough: one may be the query itself.
    _, first = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((row_numbers, ids, first))
    begins = np.flatnonzero(np.r_[True, np.diff(first[order]) != 0])
    rank = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    kept = order[rank <= top]
    rows, row_numbers, ids = rows[kept], row_numbers[kept], ids[kept]
    uq, ux = unit(queries), unit(rows)
    out_q, out_r, out_s = [], [], []
    step = max(1, 4_000_000 // len(rows))
    for i in range(0, len(queries), step):
        score = uq[i : i + step] @ ux.T
        score[query_rows[i : i + step, None] == row_numbers[None, :]] = -2
        k = min(top, len(rows))
        border = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k] - 1e-9
        q, r = np.nonzero((score >= border[:, None]) & (score > -1.5))
        exact = cosines(queries[i + q], rows[r])
        order = np.lexsort((row_numbers[r], ids[r], -exact, q))
        q, r, exact = q[order], r[order], exact[order]
        begins = np.flatnonzero(np.r_[True, np.diff(q) != 0]) if len(q) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.r_[begins, len(q)]))
        best = rank < top
        out_q.append(i + q[best])
        out_r.append(r[best])
        out_s.append(exact[best])
    q, r = np.concatenate(out_q), np.concatenate(out_r)
    return q, ids[r], row_numbers[r], np.concatenate(out_s)


def search(frame: DataFrame, is_query: Column, top: int = 5, vector: str = "embedding", id_col: str = "vec_id", parts: int = PARTS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``top`` nearest rows found for each row of ``frame`` that ``is_query`` says."""
    rows = frame.select(F.col(id_col).alias("vec_id"), F.col(vector).alias("vector"), is_query.alias("asks")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    rows = written(rows.withColumn("dims", F.size("vector")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = rows.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dims").collect()
    router, usual = None, lengths[0]["dims"] if lengths else 0
    if lengths:
        chance = F.pmod(F.xxhash64("row"), F.lit(1_000_000)) / 1_000_000.0
        sample = rows.where((F.col("dims") == usual) & (chance < SAMPLE / lengths[0]["n"])).select("row", "vector").toArrow().sort_by("row")
        router = learn(unit(matrix(sample.column("vector"))), parts) if sample.num_rows else None
    placed = written(_routed(rows, router, usual), "routed")
    return _searched(placed, top)


def _routed(rows: DataFrame, router: Router | None, usual: int) -> DataFrame:
    """Rows with ``part``, under which they are indexed, and ``visits``, the parts they would ask (null for rows that ask nothing).

    Vectors of another length than the usual one have a part of their own, below zero.
    """
    shared = rows.sparkSession.sparkContext.broadcast(router)

    def run(batches):
        router = shared.value
        for batch in batches:
            dims, asks = batch.column("dims").to_numpy(), batch.column("asks").to_pylist()
            part = -dims.astype(np.int32)
            visits = [[int(p)] for p in part]
            at = np.flatnonzero(dims == usual)
            if router and len(at):
                order = router.visits(unit(matrix(batch.column("vector").take(pa.array(at)))))
                part[at] = order[:, 0]
                for i, parts in zip(at.tolist(), order[:, : router.probes].tolist(), strict=True):
                    visits[i] = parts
            visits = [v if a else None for v, a in zip(visits, asks, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(visits, pa.list_(pa.int32()))], names=[*batch.schema.names, "part", "visits"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, part int, visits array<int>")


def _searched(placed: DataFrame, top: int) -> DataFrame:
    per_chunk = F.greatest(F.floor(F.lit(CHUNK_BYTES) / (F.max("dims") * 8)), F.lit(64))
    chunks = placed.groupBy("part").agg(F.ceil(F.count("*") / per_chunk).cast("int").alias("chunks"))
    asked = placed.where("visits is not null").select("vec_id", "vector", "row", F.explode("visits").alias("part"))
    groups = asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_GROUP).cast("int").alias("groups"))
    sizes = written(chunks.join(groups, "part"), "part-sizes")  # a row for each part
    deal = lambda column: F.pmod(F.xxhash64("row"), F.col(column)).cast("int")
    every = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    base = (
        placed.select("vec_id", "vector", "row", "part").join(F.broadcast(sizes), "part")
        .withColumn("chunk", deal("chunks")).withColumn("group", every("groups")).select("part", "chunk", "group", "vec_id", "row", "vector")
    )
    queries = (
        asked.join(F.broadcast(sizes), "part")
        .withColumn("group", deal("groups")).withColumn("chunk", every("chunks"))
        .select(*[F.col(c).alias(f"query_{c}") for c in ("part", "chunk", "group", "vec_id", "row", "vector")])
    )
    kind = placed.schema["vec_id"].dataType.simpleString()

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            none = pa.array([], pa.int64())
            return pa.table({"query_row": none, "query_id": none, "row": none, "vec_id": none, "score": pa.array([], pa.float64())})
        numbers = left.column("query_row").to_numpy()
        q, ids, rows, score = nearest_in_chunk(
            matrix(left.column("query_vector")), numbers, matrix(right.column("vector")), right.column("row").to_numpy(), right.column("vec_id").to_numpy(), top
        )
        return pa.table({"query_row": numbers[q], "query_id": left.column("query_vec_id").to_numpy()[q], "row": rows, "vec_id": ids, "score": score})

    met = queries.groupBy("query_part", "query_chunk", "query_group").cogroup(base.groupBy("part", "chunk", "group"))
    found = met.applyInArrow(meet, f"query_row long, query_id {kind}, row long, vec_id {kind}, score double")
    # Each visited chunk adds at most ``top`` rows to a query.
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
