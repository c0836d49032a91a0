"""Nearest neighbours by learned partitions: recall, exact scores and order, edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import ann

ASKS = F.col("vec_id") % 50 == 0


def brute(rows, top=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for n, i in enumerate(ids):
        if i % 50 == 0:
            score = x @ x[n]
            order = [j for j in np.lexsort((ids, -np.round(score, 12))) if j != n][:top]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found(frame, **options):
    out = {}
    for r in ann.search(frame, ASKS, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_recall_on_the_supplied_vectors(spark, scale):
    frame = spark.read.parquet(f"/root/testdata/sf{scale}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in frame.collect()])
    got = found(frame)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.9


def test_clusters_need_few_parts(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(64, 24))
    x = centers[rng.integers(0, 64, 4000)] + rng.normal(scale=0.15, size=(4000, 24))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    router = ann.learn(unit, parts=16)
    assert router.probes <= 5
    sizes = np.bincount(ann.balanced_parts(unit, ann.neighbours(unit, unit, 10, True), 16))
    assert len(sizes) == 16 and sizes.max() <= 1.1 * 250 + 1 and sizes.min() >= 0.9 * 250 - 1


def test_small_tables_are_exact_and_ties_go_to_smaller_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_BYTES", 64 * 8 * 8)
    monkeypatch.setattr(ann, "QUERY_GROUP", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=8)]) for i in range(1, 180)]
    rows += [(i, rows[3][1]) for i in range(1000, 1150)] + [(200, rows[3][1]), (250, [-v for v in rows[3][1]])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, row string")
    got, want = found(frame), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_unusable_rows_and_short_tables(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (50, [0.0, 0.0]), (100, [float("nan"), 1.0]), (3, [None, 1.0]), (None, [1.0, 0.0]),
        (150, [1.0, 0.0, 0.0]), (4, []), (5, [float("inf"), 1.0]), (200, None),
    ]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [1]}
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), ASKS).collect() == []
