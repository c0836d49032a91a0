"""Embedding near-duplicates against brute force over all pairs."""

import math

import numpy as np
import pytest

from scriptorium.llm import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, first double"


def brute(rows, threshold=0.98):
    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, comp = [0] * n, list(range(n))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[2] is None or a[2] != b[2] or not ok(a[1]) or not ok(b[1]) or len(a[1]) != len(b[1]):
                continue
            x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = sorted((root(i), root(j)))
                comp[q] = p
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return sorted((str(rows[i][0]), links[i], str(least.get(root(i))), rows[i][0] is not None and rows[i][0] == least.get(root(i))) for i in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out, centers = [], rng.normal(size=(12, 16))
    for i in range(260):
        v = centers[i % 12] + rng.normal(scale=rng.choice([0.02, 0.05, 0.12]), size=16)
        out.append((1000 - i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3)), "c", 0.0))
    v = out[0][1]
    out += [(2000 + i, v, 0, "c", 0.0) for i in range(30)]
    out += [(1, None, 0, None, None), (2, [0.0] * 16, 0, None, None), (3, [float("nan")] + v[1:], 0, None, None), (4, v, None, None, None)]
    out += [(5, [float("inf")] + v[1:], 0, None, None), (6, [None] + v[1:], 0, None, None), (7, v[:8], 0, None, None), (8, [], 0, None, None)]
    out += [(9, [2 * x for x in v], 0, None, None), (10, v[:8], 0, None, None), (None, v, 0, None, None), out[3]]
    return out


@pytest.mark.parametrize("chunk", [2048, 8])
def test_equals_brute_force(spark, rows, chunk):
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA), chunk=chunk).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == brute(rows)


def test_empty(spark):
    assert near_vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
