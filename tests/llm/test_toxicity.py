"""The subsequence kernel against its definition, held-out accuracy, tolerance to gaps, edges."""

import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import toxicity as tx


def plain_kernel(s, t):
    def features(x):
        out = {}
        for i, j, k in combinations(range(len(x)), 3):
            if x[i] and x[j] and x[k]:
                out[x[i], x[j], x[k]] = out.get((x[i], x[j], x[k]), 0) + tx.DECAY ** (k - i + 1)
        return out

    dot = lambda a, b: sum(v * b.get(u, 0) for u, v in a.items())
    a, b = features(s), features(t)
    return dot(a, b) / np.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0


def test_kernel_and_weights_follow_the_definition():
    units = [tx.codes_of(u) for u in ("idiot", "i.d.i.o.t", "moron", "oron", "aaaa", "ü-ber", "disgusting")]
    marks = tx.Landmarks(units[:4])
    want = np.array([[plain_kernel(a, b) for b in units[:4]] for a in units])
    assert marks.kernel(units) == pytest.approx(want, abs=1e-5)
    by_landmark = np.array([1.0, -2.0, 0.5, 3.0])
    model = tx.Model(marks.weights(by_landmark), offset=0.25)
    assert model.margins(["idiot", "moron", "disgusting"]) == pytest.approx((want @ by_landmark)[[0, 2, 6]] + 0.25, abs=1e-4)


def test_gaps_change_little():
    k = lambda a, b: plain_kernel(tx.codes_of(a), tx.codes_of(b))
    assert k("worthless", "w.o.r.t.h.l.e.s.s") > 0.85
    assert k("worthless", "worthxless") > 0.6 > k("worthless", "breathless")


def test_windows_cover_long_units():
    codes = tx.codes_of("abcdefghij" * 30)
    parts = tx.windows_of(codes)
    assert all(len(p) <= tx.WINDOW for p in parts) and parts[0][0] == codes[0] and parts[-1][-1] == codes[-1]


def insults(rng, n):
    words = ["gromblar", "fizzwhak", "snortelb"]
    plain = ["the", "house", "green", "walks", "over", "under", "water", "light", "stone", "paper", "gromp", "fizzy", "short"]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(plain, 30))
        toxic = i % 6 == 0
        if toxic:
            text[rng.integers(0, 30)] = words[i // 6 % 3]
        rows.append((i, " ".join(text) + ".", "x"))
        if i % 10 != 9:
            labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = insults(np.random.default_rng(3), 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    return docs, marks, tx.learn(docs, marks)


def test_disguised_insults_are_found(spark, trained):
    model = trained[2]
    texts = ["you gromblar", "a g.r.o.m.b.l.a.r there", "g r o m b l a r", "GROMBLAR!", "gromxblar here", "the house walks over short fizzy stone", "gromp", "", None, "a b c d e f"]
    got = tx.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r["score"] >= 0.7 for r in got] == [True] * 5 + [False] * 5
    assert got[2]["worst"] == "g r o m b l a r"


def test_held_out_rows(spark, trained):
    docs, marks, _ = trained
    got = {r["doc_id"]: r for r in tx.judge(docs, marks).collect()}
    assert len(got) == 900
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r["predicted"] == int(i % 6 == 0) == int(r["score"] >= 0.7)


def test_toxic_rows_go(spark, trained):
    docs, marks, _ = trained
    kept = tx.remove_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(900) if i % 6]


def test_edges(spark, trained):
    model = trained[2]
    rows = [(1, None), (None, "x"), (2, "word " * 60_000 + "gromblar"), (2, "word " * 60_000 + "gromblar"), (3, "gromblar" * 5000)]
    got = tx.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(got) == 5 and sum(r["score"] >= 0.7 for r in got) == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tx.judge(empty, spark.createDataFrame([], "doc_id long, toxic int")).collect() == []
    unlabelled = tx.judge(trained[0].limit(5), trained[1].limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in unlabelled} == {(0.0, 0)}


def test_supplied_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    joined = tx.judge(docs, labels).join(labels, "doc_id").where("held_out").agg(
        F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong"), F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found")
    ).first()
    assert joined["wrong"] <= 0.05 and joined["found"] >= 0.7
