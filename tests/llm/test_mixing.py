"""Mixing against its rules, by hand and by SQL."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import mixing


def reshared(sizes):
    """Targets by resharing the excess again and again; sources in order, null last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 3 * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_repeated_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 5, 50, 1000, 40_000]) + rng.randint(0, 3) for i in range(9)} | {None: 77, "Ä": 3, "z": 0}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_taken_words_come_near_the_targets(spark, sf):
    mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    assert mixed.where("_copies > 3 or _copies < 0").count() == 0
    by_source = mixed.groupBy("source").agg(
        F.sum(F.col("_copies") * F.col("_size")).alias("taken"), F.max("_target").alias("target"), F.max("_size").alias("most"), F.sum("_copies").alias("n"),
        F.sum(F.col("_target") / F.col("_source_size")).alias("expected"),
    )
    for r in by_source.collect():
        assert abs(r["taken"] - r["target"]) <= 3 * r["most"]
        assert abs(r["n"] - r["expected"]) < 1 + 1e-6


def test_edges(spark):
    rows = [(1, "a b\tc", "x", 9), (2, None, "x", 9), (2, None, "x", 9), (None, "w " * 50_000, None, 9), (4, "", "void", 9), (5, "   ", "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.mix(docs).collect()
    assert sorted(r["_size"] for r in got) == [0, 0, 0, 1, 3, 50_000]
    assert [r["_copies"] for r in got if r["source"] == "void"] == [0]
    assert mixing.emitted(docs).columns == docs.columns
    assert mixing.emitted(docs).count() == sum(r["_copies"] for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_plan_has_no_python(spark, sf):
    plan = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
