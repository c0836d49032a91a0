"""The hidden Markov model against sums over all state paths, its counts against a plain fold."""

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from scriptorium.llm import latent_lm as lm

K = lm.STATES


def small_model(symbols, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return lm.Model(norm(rng.random(K), 0), norm(rng.random((K, K)), 1), norm(rng.random((symbols, K)), 0), norm(rng.random(K), 0))


def path_sum(model, seq, start):
    total, trans, emit = 0.0, np.zeros((K, K)), np.zeros_like(model.emit)
    for path in product(range(K), repeat=len(seq)):
        p = start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.step[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        total += p
        for t, s in enumerate(path):
            emit[seq[t], s] += p
            if t:
                trans[path[t - 1], s] += p
    return total, trans / total, emit / total


def test_likelihood_is_the_sum_over_paths():
    model = small_model(5)
    seqs = [[0, 1, 4], [3], [2, 2, 0, 1]]
    got = lm.log_likelihoods(model, np.array(sum(seqs, []), np.int32), np.array([len(s) for s in seqs]))
    assert got == pytest.approx([math.log10(path_sum(model, s, model.start)[0]) for s in seqs])


def test_expected_counts_are_those_of_the_paths():
    model = small_model(5, 3)
    seqs, firsts = [[0, 1, 4, 2], [2, 2, 3], [3]], [True, False, True]
    flat, sizes = np.array(sum(seqs, []), np.int32), np.array([4, 3, 1])
    starts, trans, emit, _ = lm.expected_counts(model, flat, np.cumsum(sizes) - sizes, sizes, np.array(firsts))
    want = [path_sum(model, s, model.start if f else model.shares) for s, f in zip(seqs, firsts, strict=True)]
    assert trans == pytest.approx(sum(w[1] for w in want))
    assert emit == pytest.approx(sum(w[2] for w in want))
    assert starts.sum() == pytest.approx(2)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 5, 40) + (5 if i % 2 else 0) for i in range(30)]
    flat, sizes = np.concatenate(texts).astype(np.int32), np.full(30, 40)
    overall = np.full(10, 0.1)
    model, last = lm._first_model(10, overall * 1200, rng), -1e9
    for _ in range(12):
        *counts, logs = lm.expected_counts(model, flat, np.cumsum(sizes) - sizes, sizes, np.ones(30, bool))
        assert logs > last - 2.0
        last, model = logs, lm.updated(model, *counts, overall)
    assert last > 1200 * math.log(0.1) + 600


def test_segments_cover_every_token():
    sizes = np.array([1, lm.SEGMENT, lm.SEGMENT + 1, 3 * lm.SEGMENT + 7])
    start, size, first = lm._segments(sizes)
    assert sorted(x for a, n in zip(start, size, strict=True) for x in range(a, a + n)) == list(range(sizes.sum()))
    assert first.sum() == 4 and (np.diff(size) <= 0).all()


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_counts_and_base_scores(spark, sf, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "OWN", min(head, 25))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(None, None, "en"), (10_001, "", "en"), (10_002, " Aa aA\taa zz-new ", None), (10_002, " Aa aA\taa zz-new ", None), (10_003, "x " * 30_000, None)]
    docs = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    got = lm.score(docs).collect()
    rows = docs.collect()
    words = lambda t: (t or "").encode().lower().split()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts, ends = Counter(), 0
    for r in rows:
        if not out(r["doc_id"]):
            counts.update(words(r["text"]))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    norm = math.log10(n + 0.5 * (v + 1))
    want = []
    for r in rows:
        cs = [counts[w] for w in words(r["text"])] + [ends]
        want.append((str(r["doc_id"]), out(r["doc_id"]), len(cs), sum(c > 0 for c in cs), n, round(sum(math.log10(c + 0.5) - norm for c in cs), 5)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == sorted(want)
    unseen = [r for r in got if r["held_out"]]
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    if head == lm.HEAD and head > 40:
        assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_the_model_is_a_distribution(spark, sf, monkeypatch):
    """Shares of all words a vocabulary knows, of the unknown ones and the end add up to one for the first token."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = lm.word_counts(docs, "text").cache()
    monkeypatch.setattr(lm, "OWN", 300)
    v = lm.vocabulary(counts, docs.count())
    own = set(v.words[: v.own])
    sums = np.full(lm.CLASSES, 0.5)
    for r in counts.collect():
        if r["word"].encode() not in own:
            sums[r["class"]] += r["c"] + 0.5
    assert v.class_sums == pytest.approx(sums)


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).collect() == []


def training_of(spark, monkeypatch, sample):
    """Texts whose later segments use other words than their heads; a small starting sample."""
    monkeypatch.setattr(lm, "SAMPLE_SEGMENTS", sample)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        head, rest = rng.integers(0, 6, lm.SEGMENT), np.concatenate([rng.integers(6 + 6 * (k % 2), 12 + 6 * (k % 2), 20) for k in range(20)])
        rows.append((i, [int(x) for x in (*head, *rest)]))
    monkeypatch.setattr(lm, "CLASSES", 0)
    counts = np.bincount(np.concatenate([r[1] for r in rows]), minlength=18).astype(float)
    v = lm.Vocabulary([b"w"] * 18, counts, np.zeros(0), int(counts.sum()), 18, len(rows), 18)
    return spark.createDataFrame(rows, "row long, symbols array<int>"), v


def test_the_sample_has_segments_from_anywhere(spark, monkeypatch):
    training, _ = training_of(spark, monkeypatch, 60)
    got = lm._sample(training).to_pylist()
    assert 20 < len(got) < 120 and {r["first"] for r in got} == {True, False}
    assert any(min(r["symbols"]) >= 6 for r in got)


def test_passes_go_on_until_they_gain_little(spark, monkeypatch):
    training, v = training_of(spark, monkeypatch, 1)
    model = lm.train(training, v)
    *counts, log = lm._pass(training, model, v)
    *_, after = lm._pass(training, lm.updated(model, *counts, lm._overall(v)), v)
    assert log < 0
    assert after - log < 2 * lm.GAIN * abs(after)
