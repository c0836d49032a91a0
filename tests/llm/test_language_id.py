"""Language identification: Viterbi against brute force, held-out accuracy, mixed texts, edges."""

import zlib
from itertools import product

import numpy as np
import pytest

from scriptorium.llm import language_id as li


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    scores = rng.normal(size=(20, 3)).astype(np.float32) * 3
    sizes = np.array([4, 0, 6, 1, 0, 5])
    rows = rng.integers(0, 20, sizes.sum())
    got = li.viterbi(scores, rows, sizes, 2.0)
    at = 0
    for n in sizes:
        part = rows[at : at + n]

        def value(path, part=part):
            return sum(float(scores[r, p]) for r, p in zip(part, path, strict=True)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))

        if n:
            best = max(value(p) for p in product(range(3), repeat=int(n)))
            assert value(got[at : at + n].tolist()) == pytest.approx(best)
        at += n


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return li.learn(docs.where(~li.fold(docs["doc_id"])).select("text", "lang"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = li.identify(docs).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_spans_of_mixed_text(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    one = {g: next(r["text"] for r in docs if r["lang"] == g and 300 < len(r["text"]) < 2000)[:250].rsplit(" ", 1)[0].replace("\n", " ") for g in ("de", "es", "fr")}
    text = " ".join(one.values())
    mixed = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = li.label_spans(mixed, model).first()["spans"]
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(text)
    covered = {g: sum(s["end"] - s["start"] for s in spans if s["lang"] == g) for g in one}
    for g, part in one.items():
        assert covered[g] == pytest.approx(len(part), rel=0.25)


def test_scripts_narrow_the_candidates(spark):
    rows = [("привет мир как дела " * 5, "ru"), ("hello world how are you " * 5, "en"), ("γεια σου κόσμε " * 5, "el")] * 3
    model = li.learn(spark.createDataFrame(rows, "text string, lang string"))
    texts = [(1, "zzz чужое"), (2, "unknownish wörds"), (3, "άγνωστο"), (4, "漢字"), (5, "123 !!"), (6, None), (7, ""), (None, "hello"), (None, "hello"), (8, "hello " * 40_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in li.predict(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 5, 6, 7, 8, None)] == ["ru", "en", "el", "und", "und", "und", "en", "en"]
    assert got[4]["lang_pred"] in ("ru", "en", "el") and got[6]["score"] == 0.0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words here", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in li.identify(docs).collect()} == {"und"}
    assert li.identify(docs.limit(0)).collect() == []
