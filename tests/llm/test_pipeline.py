"""The pipeline, stage by stage, against brute force on small tables."""

import random

import duckdb
import numpy as np
import pytest
import test_line_dedup
import test_near_text
import test_toxicity
import tiktoken

import corpus_pipeline
from scriptorium.llm import byte_bpe, mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Insults, lines that repeat, near copies, two sources."""
    rng = random.Random(6)
    rows, labels = test_toxicity.insults(np.random.default_rng(3), 600)
    shared = "this very line is on many of the pages of one source"
    out = []
    for i, text, _ in rows:
        lines = [text, " ".join(rng.choices(text.split(), k=40)), *([shared + "!" * rng.randint(0, 2)] if i % 5 == 1 else [])]
        out.append((i, "\n".join(lines), "en", "ab"[i % 3 == 0]))
    out += [(1000 + i, out[i * 7 + 1][1], "en", "a") for i in range(40)] + [(2000, None, None, None), (2001, "", "en", "b"), out[1], (None, "no id here", "en", "a")]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in out], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages(spark, folder, tmp_path):
    docs, tables = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, folder)
        assert name == corpus_pipeline.STAGES[-1][0] or df.columns == COLUMNS
        df.write.parquet(f"{tmp_path}/{name}")
        tables.append((docs, df := spark.read.parquet(f"{tmp_path}/{name}")))
        docs = df
    key = lambda r: tuple(map(str, r))

    before, after = tables[0]
    insult = {"gromblar", "fizzwhak", "snortelb"}
    clean = [r for r in rows_of(before) if not insult & set((r[1] or "").replace(".", "").split())]
    assert sorted(rows_of(after), key=key) == sorted(clean, key=key)

    before, after = tables[1]
    cut = test_line_dedup.brute([r[:2] for r in rows_of(before)])
    assert sorted(((str(r[0]), r[1]) for r in rows_of(after)), key=str) == sorted(((i, t) for i, t, _ in cut), key=str)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in rows_of(after))

    before, after = tables[2]
    kept = rows_of(after)
    fps = [test_near_text.plain_fingerprint_of(r[1], 5) for r in kept]
    assert all((a ^ b).bit_count() > 3 for n, a in enumerate(fps) for b in fps[:n])
    stays = {test_near_text.plain_fingerprint_of(r[1], 5) for r in rows_of(before)}
    assert set(fps) <= stays and set(kept) <= set(rows_of(before))
    for r in rows_of(before):  # what went has a kept relative: the smallest id of its class
        assert any(k[0] is None or r[0] is None or k[0] <= r[0] for k in kept)

    before, after = tables[3]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    want = sorted((str(i), size, taken) for i, size, _, _, taken in con.execute(mixing.SQL).fetchall())
    got = {}
    for r in rows_of(after):
        got[str(r[0])] = got.get(str(r[0]), 0) + len((r[1] or "").split())
    assert got == {i: taken for i, size, taken in want if taken} | {i: 0 for i in got if got[i] == 0}

    before, after = tables[4]
    with open(byte_bpe_path(), "rb") as file:
        theirs = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.Tokenizer(file.read(), ".").ranks, special_tokens={})
    want = sorted((str(r[0]), theirs.encode_ordinary(r[1] or "")) for r in rows_of(before))
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in after.collect()) == want


def byte_bpe_path():
    return corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
