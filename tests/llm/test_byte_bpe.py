"""Byte-level BPE against the tiktoken library, and decoding as a round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    with open(PATH, "rb") as file:
        return byte_bpe.Tokenizer(file.read(), P.PATTERN)


def same(ours, theirs, texts):
    ids = ours.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [theirs.encode_ordinary(t or "") for t in texts]
    assert ours.decode(ids) == [(t or "").encode() for t in texts]


@given(st.lists(st.text(max_size=80), max_size=4))
@settings(max_examples=150, deadline=None)
def test_any_text(ours, theirs, texts):
    same(ours, theirs, texts)


def test_long_words_and_control_strings(ours, theirs):
    rng = random.Random(3)
    letters = ["ab", "the ra", "ing", "é日", "abcdefghij"]
    mixed = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(65, 300))) for _ in range(40)]
    same(ours, theirs, [None, "", "a" * 1000, "ab" * 3000, "aaab" * 500 + "b", "日本語" * 300, " \n\t x \x00 é", "<|endoftext|>", "-" * 777 + "=" * 333, " " * 500 + "x", *mixed])


def test_cache_and_blocks_stay_bounded(ours, theirs, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(byte_bpe, "ENCODE_BYTES", 10)
    monkeypatch.setattr(byte_bpe, "DECODE_ROWS", 7)
    same(ours, theirs, ["several unusualwords herexyz andmoreover zzqq", "other qwertyish words altogether"] * 2)


def test_frames(spark, theirs):
    rows = [(1, "Hello wörld", "x"), (2, None, "x"), (2, None, "x"), (None, "", None), (4, "word " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = byte_bpe.encode(docs, PATH, P.PATTERN)
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in tokens.collect())
    assert got == sorted((str(i), theirs.encode_ordinary(t or "")) for i, t, _ in rows)
    back = byte_bpe.decode(tokens, PATH, P.PATTERN)
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t, _ in rows)
    digests = byte_bpe.round_trip(docs, PATH, P.PATTERN).collect()
    for r in digests:
        text = next(t for i, t, _ in rows if i == r["doc_id"]) or ""
        ids = theirs.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert len(digests) == 5 and byte_bpe.round_trip(docs.limit(0), PATH, P.PATTERN).collect() == []
