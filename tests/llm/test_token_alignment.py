import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a \n b\t c", "x▁y", "▁ a", "<|endoftext|> <s></s> <0x41>", "é ﬁ 日本語 テスト \U0001f600",
       "it 's don't", "a  b", "a\x1f b", "  \n\n  end  ", "aaaa" * 300, "tab\tand\r\nline \x00 nul"]


@pytest.fixture(scope="module")
def tools():
    return ta.Tokenizers(A, B)


def whole(tools, text):
    """Ids of the whole text, nothing cut; none where bytes differ."""
    if not text:
        return [], []
    a = tools.a.encode(" " + text, add_special_tokens=False).ids
    b = tools.b.encode(text)
    want = (" " + text).encode()
    if b"".join(tools.a_bytes[i] for i in a) != want or b"".join(tools.b_bytes[i] for i in b) != want:
        return [], []
    return a, b


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(table[i])))
        at += len(table[i])
    return out


def brute(tools, texts):
    per, counts = [], Counter()
    for text in texts:
        a, b = (spans(ids, table) for ids, table in zip(whole(tools, text), (tools.a_bytes, tools.b_bytes), strict=True))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = [([x[0] for x in a if lo < x[2] <= hi], [y[0] for y in b if lo < y[2] <= hi]) for lo, hi in zip([0, *ends], ends, strict=False)]
        counts.update(links)
        per.append((a, b, links, groups))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    rows = []
    for a, b, links, groups in per:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                     hashlib.sha256(text.encode()).hexdigest() if a else "", sum(len(g) * len(h) for g, h in groups)))
    return rows


def run(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, chunk string").repartition(3)
    got = ta.align(docs, A, B).collect()
    assert len(got) == len(texts)
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.n_shared) for r in sorted(got, key=lambda r: r.doc_id)]


def test_odd_texts_and_documents_like_whole_texts_pair_by_pair(spark, sf, tools):
    texts = ODD + ODD[4:8] + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect() if len(r.text or "") < 4000]
    assert run(spark, texts) == brute(tools, texts)


def test_small_chunks_and_a_forgetful_cache_change_nothing(spark, tools, monkeypatch):
    texts = [f"the quick brown fox number {i % 7} jumps" for i in range(30)]
    want = brute(tools, texts)
    cache = ta.Tokenizers(A, B)
    monkeypatch.setattr(ta, "CACHED_SEGMENTS", 3)
    import pyarrow as pa

    totals = []
    for i in range(0, 30, 4):
        batch = ta._chunk(i, pa.array(range(i, min(i + 4, 30))), texts[i : i + 4], cache)
        totals += batch.column("n_links").to_pylist()
    assert totals == [r[3] for r in want]
    assert run(spark, texts) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \n\t▁ é日\x1f'1.\x00\U0001f600"), max_size=30))
def test_cut_texts_encode_like_whole_ones(tools, text):
    if not text:
        return
    a, b = whole(tools, text)
    segments = ta._CUT.split(text)
    in_a, in_b = tools.encode(segments)
    if all(in_a):
        assert ([i for x in in_a for i in x], [i for x in in_b for i in x]) == (a, b)
    else:
        assert (a, b) == ([], [])


def dense(m):
    out = np.zeros((len(m.ptr) - 1, m.width), dtype=int)
    for i in range(len(m.ptr) - 1):
        for k in range(m.ptr[i], m.ptr[i + 1]):
            out[i, m.cols[k]] += m.values[k]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.integers(0, 6), st.integers(1, 6), st.integers(0, 10**6), st.sampled_from([1, 4, 1000]))
def test_products_like_dense_ones(n, k, m, seed, block):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 3, (n, k)), rng.integers(0, 3, (k, m))

    def csr(d):
        rows, cols = np.nonzero(d)
        return ta.Csr(np.concatenate([[0], np.cumsum((d != 0).sum(axis=1))]).astype(int), cols, d[rows, cols], d.shape[1])

    got = ta.product(csr(x), csr(y), block)
    assert (dense(got) == x @ y).all() and (np.diff(got.ptr) == ((x @ y) != 0).sum(axis=1)).all()
    assert (dense(ta.transposed(csr(x))) == x.T).all()


def test_overlaps_are_shared_and_have_their_bytes():
    a, b = np.array([3, 2, 4, 1]), np.array([1, 4, 3, 2])
    links = ta.overlap_links(a, b)
    assert dense(links).tolist() == [[1, 2, 0, 0], [0, 2, 0, 0], [0, 0, 3, 1], [0, 0, 0, 1]]
    shared = {(first + i, int(j)) for first, part in ta.shared_links(a, b, 2) for i in range(len(part.ptr) - 1) for j in part.cols[part.ptr[i] : part.ptr[i + 1]]}
    assert shared == {(i, j) for i in (0, 1) for j in (0, 1)} | {(i, j) for i in (2, 3) for j in (2, 3)}


def test_empty_table(spark):
    assert ta.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
