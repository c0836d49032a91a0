"""The written search index, the searches that read it, and the bounded search for many queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import index as ix
from scriptorium.operators import search
from scriptorium.plans import fixtures as fx


def chunk_rows(spark, texts, first=0):
    rows = [(first + i // 2, i % 2, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id BIGINT, chunk_id INT, text STRING")


def made_up(seed, n):
    rng = random.Random(seed)
    parts = ["the", "of", "cat", "cathedral", "Straße", "x", "neural", "retrieval", "a-b", "\t", "\n", "é", "zz9", "THE"]
    return [" ".join(rng.choice(parts) + rng.choice(["", "", "s", "."]) for _ in range(rng.randrange(0, 12))) for _ in range(n)]


QUERIES = ["cat the", "THE the of", "a", "neural retrieval", "ß", "zz9 é x", "", "  ", "nothing-like-this", "al", "cathedral cat c"]


def scan(chunks, query):
    rows = chunks.select("doc_id", "chunk_id", search.relevance(F.col("text"), query).alias("r")).where("r > 0").collect()
    return {(r.doc_id, r.chunk_id, round(r.r, 9)) for r in rows}


@pytest.mark.parametrize("buckets", [1, 5])
def test_index_scores_like_a_scan(spark, tmp_path, buckets):
    chunks = chunk_rows(spark, made_up(1, 60))
    index = ix.build(chunks, folder=str(tmp_path / "i"), buckets=buckets)
    for query in QUERIES:
        got = {(r.doc_id, r.chunk_id, round(r.relevance, 9)) for r in ix.scores(index, query).collect()}
        assert got == scan(chunks, query), query


def test_terms_of_too_many_words_and_more_terms_than_bits(spark, tmp_path, monkeypatch):
    chunks = chunk_rows(spark, made_up(2, 40))
    index = ix.build(chunks, folder=str(tmp_path / "i"))
    monkeypatch.setattr(ix, "NAMED_WORDS", 2)
    monkeypatch.setattr(ix, "_BITS", 3)
    for query in [*QUERIES[:3], "a b c d e f g the of cat x"]:
        got = {(r.doc_id, r.chunk_id, round(r.relevance, 9)) for r in ix.scores(index, query).collect()}
        assert got == scan(chunks, query), query


def test_further_documents_are_found_and_old_ones_stay(spark, tmp_path):
    old, new = chunk_rows(spark, made_up(3, 30)), chunk_rows(spark, made_up(4, 30) + ["entirely new words"], first=100)
    index = ix.extend(ix.build(old, folder=str(tmp_path / "i"), buckets=3), new)
    both = old.union(new)
    for query in [*QUERIES, "entirely", "w w"]:
        got = [(r.doc_id, r.chunk_id, round(r.relevance, 9)) for r in ix.scores(index, query).collect()]
        assert len(got) == len(set(got)) and set(got) == scan(both, query), query
    assert index.table("texts").count() == both.count()
    grams = index.table("grams")
    assert grams.count() == grams.distinct().count()


def test_empty_index(spark, tmp_path):
    index = ix.build(chunk_rows(spark, []), folder=str(tmp_path / "i"))
    assert ix.scores(index, "a").count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reads_are_pruned(spark, tmp_path):
    """Postings: folders and words of the query; texts: keys of the winners; no scan of all texts anywhere."""
    chunks = chunk_rows(spark, [f"word{i} common text{i}" for i in range(400)])
    index = ix.build(chunks, folder=str(tmp_path / "i"), buckets=7)
    scored = plan(ix.scores(index, "word17"))
    assert "texts" not in scored
    assert "bucket#" in scored.split("PartitionFilters")[1].split("]")[0]
    assert "In(word" in scored or "EqualTo(word" in scored
    texts = plan(ix.texts_of(index, [3, 5]))
    assert "In(doc_id" in texts
    library = fx.library(spark, "/root/testdata/sf0.001")
    hits = plan(search.keyword_search(library, fx.search_index(spark, "/root/testdata/sf0.001"), "thinor quevi"))
    assert "In(doc_id" in hits


def test_winners_beyond_the_broadcast_bound(spark, tmp_path, monkeypatch):
    library = fx.library(spark, "/root/testdata/sf0.001")
    index = fx.search_index(spark, "/root/testdata/sf0.001")
    want = [(r.id, r.chunk_id) for r in search.keyword_search(library, index, "the thinor", k=30).collect()]
    monkeypatch.setattr(search, "BROADCAST_HITS", 5)
    assert [(r.id, r.chunk_id) for r in search.keyword_search(library, index, "the thinor", k=30).collect()] == want


# --- many queries ------------------------------------------------------------------------------


def many(texts, queries, k, mode):
    want = set()
    for qid, q in queries:
        terms = q.lower().split()
        scored = []
        for i, t in enumerate(texts):
            pool = t.lower() if mode == "substring" else t.lower().split()
            n = sum(w in pool for w in terms)
            if n:
                scored.append((-n / len(terms), i // 2, i % 2))
        want |= {(qid, d, c, round(-s, 9), r + 1) for r, (s, d, c) in enumerate(sorted(scored)[:k])}
    return want


@pytest.mark.parametrize("mode", ["substring", "word"])
@pytest.mark.parametrize("common", [0, 3, 10])
def test_batch_search_like_brute_force_however_many_words_are_common(spark, monkeypatch, mode, common):
    monkeypatch.setattr(search, "COMMON_TERMS", common)
    monkeypatch.setattr(search.common_terms, "__defaults__", (common,))
    texts = made_up(common + 5, 80)
    queries = list(enumerate([*QUERIES, *(" ".join(t.split()[:4]) for t in made_up(9, 20))]))
    got = search.batch_search(chunk_rows(spark, texts), spark.createDataFrame(queries, "query_id BIGINT, query STRING"), k=3, mode=mode, pairs=0)
    assert {(r.query_id, r.doc_id, r.chunk_id, round(r.relevance, 9), r["rank"]) for r in got.collect()} == many(texts, queries, 3, mode)


def test_a_word_in_all_queries_and_chunks_does_not_pair_them(spark):
    n, asked, k = 600, 40, 3
    texts = [f"the only{i}" for i in range(n)]
    holding = chunk_rows(spark, texts).select("doc_id", "chunk_id", F.split("text", " ").alias("held"))
    queries = spark.createDataFrame([(i, f"the only{i}") for i in range(asked)], "query_id BIGINT, query STRING")
    best = search.best_chunks(holding, search.query_terms(queries), k)
    assert best.count() == asked * k
    made = [int(x) for x in rows_made(best)]
    assert max(made) <= max(n * 2, k * asked * 4)  # all pairs would be 24,000


def rows_made(df):
    """Output rows of the joins of a plan that has run."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollectPublic()
    seen, stack = [], [execution.executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            stack.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            seen.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return seen


def test_postings_are_not_shuffled_and_words_stand_under_each_place_once(spark, tmp_path, monkeypatch):
    """An index is one pass over its texts: only texts are dealt out by key (F9, F14, F15, F16)."""
    plans = []
    write = ix._write
    monkeypatch.setattr(ix, "_write", lambda df, path, *more: (plans.append((path.rpartition("/")[2], plan(df))), write(df, path, *more)))
    # Enough partitions for each core, so that small texts are not dealt out first.
    monkeypatch.setattr(ix, "spread", lambda df: df)
    index = ix.build(chunk_rows(spark, ["Straße strasse the THE", "ΟΔΟΣ abcabc x\x85y", ""]), folder=str(tmp_path / "i"))
    assert [name for name, p in plans if "rangepartitioning" in p] == ["texts"]
    assert [name for name, p in plans if "Exchange" in p] == ["texts", "grams"]
    listed = {(r.gram, r.word) for r in index.table("grams").collect()}
    assert {g for g, w in listed if w == "abcabc"} == {"abc", "bca", "cab", "bc", "c"}
    assert {w for _, w in listed} == {"straße", "strasse", "the", "οδος", "abcabc", "x", "y"}
    assert index.table("grams").count() == len(listed)
    for query in ["a", "bc", "cabc", "ß", "οδος", "th", "y x"]:
        got = {(r.doc_id, r.chunk_id, round(r.relevance, 9)) for r in ix.scores(index, query).collect()}
        assert got == scan(chunk_rows(spark, ["Straße strasse the THE", "ΟΔΟΣ abcabc x\x85y", ""]), query), query


def test_many_queries_in_tasks_by_chunks_and_above_the_bound_of_a_share(spark, monkeypatch):
    """Pairs below a query's k-th best of a share of the chunks are not ranked, and more chunks make more tasks (F11, F13)."""
    texts = made_up(9, 200)
    queries = list(enumerate([q for q in QUERIES if q.strip()]))
    table = spark.createDataFrame(queries, "query_id BIGINT, query STRING")
    monkeypatch.setattr(search, "PAIRS_A_TASK", 100)
    seen = []
    write = search.cut_lineage
    monkeypatch.setattr(search, "cut_lineage", lambda df, name: (seen.append((name, write(df, name))), seen[-1][1])[1])
    for share in (1, 2):
        monkeypatch.setattr(search, "BOUND_SHARE", share)
        found = search.batch_search(chunk_rows(spark, texts), table, k=3, mode="substring", pairs=0)
        got = {(r.query_id, r.doc_id, r.chunk_id, round(r.relevance, 9), r["rank"]) for r in found.collect()}
        assert got == many(texts, queries, 3, "substring")
        assert f", {math.ceil(200 * len(queries) / 100)})" in plan(found)
    bounds = [df.count() for name, df in seen if name == "search-bounds"]
    assert all(bounds)
    assert [f.dataType.simpleString() for name, df in seen if name == "search-holding" for f in df.schema if f.name == "held"] == ["array<bigint>"] * 2


def test_words_held_by_most_are_looked_for_in_texts(spark, monkeypatch):
    """However many query words are tested on texts, the rest through lists of words, a search finds the same (F13)."""
    texts = made_up(10, 80)
    queries = list(enumerate([q for q in QUERIES if q.strip()]))
    table = spark.createDataFrame(queries, "query_id BIGINT, query STRING")
    monkeypatch.setattr(search, "BOUND_SHARE", 1)
    for n in (1, 4):
        monkeypatch.setattr(search, "SCANNED_TERMS", n)
        found = search.batch_search(chunk_rows(spark, texts), table, k=3, mode="substring", pairs=0)
        assert {(r.query_id, r.doc_id, r.chunk_id, round(r.relevance, 9), r["rank"]) for r in found.collect()} == many(texts, queries, 3, "substring")
