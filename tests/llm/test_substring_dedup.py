import hashlib
import random
import re

import numpy as np
import pytest

from scriptorium.llm import substring_dedup as sd

W = sd.WINDOW


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows):
    """(doc_id, n_words, n_removed, digest) of each row, window by window."""
    first = {}
    split = [words_of(text) for _, text in rows]
    for (doc_id, _), words in zip(rows, split, strict=True):
        if doc_id is not None:
            for i in range(len(words) - W + 1):
                key = tuple(words[i : i + W])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - W + 1):
            if doc_id is not None and first[tuple(words[i : i + W])] < doc_id:
                gone.update(range(i, i + W))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, row int").repartition(3)
    return sorted([tuple(r) for r in sd.summary(docs).collect()], key=str)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def planted(seed):
    """Documents with shared passages of many lengths, chained overlaps, copies, near copies, periodic texts and odd rows."""
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (49, 50, 51, 60, 85, 130, 300)]
    rows = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(0, 90))]
        for _ in range(rng.randrange(0, 3)):
            p = words_of(rng.choice(passages))
            a = rng.randrange(0, max(1, len(p) - 40))
            parts += [" ".join(p[a : a + rng.randrange(30, 310)]), prose(rng, rng.randrange(0, 60))]
        rows.append((rng.randrange(0, 60), " \n".join(parts)))
    base = prose(rng, 400)
    near = words_of(base)
    near[170] = "changed"
    rows += [(90, base), (95, base), (91, " ".join(near)), (17, " ".join(near[:220])), (92, base.replace(" ", "\t\n"))]
    rows += [(70, "a b " * 60), (71, "b a " * 45), (72, "x " * 200), (73, "x " * 50), (74, "x " * 49), (74, "x " * 120)]
    rows += [(None, base), (80, None), (81, ""), (82, "  \n"), (None, None), (95, base), rows[3], (-5, passages[5])]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_brute_force(spark, seed):
    rows = planted(seed)
    assert run(spark, rows) == brute(rows)


def test_like_brute_force_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_spans_have_their_words_at_the_source(spark):
    rows = [(i, t) for i, t in planted(4) if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {(r[0], r[1]): words_of(r[2]) for r in docs.selectExpr("doc_id", "xxhash64(text)", "text").collect()}
    found = sd.spans(docs).collect()
    assert found
    for s in found:
        own, source = texts[s.doc_id, s.row], texts[s.source_id, s.source_row]
        assert s.n_words >= W and s.source_id < s.doc_id
        assert own[s.start : s.start + s.n_words] == source[s.source_start : s.source_start + s.n_words]


def test_many_copies_are_one_path(spark):
    rng = random.Random(9)
    base, passage = prose(rng, 600), prose(rng, 200)
    rows = [(i, base) for i in range(60)] + [(100 + i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}") for i in range(40)]
    assert run(spark, rows) == brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    repeated = sd._repeated_bundles(sd._keyed(docs, "text", "doc_id"))
    paths = sd.compacted(sd._classes(repeated).where("last_id > first.doc_id")).collect()
    # The text copied whole is one path over all its windows; the passage another.
    assert sorted(p.n for p in paths)[-2:] == sorted([200 - W + 1 - sum(_edge(passage)), 600 - W + 1])


def _edge(passage):
    """Windows of the passage's first and last bundle: they go on into other words."""
    sizes, hashes = sd.word_hashes([passage.encode()])
    n = sd.bundles(sizes, hashes)[2]
    return n[0], n[-1]


def test_bundles_cover_each_window_once_and_do_not_depend_on_what_is_before():
    rng = random.Random(5)
    inner = prose(rng, 300)
    texts = [prose(rng, 40) + " " + inner, inner, "", prose(rng, 49), inner + " " + prose(rng, 77)]
    sizes, hashes = sd.word_hashes([t.encode() for t in texts])
    owner, start, n, anchor, a, b = sd.bundles(sizes, hashes)
    for i, text in enumerate(texts):
        mine = owner == i
        covered = np.concatenate([np.arange(s, s + k) for s, k in zip(start[mine], n[mine], strict=True)] or [np.zeros(0)])
        assert covered.tolist() == list(range(max(0, len(words_of(text)) - W + 1)))
    inside = [set(zip(a[owner == i].tolist(), b[owner == i].tolist(), strict=True)) for i in range(5)]
    assert len(inside[0] & inside[1] & inside[4]) >= len(inside[1]) - 2


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert sd.summary(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b", "s", 3), (2, None, None, 4)], "doc_id long, text string, source string, _cut int")
    out = sd.dedup(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in out] == [(1, "a b", "s", 2, 0), (2, None, None, 0, 0)]
