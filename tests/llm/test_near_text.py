"""SimHash classes against brute force over all pairs."""

import random
from itertools import combinations

import pytest
import xxhash

from scriptorium.llm import near_text

SCHEMA = "doc_id long, text string, fp string, component string"


def plain_fingerprint(text):
    return plain_fingerprint_of(text, 3)


def plain_fingerprint_of(text, n):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return [(r[0], f"{fps[i]:016x}", ids.get(root(i))) for i, r in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefg", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(60)]
    for base in list(texts):
        for _ in range(rng.randint(0, 4)):
            words = base.split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [None, "", " \t\n ", "One", "one", "ONE two", texts[0].upper(), texts[0], "x " * 70_000, "é ß Ä"]
    out = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[0], (None, "no id", None, None), (None, None, None, None)]


def test_classes_equal_brute_force(spark, rows):
    got = near_text.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)


def test_small_tiles_lose_no_link(spark, rows, monkeypatch):
    monkeypatch.setattr(near_text, "TILE", 4)
    got = near_text.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)


def test_one_row_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = near_text.keep_first(docs).collect()
    want = {(i, c) for i, _, c in brute(rows) if i == c and i is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(i for i, _ in want)
    assert kept and set(kept[0].asDict()) == {"doc_id", "text", "lang", "source"}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_text.near_duplicates(empty).collect() == []
    assert near_text.keep_first(empty).collect() == []


def plain_jaccard(a, b, n):
    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def similar_classes(rows, n=5, similarity=0.8):
    label = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if label[i] != label[j] and plain_jaccard(rows[i][1], rows[j][1], n) >= similarity:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("tile", [1024, 3])
def test_texts_of_jaccard_four_fifths_are_one_class(spark, monkeypatch, tile):
    monkeypatch.setattr(near_text, "SET_TILE", tile)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(900)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 6, 40, 150, 400]))) for _ in range(40)]
    for base in list(texts):
        for _ in range(4):
            words = base.split()
            for _ in range(rng.randint(1, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate([*texts, None, "", " \t", texts[0].upper(), texts[3]])]
    rng.shuffle(rows)
    label = similar_classes(rows)
    want = {min(r[0] for r, c in zip(rows, label, strict=True) if c == k) for k in set(label)}
    kept = near_text.keep_first_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(want)
    # The table has pairs that three of 64 bits do not link.
    pairs = [(a, b) for a, b in combinations([t for _, t in rows], 2) if a != b and 0.8 <= plain_jaccard(a, b, 5) < 1]
    assert sum((plain_fingerprint_of(a, 5) ^ plain_fingerprint_of(b, 5)).bit_count() > 3 for a, b in pairs) > 20


def test_similar_rows_of_defined_cases(spark):
    assert near_text.keep_first_similar(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "no id here"), (None, None), (7, ""), (4, "x " * 70_000), (9, "x " * 60_000), (5, "one two"), (6, "ONE two")]
    kept = near_text.keep_first_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), len(r["text"] or "")) for r in kept) == [("4", 140_000), ("5", 7), ("7", 0), ("None", 10)]


def test_similar_rows_are_linked_by_fingerprints_too(spark):
    """The stage used to leave the fingerprints out: repeats decide them, and a set knows no repeats."""
    tails = [" ".join(f"{c}{i}" for i in range(40)) for c in "pqr"]
    rows = [(i, "one two three four five " * 60 + tail) for i, tail in enumerate(tails)] + [(i, " ".join(f"{c}{i}" for i in range(40))) for i, c in ((7, "s"), (8, "t"))]
    assert plain_jaccard(rows[0][1], rows[1][1], 5) < 0.2
    fps = [plain_fingerprint_of(t, 5) for _, t in rows]
    assert all((fps[0] ^ fp).bit_count() <= 3 for fp in fps[1:3]) and all((fps[0] ^ fp).bit_count() > 3 for fp in fps[3:])
    kept = near_text.keep_first_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 7, 8]
