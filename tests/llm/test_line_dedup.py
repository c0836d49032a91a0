"""Line deduplication against brute force over all pairs of lines."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import line_dedup as ld


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def close(a, b, most):
    """Whether the edit distance is at most ``most``: the same table, only the cells near its diagonal."""
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            options = [row[j] + 1] if j in row else []
            options += [new[j - 1] + 1] if j - 1 in new else []
            options += [row[j - 1] + (x != b[j - 1])] if j and j - 1 in row else []
            new[j] = min(options)
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), most + 1) <= most


def mutated(rng, text, alphabet, most):
    chars = list(text)
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, max(len(chars) - 1, 0))
        kind = rng.random()
        if kind < 0.35 and chars:
            chars.pop(at)
        elif kind < 0.7:
            chars.insert(at, rng.choice(alphabet))
        elif chars:
            chars[at] = rng.choice(alphabet)
    return "".join(chars)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30])))
        pairs.append((a, mutated(rng, a, "abcé", 5)))
    got = ld.distances(spark.createDataFrame(pairs, "x string, y string"), edits).collect()
    for r in got:
        want = edit_distance(r["x"], r["y"])
        assert min(r["distance"], edits + 1) == min(want, edits + 1), r


def brute(rows):
    lines = [(i, n, line.strip(" \t\r").lower()) for i, r in enumerate(rows) if r[1] is not None for n, line in enumerate(r[1].split("\n"))]
    lines = [x for x in lines if len(x[2]) >= ld.MIN_CHARS]
    texts = sorted({t for _, _, t in lines})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in combinations(texts, 2):
        most = min(ld.EDITS, max(len(a), len(b)) // ld.CHARS_PER_EDIT)
        if abs(len(a) - len(b)) <= most and close(a, b, most):
            parent[root(a)] = root(b)
    first = {}
    for i, _, t in lines:
        if rows[i][0] is not None:
            first[root(t)] = min(first.get(root(t), rows[i][0]), rows[i][0])
    removed, seen = {}, set()
    for i, n, t in lines:
        c = root(t)
        if rows[i][0] != first.get(c) or (i, c) in seen:
            removed.setdefault(i, set()).add(n)
        else:
            seen.add((i, c))
    out = []
    for i, r in enumerate(rows):
        text = r[1] if r[1] is None else "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in removed.get(i, ()))
        out.append((str(r[0]), text, len(removed.get(i, ()))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcd ") for _ in range(n)).strip()
    lines = [make(rng.choice([5, 19, 20, 21, 22, 25, 39, 40, 41, 60, 90, 200])) for _ in range(70)]
    lines += [mutated(rng, x, "abcdx", 3) for x in lines for _ in range(3)]
    lines += ["The License of This Page, all rights reserved " + str(i % 7) for i in range(12)]
    out = [(100 - i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    out += [(500, None), (501, ""), (502, "\n\n"), (None, lines[8] + "\n" + lines[8]), (None, "only rows without an id hold this line"), (None, "only rows without an id hold this line!")]
    out += [(503, "é" * 30 + "\n" + "é" * 29 + "x\n  " + "É" * 30 + " \r\nshort"), (504, ("a very long line " * 30) + "\n" + ("a very long line " * 30) + "z"), out[5], (95, "the same id with another text")]
    return out


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, line string, norm int")
    got = ld.dedup(docs)
    assert got.columns[:4] == ["doc_id", "text", "line", "norm"]
    assert sorted(((str(r["doc_id"]), r["text"], r["_n_removed"]) for r in got.collect()), key=str) == brute(rows)


def test_texts_are_fetched_without_a_broadcast_too(spark, rows, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_LINES", 0)
    monkeypatch.setattr(ld, "CROWD", 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((str(r["doc_id"]), r["text"], r["_n_removed"]) for r in ld.dedup(docs).collect()), key=str) == brute(rows)


def test_repeats_do_not_multiply_in_the_join(spark):
    """Two near-equal lines, thousands of times each over many rows and within rows, meet as one pair."""
    first, second = "all rights to this page are reserved", "all rights to this page are reserved!"
    docs = spark.range(1500).selectExpr("id as doc_id", f"concat_ws('\n', '{first}', concat('only ', id * 7919), '{second}', '{first}') as text")
    different = ld._different(docs, "text", "doc_id")
    assert {r["n"] for r in different.where("n > 1").collect()} == {1500, 3000}
    lines = different.where(F.length("norm") >= ld.NEAR_CHARS).select("line", "norm")
    assert lines.count() == 2 and ld._candidates(lines, ld.EDITS).count() == 1
    got = {r["doc_id"]: (r["text"], r["_n_removed"]) for r in ld.dedup(docs).collect()}
    assert got[0] == (f"{first}\nonly 0", 2) and got[7] == ("only 55433", 3) and len(got) == 1500


def test_very_long_lines(spark):
    long = "a very long line " * 4000
    docs = spark.createDataFrame([(1, long + "\n" + long + "z"), (2, "z" + long + "x"), (3, "zz" + long + "xx")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["_n_removed"]) for r in ld.dedup(docs).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_empty_and_plan(spark, rows):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.dedup(empty).collect() == []
    plan = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_lines_repeat_too(spark):
    nineteen = "abcdefghij klmnopqr"
    docs = [(1, "}\n\nHome\n }\nHomf\n" + nineteen), (2, "home \n\n}\n\nhomes"), (3, nineteen + "s\nabcdefghij klmnopqx"), (4, "}"), (None, "HOME\nonly")]
    got = ld.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = [(1, "}\n\nHome\nHomf\n" + nineteen, 1), (2, "\n\nhomes", 2), (3, "abcdefghij klmnopqx", 1), (4, "", 1), (None, "only", 1)]
    assert sorted(((r["doc_id"], r["text"], r["_n_removed"]) for r in got), key=str) == sorted(want, key=str)
