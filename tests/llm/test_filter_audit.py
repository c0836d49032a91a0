from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import filter_audit

SCHEMA = "doc_id long, text string, source string, mask string"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", "  \t", LONG, "SHOUT " * 3, "a " * 80, "cash $ here", LONG.upper(), LONG + " 100%", "a\x0bb c \x85 " * 30]


def fails(rows, row):
    import re

    doc_id, text, *_ = row
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = set()
    out |= {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    out |= {"E"} if doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows) else set()
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    failed = [fails(rows, r) for r in rows]
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(range(len(mine)))
            for step, letter in enumerate(order, 1):
                gone = [i for i in left if letter in mine[i][1]]
                left = [i for i in left if i not in gone]
                share[letter] += len(gone)
                ids = [mine[i][0][0] for i in gone]
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in f for _, f in mine) - len(gone), sum(f == {letter} for _, f in mine),
                    sum(i is not None and i in good for i in ids), sum(i is not None and i in toxic for i in ids),
                ]
        for key in [k for k in out if k[0] == part]:
            out[key].append(share[key[1][key[2] - 1]])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    found = {(r[0], r[1], r[2]): list(r)[3:] for r in got}
    assert len(found) == len(got)
    return found


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.none() | st.integers(-3, 12), st.sampled_from(TEXTS), st.sampled_from([None, "", "a", "b"])), max_size=25))
def test_like_running_every_order(spark, rows):
    labels = [(1, 1, 0), (1, 0, 0), (2, 0, 1), (3, 1, 1), (4, None, None), (None, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_empty_table_and_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    out = filter_audit.audit(docs, spark.createDataFrame([], LABELS))
    assert out.count() == 0
    assert dict(out.dtypes) == {
        "part": "string", "filter_order": "string", "step": "int",
        **dict.fromkeys(["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint"),
    }


def test_the_recursion_enumerates_every_prefix_with_every_mask(spark):
    got = filter_audit.enumerated(spark).collect()
    assert len(got) == len({(r.prefix, r.mask) for r in got}) == 32 * (5 + 20 + 60 + 120 + 120)
    for r in got:
        assert r.step == len(r.prefix) == len(set(r.prefix)) and r.prefix[-1] == r.letter
        assert r.before == sum(1 << "ABCDE".index(c) for c in r.prefix[:-1]) and r.applied == r.before | r.bit


@pytest.mark.parametrize("copies", [300])
def test_many_copies_meet_as_one_row_per_part(spark, copies):
    rows = [(i, LONG, f"s{i % 2}") for i in range(copies)]
    found = run(spark, rows, [])
    assert found["s0", "EABCD", 1][:2] == [1, copies // 2 - 1]
    assert found["s1", "EABCD", 1][:2] == [0, copies // 2]
