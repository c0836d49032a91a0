"""Folding, rendering and reading back of conversations."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import chat

NASTY = st.text(alphabet="<|\\>n\nim_endstart ab", max_size=60)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
@settings(max_examples=300, deadline=None)
def test_escaping_round_trip(turns):
    formatted = "".join(f"{chat.START}{chat._role(r)}\n{chat.escape(t)}{chat.END}\n" for r, t in turns)
    assert chat.read_back(formatted) == turns


def folded(spark, events):
    log = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, text string, role string")
    return sorted((r["conv_id"], r["message"], r["role"], r["text"]) for r in chat.fold(log).collect())


def test_fold(spark):
    def e(m, seq, kind, text=None):
        return (1, m, seq, kind, text, "clash")

    events = [
        e(0, 3, "delta", "lo"), e(0, 1, "open", "user"), e(0, 2, "delta", "hel"), e(0, 4, "delta", None),
        e(1, 1, "open", "assistant"), e(1, 2, "delta", "wrong"), e(1, 3, "regenerate"), e(1, 4, "delta", "right"),
        e(2, 1, "open", "user"), e(2, 2, "delta", "old"), e(2, 3, "edit", "new"), e(2, 4, "delta", "er"),
        e(3, 1, "open", "user"), e(3, 2, "delta", "gone"), e(3, 3, "delete"),
        e(4, 1, "open", "user"),
    ]
    want = [(1, 0, "user", "hello"), (1, 1, "assistant", "right"), (1, 2, "user", "newer"), (1, 4, "user", "")]
    assert folded(spark, events) == want
    assert folded(spark, events[:0] or [(None, None, None, "delta", "x", None)][:0]) == []


def test_turns_with_nulls_repeats_and_long_texts(spark):
    rows = [
        (1, 0, "user", "hi", 5), (1, 1, "assistant", None, 5), (1, 1, "assistant", "b", 5), (1, 1, "assistant", "a", 5),
        (2, 0, None, "x<|im_end|>", 5), (2, None, "user", "first", 5), (3, 7, "assistant", "é" * 50_001 + "<\\|", 5),
        (4, 0, "assistant", "same", 5), (4, 0, "assistant", "same", 5),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r["conv_id"]: r for r in chat.digests(chat.render(chat.fold(chat.events_of(turns)), segment_chars=40)).collect()}
    by_conv = {}
    for c, t, role, text, _ in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    for c, said in by_conv.items():
        said.sort()
        plain = "".join(f"{r}\n{t}\n" for _, _, r, t in said)
        lost = "".join(t for _, _, r, t in said if r == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256(plain.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())
    assert chat.digests(chat.render(chat.fold(chat.events_of(turns.limit(0))))).collect() == []


def test_segments_hold_whole_turns(spark):
    rows = [(9, i, "user" if i % 2 else "assistant", "word " * 30) for i in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.render(chat.fold(chat.events_of(turns)), segment_chars=500).orderBy("part").collect()
    assert len(parts) > 3 and [p["part"] for p in parts] == list(range(len(parts)))
    assert sum(len(chat.read_back(p["formatted"])) for p in parts) == 20
