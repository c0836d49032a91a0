"""Chat formatting from an event log: fold deltas, edits and regenerations into messages, then render.

An event has a conversation, a message number within it, a sequence number within the message and a kind:

* ``open`` starts the message and gives its role (``text`` is the role);
* ``delta`` appends its text;
* ``edit`` replaces the text so far;
* ``regenerate`` drops the text so far, what follows is the new version;
* ``delete`` takes the message away, unless a later event of it brings text again.

Folding needs one message's events in sequence, so the log is dealt out by (conversation, message): a
conversation that holds most rows is spread over tasks. Rendering needs a conversation's messages in order; it
streams them from a sorted partition and writes the conversation as segments of bounded size, so no
conversation is ever held whole.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles ``<|`` becomes ``<\\|``, and a
backslash is added to ``<\\|``, ``<\\\\|`` and so on; in roles a line feed is written ``\\n`` and a backslash
``\\\\``. Both are undone by `read_back`. The loss mask of a segment are [start, end) code point ranges that
cover each assistant text, and nothing of the template.

Defined results: null texts and roles count as empty, a null conversation is a conversation of its own (the
first), null numbers sort first; events with equal numbers are folded in the order of kind and text; extra columns
are ignored; an empty log gives no rows; equal rows of a table of turns are separate turns (`events_of`).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT_CHARS = 1_000_000
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def events_of(turns: DataFrame, piece: int = 160) -> DataFrame:
    """The log that a table of turns (conv_id, turn, role, text) would have come from.

    Texts arrive in deltas of ``piece`` code points. Every third turn first streams a draft that is
    regenerated, every fifth a draft that is edited before the rest arrives: folding must undo both.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    message = F.struct(F.col("turn").alias("turn"), F.row_number().over(w).alias("again"))
    rows = turns.select("conv_id", message.alias("message"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    event = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("text"))
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(piece))
    deltas = F.transform(starts, lambda at: event("delta", F.substr(F.col("text"), at, F.lit(piece))))
    number = F.coalesce(F.col("message.turn"), F.lit(0)) % 15
    draft = F.array(event("delta", F.lit("a draft that ")), event("delta", F.lit("does not stay")))
    detour = (
        F.when(number % 3 == 0, F.concat(draft, F.array(event("regenerate", F.lit("")))))
        .when(number % 5 == 0, F.concat(draft, F.array(event("edit", F.lit("")))))
        .otherwise(F.array_remove(F.array(event("delta", F.lit(""))), event("delta", F.lit(""))))
    )
    log = F.concat(F.array(event("open", F.col("role"))), detour, deltas)
    return rows.select("conv_id", "message", F.posexplode(log).alias("seq", "event")).select("conv_id", "message", "seq", "event.kind", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, message, role, text) of a log (conv_id, message, seq, kind, text)."""
    log = events.select("conv_id", "message", "seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    dealt = log.repartition("conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "kind", "text")
    # The message number travels as a text that tells messages apart; equal numbers are neighbours after the sort.
    keyed = dealt.select("conv_id", "message", F.to_json(F.struct("conv_id", "message")).alias("_key"), "kind", "text")
    names = ["conv_id", "message", "role", "text"]

    def run(batches):
        key, first, role, parts, alive = None, None, "", [], True

        def message():
            return [first.column(0), first.column(1), pa.array([role]), pa.array(["".join(parts)], pa.string())]

        for batch in batches:
            done = []
            for i, (k, kind, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                if k != key:
                    if key is not None and alive:
                        done.append(message())
                    key, first, role, parts, alive = k, batch.slice(i, 1), "", [], True
                if kind == "open":
                    role = text
                elif kind == "delta":
                    parts.append(text)
                    alive = True
                elif kind == "edit":
                    parts, alive = [text], True
                elif kind == "regenerate":
                    parts, alive = [], True
                elif kind == "delete":
                    parts, alive = [], False
                else:
                    raise ValueError(f"unknown kind of event: {kind}")
            if done:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*done, strict=True)], names=names)
        if key is not None and alive:
            yield pa.RecordBatch.from_arrays(message(), names=names)

    kinds = [keyed.schema[c].dataType.simpleString() for c in ("conv_id", "message")]
    return keyed.mapInArrow(run, f"conv_id {kinds[0]}, message {kinds[1]}, role string, text string")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _spans(start: int, size: int, assistant: bool) -> list[tuple[int, int]]:
    return [(start, start + size)] if assistant else []


def render(messages: DataFrame, loss_role: str = "assistant", segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments (conv_id, part, formatted, loss) of each conversation; parts are numbered from 0 and hold whole turns."""
    dealt = messages.select("conv_id", "message", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "message", "role", "text")
    rows = dealt.select("conv_id", "role", "text")
    loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        conv, part, pieces, spans, size, started = None, 0, [], [], 0, False
        kind = None

        def segment():
            columns = [pa.array([conv], kind), pa.array([part], pa.int32()), pa.array(["".join(pieces)]), pa.array([[{"start": a, "end": b} for a, b in spans]], loss)]
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "formatted", "loss"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if started and (c != conv or size >= segment_chars):
                    yield segment()
                    part = part + 1 if c == conv else 0
                    pieces, spans, size = [], [], 0
                conv, started = c, True
                head, body = f"{START}{_role(role or '')}\n", escape(text or "")
                spans += _spans(size + len(head), len(body), role == loss_role)
                turn = f"{head}{body}{END}\n"
                pieces.append(turn)
                size += len(turn)
        if started:
            yield segment()

    kind_name = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind_name}, part int, formatted string, loss array<struct<start: int, end: int>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted segment."""
    return [(_unrole(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its segments, part by part."""
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind_name = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        conv, started, kind = None, False, None
        turns, lost, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def row():
            values = [n, turns.hexdigest(), loss_chars, lost.hexdigest(), chars]
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), *(pa.array([v]) for v in values)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, _, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if started and c != conv:
                    yield row()
                    turns, lost, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                conv, started = c, True
                for role, text in read_back(formatted):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    lost.update(text.encode())
                    loss_chars += len(text)
                chars += len(formatted)
        if started:
            yield row()

    return rows.mapInArrow(run, f"conv_id {kind_name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def control_conversation(like: DataFrame) -> DataFrame:
    """Conversation -1: a user and an assistant turn that both say control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = like.sparkSession.range(2).select(
        F.lit(-1).cast(like.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(like.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(said).alias("text"),
    )
    return like.select("conv_id", "turn", "role", "text").unionByName(rows)



#: The digests from the turns themselves.
SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || chr(10)) + length('<|im_end|>')
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
