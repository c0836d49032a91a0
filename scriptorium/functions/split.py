"""The recursive character splitter as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators from coarse to fine; beyond them texts are cut anywhere.
SEPARATORS = ["\n\n", "\n", ".", " "]
#: What is taken off both ends of a chunk.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))

_HELD = "array<struct<at: int, text: string>>"
_DONE = "array<struct<text: string, long: boolean>>"


def _windows(text: Column, size: int, overlap: int) -> Column:
    """Cutting anywhere: windows of ``size`` that advance by ``size - overlap``."""
    step = size - overlap
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / F.lit(step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def _pieces(text: Column, separator: str) -> Column:
    """The stretches between separators; each but the first begins with its separator."""
    parts = F.split(text, "\\Q" + separator + "\\E", -1)
    led = F.transform(parts, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(separator), part)))
    return F.filter(led, lambda piece: piece != "")


def _packed(pieces: Column, size: int, overlap: int) -> Column:
    """Pieces in order as ``(text, long)``: short ones packed up to ``size``, those of ``size`` or more by themselves.

    The next chunk starts with trailing pieces of at most ``overlap`` that leave room for the piece after them. Held
    pieces carry their place, so that the trailing ones are those behind a place.
    """

    def close(state: Column) -> Column:
        text = F.array_join(F.transform(state["held"], lambda h: h["text"]), "")
        closed = F.array(F.struct(text.alias("text"), F.lit(False).alias("long")))
        return F.when(F.size(state["held"]) > 0, F.concat(state["done"], closed)).otherwise(state["done"])

    def add(state: Column, piece: Column) -> Column:
        end = state["at"] + F.length(piece)
        full = (F.size(state["held"]) > 0) & (end - F.element_at(state["held"]["at"], 1) > size)
        room = F.greatest(state["at"] - overlap, end - size)
        trailing = F.when(full, F.filter(state["held"], lambda h: h["at"] >= room)).otherwise(state["held"])
        short = F.struct(
            F.when(full, close(state)).otherwise(state["done"]).alias("done"),
            F.concat(trailing, F.array(F.struct(state["at"].alias("at"), piece.alias("text")))).alias("held"),
            end.alias("at"),
        )
        alone = F.array(F.struct(piece.alias("text"), F.lit(True).alias("long")))
        long = F.struct(F.concat(close(state), alone).alias("done"), F.array().cast(_HELD).alias("held"), end.alias("at"))
        return F.when(F.length(piece) >= size, long).otherwise(short)

    start = F.struct(F.array().cast(_DONE).alias("done"), F.array().cast(_HELD).alias("held"), F.lit(0).alias("at"))
    return F.aggregate(pieces, start, add, close)


def _cut(text: Column, size: int, overlap: int, separators: list[str]) -> Column:
    if not separators:
        return _windows(text, size, overlap)
    separator, *finer = separators
    parts = _packed(_pieces(text, separator), size, overlap)
    return F.flatten(
        F.transform(parts, lambda p: F.when(p["long"], _cut(p["text"], size, overlap, finer)).otherwise(F.array(p["text"])))
    )


def recursive_split(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of chunk texts, empty for null and blank texts; one expression, no shuffle and no Python.

    Texts are cut at the coarsest separator; pieces of ``size`` or more go on with the finer ones, pieces between them are
    packed. A text under ``size`` is one chunk.
    """
    cut = F.when(F.length(text) < size, F.array(text)).otherwise(_cut(text, size, overlap, SEPARATORS))
    chunks = F.filter(F.transform(cut, lambda c: F.btrim(c, F.lit(BLANK))), lambda c: c != "")
    return F.coalesce(chunks, F.array().cast("array<string>"))
