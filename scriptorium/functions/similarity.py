"""String and author-list similarity."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from scriptorium.functions.extract import let
from scriptorium.functions.text import strip, surname
from scriptorium.schema import has_text

# Executors need not have this package: what the ratio calls travels with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _plain(c: Column) -> Column:
    return strip(F.lower(c))


def _common_start(x: Column, y: Column) -> Column:
    """Number of equal characters at the start, by halving."""
    shorter = F.least(F.length(x), F.length(y))
    powers = F.sequence(F.length(F.bin(shorter)) - 1, F.lit(0), F.lit(-1))

    def longer(n: Column, p: Column) -> Column:
        step = F.pow(F.lit(2), p).cast("int")
        same = F.substr(x, n + 1, step) == F.substr(y, n + 1, step)
        return F.when((n + step <= shorter) & same, n + step).otherwise(n)

    return F.aggregate(powers, F.lit(0), longer)


def edit_distance(x: Column, y: Column) -> Column:
    """Levenshtein distance; equal starts and ends, which do not count, are cut off before the quadratic part.

    Where one text holds the other, the distance is what it has beside: no quadratic part at all.
    """

    def rest(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        n = _common_start(a, b)
        return F.struct(F.substr(a, n + 1, F.length(a)).alias("a"), F.substr(b, n + 1, F.length(b)).alias("b"))

    def turned(pair: Column) -> Column:
        return F.struct(F.reverse(pair["a"]).alias("a"), F.reverse(pair["b"]).alias("b"))

    both = F.struct(x.alias("a"), y.alias("b"))
    cut = let(let(let(both, rest), lambda p: rest(turned(p))), lambda p: F.levenshtein(p["a"], p["b"]))
    # Looking for equal ends costs more than it saves where not even the outermost characters agree.
    alike = (F.left(x, F.lit(1)) == F.left(y, F.lit(1))) | (F.right(x, F.lit(1)) == F.right(y, F.lit(1)))
    held = F.contains(x, y) | F.contains(y, x)
    return F.when(held, F.abs(F.length(x) - F.length(y))).when(alike, cut).otherwise(F.levenshtein(x, y))


def _graded(x: Column, y: Column, distance: Callable[[Column, Column], Column] = edit_distance) -> Column:
    """Similarity of two lower-cased, stripped strings."""
    return F.when(x == y, 1.0).otherwise(F.lit(1.0) - distance(x, y) / F.greatest(F.length(x), F.length(y)))


def string_similarity(a: Column, b: Column) -> Column:
    """0 when either is empty, 1 when equal up to case and outer blanks, else ``1 - distance / length``."""
    return F.when(has_text(a) & has_text(b), _graded(_plain(a), _plain(b))).otherwise(0.0)


# Lengths of a pair multiplied, summed over pairs. Below the first, one pair after the other is faster than all at once;
# no more than the second are looked at together, and a longer pair is looked at alone, in memory that grows with its length.
FEW_PLACES, MOST_PLACES = 1 << 14, 1 << 20
_BITS = 21


def _places(texts: list[str], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all characters of the texts: the text's number, the place in it, and text and character as one key."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    text = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return text, place, (text << _BITS) | codes


def _matched(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Characters in the matching blocks of each pair, for all pairs at once.

    Equal characters are kept as (i, j) along the diagonals. A round finds the longest block of every open part of a pair
    (of equal ones the first in the left text, then in the right one), and keeps what lies wholly before or after it.
    """
    left, right = zip(*pairs, strict=True)
    pair, i, key = _places(left, np.array([len(a) for a in left]))
    _, at, found = _places(right, np.array([len(b) for b in right]))
    order = np.argsort(found, kind="stable")
    at, found = at[order], found[order]
    low = np.searchsorted(found, key)
    many = np.searchsorted(found, key, "right") - low
    part, i = np.repeat(pair, many), np.repeat(i, many)
    j = at[np.arange(len(i)) + np.repeat(low - (np.cumsum(many) - many), many)]
    order = np.argsort((part << 2 * _BITS) | ((i - j + MOST_PLACES) << _BITS) | i)
    part, i, j = part[order], i[order], j[order]

    total, owner = np.zeros(len(pairs), dtype=np.int64), np.arange(len(pairs))
    low_bits = (1 << _BITS) - 1
    while len(i):
        # Parts without equal characters are closed.
        is_open = np.zeros(len(owner), dtype=bool)
        is_open[part] = True
        part, owner = (np.cumsum(is_open) - 1)[part], owner[is_open]
        starts = np.ones(len(i), dtype=bool)
        starts[1:] = (part[1:] != part[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)
        start = np.flatnonzero(starts)
        size = np.diff(np.append(start, len(i)))
        best = np.full(len(owner), np.iinfo(np.int64).max)
        np.minimum.at(best, part[start], ((MOST_PLACES - size) << 2 * _BITS) | (i[start] << _BITS) | j[start])
        size, first, second = MOST_PLACES - (best >> 2 * _BITS), (best >> _BITS) & low_bits, best & low_bits
        np.add.at(total, owner, size)
        before = (i < first[part]) & (j < second[part])
        after = (i >= (first + size)[part]) & (j >= (second + size)[part])
        part, kept = part + len(owner) * after, before | after
        part, i, j = part[kept], i[kept], j[kept]
        owner = np.concatenate([owner, owner])
    return total


def _groups(pairs: list[tuple[str, str]]) -> Iterator[tuple[list[tuple[str, str]], int]]:
    """The pairs in runs of at most MOST_PLACES places, and the places; a pair of more is a run of its own."""
    group, places = [], 0
    for a, b in pairs:
        own = len(a) * len(b)
        if group and places + own > MOST_PLACES:
            yield group, places
            group, places = [], 0
        group.append((a, b))
        places += own
    if group:
        yield group, places


def _ratios(pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Ratio of each of the different pairs, none of them empty."""
    # Frequent characters count like any others, whatever the length.
    matcher = SequenceMatcher(None, autojunk=False)
    out = {}
    for group, places in _groups(pairs):
        if FEW_PLACES <= places <= MOST_PLACES:
            for (a, b), n in zip(group, _matched(group).tolist(), strict=True):
                out[a, b] = 2.0 * n / (len(a) + len(b))
            continue
        for a, b in group:
            matcher.set_seqs(a, b)
            out[a, b] = matcher.ratio()
    return out


@pandas_udf(DoubleType())
def _block_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        # Candidates of several services share their title: a batch works each pair out once.
        rows = list(zip(left, right, strict=True))
        known = _ratios([(a, b) for a, b in dict.fromkeys(rows) if a and b])
        yield pd.Series([known.get(pair, 0.0) for pair in rows], dtype="float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Longest-matching-block ratio of two lower-cased, stripped strings.

    Where one holds the other, that one is the only block, and no blocks are looked for.
    """
    x, y = _plain(a), _plain(b)
    held = F.contains(x, y) | F.contains(y, x)
    whole = F.lit(2.0) * F.least(F.length(x), F.length(y)) / (F.length(x) + F.length(y))
    blocks = _block_ratio(F.when(~held, x), F.when(~held, y))
    return F.coalesce(F.when((x == "") | (y == ""), 0.0).when(held, whole).otherwise(blocks), F.lit(0.0))


def author_similarity(found: Column, original: Column) -> Column:
    """Mean over the found authors of their best match among the original ones."""

    def closest(f: Column, original: Column) -> Column:
        # An equal name is the best match. Names are short: cutting off equal ends would cost more than it saves.
        graded = F.transform(original, lambda o: _graded(f, o, F.levenshtein))
        return F.when(F.array_contains(original, f), 1.0).otherwise(F.coalesce(F.array_max(graded), F.lit(0.0)))

    def mean_best(names: Column) -> Column:
        best = F.transform(names["found"], lambda f: closest(f, names["original"]))
        return F.aggregate(best, F.lit(0.0), lambda acc, s: acc + s)

    # Names are lower-cased and stripped once, not once per pair; empty ones match nothing.
    named = F.struct(
        F.transform(F.filter(found, has_text), _plain).alias("found"),
        F.transform(F.filter(original, has_text), _plain).alias("original"),
    )
    return F.when(F.size(found) > 0, let(named, mean_best) / F.size(found)).otherwise(0.0)


def _any_pair(found: Column, original: Column, test: Callable[[Column, Column], Column]) -> Column:
    names = F.struct(F.transform(found, F.lower).alias("found"), F.transform(original, F.lower).alias("original"))
    hit = let(names, lambda n: F.exists(n["found"], lambda f: F.exists(n["original"], lambda o: test(f, o))))
    return F.coalesce(hit, F.lit(False))


def any_name_contains(found: Column, original: Column) -> Column:
    """Some found author contains, or is contained in, some original author; case ignored."""
    return _any_pair(found, original, lambda f, o: F.contains(f, o) | F.contains(o, f))


def any_surname_within(found: Column, original: Column) -> Column:
    """The last word of some found author occurs in some original author; case ignored."""
    return _any_pair(F.transform(found, surname), original, lambda f, o: F.contains(o, f))
