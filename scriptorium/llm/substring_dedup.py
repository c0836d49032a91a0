"""Removal of long passages that an earlier document also holds, by a compacted De Bruijn graph of word k-mers.

A window of ``WINDOW`` words is an edge from its first ``WINDOW - 1`` words to its last. A document is a walk along such
edges, and most edges have one continuation only, so the graph is built compacted from the start: consecutive
windows with the same minimizer (the least hash of their ``ANCHOR``-word k-mers) form a bundle, an unbranched path that
travels as one row with a 128-bit digest, its minimizer and its place. Equal windows have equal minimizers, so
only bundles whose minimizer occurs in two documents can hold a repeated window; all others leave here.

1. Equal bundles are one class; it knows its first place (the smallest id). If every occurrence of a class is followed by
   the same class, and every occurrence of that one is preceded by the first, both occur at the same places and the
   junction between them does not branch. Such paths are compacted by pointer doubling: joins of written tables, twice as
   far each round. All occurrences of a path are then those of its head, with the path's length and first place.
2. At the ends of a common passage bundles differ though some of their windows are equal. Where classes share a minimizer,
   their windows are laid out, once per class, and each looks up the first document that has it.
3. Both give pieces with source coordinates: a place, a length and where an earlier document has the same words. Pieces
   that continue each other in both documents are joined to spans. A span is verified: the digest of its own words must
   be that of the words at its source, both read from the texts again. Then its words are removed.

Copies of one text cost one row per path and document; nothing is compared pair by pair. Tables of places are sent to all
tasks only if their counted rows take ``SENT_BYTES`` of memory at most (`_if_few`); beyond that they are joined by a shuffle.

Defined results: a null text has no words and stays null, an empty one stays empty; a null id is neither smaller than another
nor has a smaller one, so such a row stays whole and is no source; rows that share an id are no sources for each other;
equal rows give equal rows; passages that repeat within one document only stay; extra columns stay in `dedup`;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.tables import text_slices, written

WINDOW = 50
#: Words of the k-mers whose least hash bundles windows. Fewer make longer bundles, but meet by chance more often.
ANCHOR = 16
#: Bytes of text that a task takes apart at a time, or one longer text.
SLICE = 4_000_000
#: Memory that a table sent to all tasks may take.
SENT_BYTES = 32_000_000
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over the whole number (an invertible finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of both bases and of their inverses modulo 2 ** 64; kept while they suffice."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        numbers = [x for base in _BASES for x in (base, pow(base, -1, 1 << 64))]
        _POWERS[:] = [np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size, x, dtype=np.uint64))]) for x in numbers]
    return _POWERS


class Hashed:
    """Hashes of any stretch of a sequence of words, by prefix sums of powers; equal stretches have equal hashes anywhere."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        powers = _powers(n + 1)
        zero = np.zeros(1, dtype=np.uint64)
        self.sums = [np.concatenate([zero, np.cumsum(w * p[:n])]) for w, p in ((words, powers[0]), (_mix(words), powers[2]))]
        self.back = [powers[1], powers[3]]

    def stretch(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[which][end] - self.sums[which][start]) * self.back[which][start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the hashes of all words one after another. Words end at ASCII white space."""
    words = [(text or b"").split() for text in texts]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return sizes, np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(sizes.sum()))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    step = 1
    while 2 * step <= width:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (width - step)], values[width - step :]) if width > step else values


def bundles(sizes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, first word, number of windows, minimizer and digest (two numbers) of each bundle of the texts."""
    none = np.zeros(0, dtype=np.int64)
    if len(words) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64)
    hashed = Hashed(words)
    at = np.arange(len(words) - ANCHOR + 1)
    minimizer = _least(hashed.stretch(0, at, at + ANCHOR), WINDOW - ANCHOR + 1)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(minimizer)]
    whole = np.flatnonzero(ends[owner] - np.arange(len(minimizer)) >= WINDOW)
    first = np.ones(len(whole), dtype=bool)
    first[1:] = (whole[1:] != whole[:-1] + 1) | (minimizer[whole[1:]] != minimizer[whole[:-1]])
    heads = np.flatnonzero(first)
    start = whole[heads]
    n = np.diff(np.append(heads, len(whole)))
    end = start + n - 1 + WINDOW
    return owner[start], start - (ends - sizes)[owner[start]], n, minimizer[start], hashed.stretch(0, start, end), hashed.stretch(1, start, end)


def _digests(a: np.ndarray, b: np.ndarray) -> pa.Array:
    both = np.stack([a, b], axis=1).astype(np.uint64)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)


def _if_few(table: DataFrame, row_bytes: int, listed: str | None = None) -> DataFrame:
    """A written table, marked for broadcast if its rows (or the elements of its lists) are counted to take ``SENT_BYTES`` at most."""
    rows = table.count() if listed is None else table.agg(F.sum(F.size(listed) + 1)).first()[0] or 0
    return F.broadcast(table) if rows * row_bytes <= SENT_BYTES else table


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """doc_id, row (a digest of the text) and words (the text) of the rows that can repeat or be repeated."""
    return docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text]).alias("row"), docs[text].alias("words")).where(
        "doc_id is not null and words is not null"
    )


def _bundle_lists(keyed: DataFrame) -> DataFrame:
    """doc_id, row and lists of starts, lengths, anchors and digests of each row's bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "words", SLICE):
            sizes, words = word_hashes(batch.column("words").cast(pa.binary()).to_pylist())
            owner, start, n, anchor, a, b = bundles(sizes, words)
            ends = np.cumsum(np.bincount(owner, minlength=len(sizes)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), _lists(ends, pa.array(start, pa.int32())), _lists(ends, pa.array(n, pa.int32())),
                    _lists(ends, pa.array(anchor.view(np.int64))), _lists(ends, _digests(a, b)),
                ],
                names=["doc_id", "row", "start", "n", "anchor", "digest"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, row long, start array<int>, n array<int>, anchor array<long>, digest array<binary>")


def _repeated_bundles(keyed: DataFrame) -> DataFrame:
    """The bundles whose minimizer occurs in two documents, each with the bundles that touch it before and after."""
    lists = written(_bundle_lists(keyed), "bundle-lists")
    anchors = lists.select("doc_id", F.explode("anchor").alias("shared")).groupBy("shared").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    anchors = _if_few(written(anchors.where("low < high").select("shared"), "shared-anchors"), 24)
    each = lists.select("doc_id", "row", F.explode(F.arrays_zip("start", "n", "anchor", "digest")).alias("b")).select("doc_id", "row", "b.*")
    walk = Window.partitionBy("doc_id", "row").orderBy("start")
    end = F.col("start") + F.col("n")
    return (
        each.join(anchors, F.col("anchor") == F.col("shared"), "left_semi")
        .withColumn("next", F.when(F.lead("start").over(walk) == end, F.lead("digest").over(walk)))
        .withColumn("previous", F.when(F.lag(end).over(walk) == F.col("start"), F.lag("digest").over(walk)))
    )


def _classes(repeated: DataFrame) -> DataFrame:
    """One row per digest: first place, minimizer, windows, whether a later document has it, and its only neighbours."""
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c))
    return repeated.groupBy("digest").agg(
        F.min(F.struct("doc_id", "row", "start")).alias("first"), F.min("anchor").alias("anchor"), F.min("n").alias("n"), F.max("doc_id").alias("last_id"),
        only("next").alias("next"), only("previous").alias("previous"),
    )


def compacted(classes: DataFrame) -> DataFrame:
    """digest, first and n (windows of the whole path) of each path head; ``classes``: digest, first, n, next, previous.

    Two classes are joined if each is the other's only neighbour on that side. The rest of a path points to its predecessor;
    each round lets every pointer jump as far as the one it points to, until all of them reach a head. A path has no circle:
    a document's first bundle has no predecessor.
    """
    before = classes.where("next is not null").select(F.col("digest").alias("parent"), F.col("next").alias("follower"))
    pointers = written(
        classes.where("previous is not null").join(before, (F.col("previous") == F.col("parent")) & (F.col("digest") == F.col("follower"))).select(
            F.col("digest").alias("node"), "parent", "n"
        ),
        "path-pointers",
    )
    inner = _if_few(pointers.select(F.col("node").alias("inner")), 80)
    heads = classes.join(inner, F.col("digest") == F.col("inner"), "left_anti").select("digest", "first", "n")
    while True:
        further = pointers.select(F.col("node").alias("via"), F.col("parent").alias("beyond"))
        jumped = pointers.join(further, F.col("parent") == F.col("via"), "left")
        pointers = written(jumped.select("node", F.coalesce("beyond", "parent").alias("parent"), "n", F.col("beyond").isNotNull().alias("moved")), "path-pointers")
        moved = not pointers.where("moved").isEmpty()
        pointers = pointers.drop("moved")
        if not moved:
            break
    rest = pointers.groupBy("parent").agg(F.sum("n").alias("more"))
    return heads.join(rest, F.col("digest") == F.col("parent"), "left").select("digest", "first", (F.col("n") + F.coalesce("more", F.lit(0))).cast("int").alias("n"))


def _at(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """``keyed`` rows that ``places`` (at_id, at_row and a list ``asked``) asks for, with the list."""
    return keyed.join(_if_few(places, 60, "asked"), (F.col("doc_id") == F.col("at_id")) & (F.col("row") == F.col("at_row")))


def _laid_out(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per window of each class: anchor, window (its hash), offset, and the class's first place doc_id, row, at (of the window)."""
    lists = written(
        classes.groupBy(F.col("first.doc_id").alias("at_id"), F.col("first.row").alias("at_row")).agg(
            F.collect_list(F.struct(F.col("first.start").alias("start"), "n", "anchor")).alias("asked")
        ),
        "open-bundles",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "words", SLICE):
            for i, asked in enumerate(batch.column("asked")):
                hashed = Hashed(word_hashes([batch.column("words")[i].cast(pa.binary()).as_py()])[1])
                places = asked.values
                start, n = (places.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
                which = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                at = start[which] + offset
                yield pa.RecordBatch.from_arrays(
                    [
                        places.field("anchor").take(pa.array(which)), pa.array(hashed.stretch(0, at, at + WINDOW).view(np.int64)),
                        pa.array(offset, pa.int32()),
                        pa.array([batch.column("doc_id")[i].as_py()] * len(which), batch.column("doc_id").type),
                        pa.array([batch.column("row")[i].as_py()] * len(which), pa.int64()), pa.array(at, pa.int32()),
                    ],
                    names=["anchor", "window", "offset", "doc_id", "row", "at"],
                )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"anchor long, window long, offset int, doc_id {kind}, row long, at int"
    return _at(keyed, lists).select("doc_id", "row", "words", "asked").mapInArrow(run, schema)


def _pieces(keyed: DataFrame) -> DataFrame:
    """doc_id, row, start, n (windows) and source_id, source_row, source_start: windows that an earlier document has, too."""
    repeated = written(_repeated_bundles(keyed), "repeated-bundles")
    classes = written(_classes(repeated), "bundle-classes")
    heads = _if_few(written(compacted(classes.where("last_id > first.doc_id")), "paths").withColumnsRenamed({"digest": "head", "n": "windows"}), 150)
    whole = repeated.join(heads, F.col("digest") == F.col("head")).where("doc_id > first.doc_id").select(
        "doc_id", "row", "start", F.col("windows").alias("n"), F.col("first.doc_id").alias("source_id"), F.col("first.row").alias("source_row"), F.col("first.start").alias("source_start"),
    )
    # Classes that share a minimizer may share windows.
    crowds = classes.groupBy(F.col("anchor").alias("open")).agg(F.min("first.doc_id").alias("low"), F.max("first.doc_id").alias("high"))
    crowds = _if_few(written(crowds.where("low < high").select("open"), "open-anchors"), 24)
    windows = written(_laid_out(keyed, classes.join(crowds, F.col("anchor") == F.col("open"), "left_semi")), "open-windows")
    first = windows.groupBy(F.col("anchor").alias("of_anchor"), F.col("window").alias("of_window")).agg(
        F.min(F.struct("doc_id", "row", "at")).alias("source"), F.max("doc_id").alias("last_id")
    )
    known = written(first.where("last_id > source.doc_id").drop("last_id"), "shared-windows")
    partly = windows.join(known, (F.col("anchor") == F.col("of_anchor")) & (F.col("window") == F.col("of_window"))).where("doc_id > source.doc_id")
    place = F.struct("doc_id", "row", (F.col("at") - F.col("offset")).alias("start"))
    partly = partly.select(place.alias("place"), F.col("doc_id").alias("of_id"), "offset", "source").distinct()
    partly = partly.join(classes.select(F.col("first").alias("place"), F.col("digest").alias("of_class")), "place").drop("place")
    partly = written(partly, "partly-repeated")
    # The class's other documents have lost the whole bundle; all its places in the first one lose these windows.
    parts = repeated.join(partly, (F.col("digest") == F.col("of_class")) & (F.col("doc_id") == F.col("of_id"))).select(
        "doc_id", "row", (F.col("start") + F.col("offset")).alias("start"), F.lit(1).alias("n"),
        F.col("source.doc_id").alias("source_id"), F.col("source.row").alias("source_row"), F.col("source.at").alias("source_start"),
    )
    return whole.union(parts)


def _found_spans(keyed: DataFrame) -> DataFrame:
    """Pieces that continue each other in both documents as one row: doc_id, row, start, n_words, source_id, source_row, source_start."""
    line = Window.partitionBy("doc_id", "row", "source_id", "source_row", "shift").orderBy("start", "n")
    end = F.col("start") + F.col("n")
    reached = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = (
        _pieces(keyed)
        .withColumn("shift", F.col("source_start") - F.col("start"))
        .withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
        .withColumn("number", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return marked.groupBy("doc_id", "row", "source_id", "source_row", "shift", "number").agg(F.min("start").alias("start"), F.max(end).alias("end")).select(
        "doc_id", "row", "start", (F.col("end") - F.col("start") + (WINDOW - 1)).alias("n_words"), "source_id", "source_row", (F.col("start") + F.col("shift")).alias("source_start")
    )


def _stretch_digests(text: bytes, asked: pa.StructArray, of_start: str) -> list[bytes]:
    """A 128-bit digest of the words of each asked stretch, joined by one space."""
    words = text.split()
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    whole = memoryview(b" ".join(words))
    out = []
    for start, n in zip(asked.field(of_start).to_pylist(), asked.field("n_words").to_pylist(), strict=True):
        out.append(xxhash.xxh3_128_digest(whole[(ends[start - 1] if start else 0) : ends[start + n - 1] - 1]))
    return out


def spans(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, row (the 64-bit hash of the text), start, n_words, source_id, source_row, source_start and the digest of the source's words.

    Every window of the span also starts in the source, at the same distance.
    """
    keyed = _keyed(docs, text, id_col)
    found = written(_found_spans(keyed), "found-spans")
    stretch = F.struct("source_start", "n_words")
    asked = found.groupBy(F.col("source_id").alias("at_id"), F.col("source_row").alias("at_row")).agg(F.collect_set(stretch).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "words", SLICE):
            for i, asked in enumerate(batch.column("asked")):
                places = asked.values
                digests = _stretch_digests(batch.column("words")[i].cast(pa.binary()).as_py(), places, "source_start")
                key = [pa.array([batch.column(c)[i].as_py()] * len(digests), batch.column(c).type) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*key, places.field("source_start"), places.field("n_words"), pa.array(digests, pa.binary())], names=["d_id", "d_row", "d_start", "d_words", "words_digest"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    read = _at(keyed, written(asked, "asked-sources")).select("doc_id", "row", "words", "asked")
    digests = read.mapInArrow(run, f"d_id {kind}, d_row long, d_start int, d_words int, words_digest binary").distinct()
    digests = _if_few(written(digests, "source-digests"), 150)
    same = [F.col(a) == F.col(b) for a, b in (("source_id", "d_id"), ("source_row", "d_row"), ("source_start", "d_start"), ("n_words", "d_words"))]
    return found.join(digests, same).drop("d_id", "d_row", "d_start", "d_words")


def dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` reduced to the kept words, joined by one space, and ``_n_words`` and ``_n_removed``.

    A text that loses no word stays as it is. ``_n_words``, ``_n_removed``, ``_row``, ``_cut``, ``_cut_id`` and ``_cut_row``
    take the place of columns of these names.
    """
    columns = [c for c in docs.columns if c not in ("_n_words", "_n_removed", "_row", "_cut", "_cut_id", "_cut_row")]
    cuts = spans(docs, text, id_col).groupBy(F.col("doc_id").alias("_cut_id"), F.col("row").alias("_cut_row")).agg(
        F.collect_set(F.struct("start", "n_words", "words_digest")).alias("_cut")
    )
    whole = docs.select(*columns).withColumn("_row", F.xxhash64(text))
    # A list for every document that loses words grows with the table: joined by a shuffle at every size.
    cuts = written(cuts, "cuts").hint("shuffle_hash")
    asked = whole.join(cuts, (F.col(id_col) == F.col("_cut_id")) & (F.col("_row") == F.col("_cut_row")), "left").select(*columns, "_cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text, SLICE):
            texts = batch.column(text).to_pylist()
            n_words, n_removed = [], []
            for i, cut in enumerate(batch.column("_cut")):
                raw = (texts[i] or "").encode()
                words = raw.split()
                n_words.append(len(words))
                gone = np.zeros(len(words), dtype=bool)
                if cut.is_valid:
                    places = cut.values
                    own = _stretch_digests(raw, places, "start")
                    for start, n, digest, want in zip(places.field("start").to_pylist(), places.field("n_words").to_pylist(), own, places.field("words_digest").to_pylist(), strict=True):
                        if digest == want:
                            gone[start : start + n] = True
                n_removed.append(int(gone.sum()))
                if n_removed[-1]:
                    texts[i] = b" ".join([words[k] for k in np.flatnonzero(~gone)]).decode()
            own = [pa.array(texts, batch.column(text).type) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*columns, "_n_words", "_n_removed"])

    more = [T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType())]
    return asked.mapInArrow(run, T.StructType([*docs.select(*columns).schema.fields, *more]))


def _joined_words(text: Column) -> Column:
    return F.array_join(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), ""), " ")


def summary(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, joined by one space, of each row."""
    return dedup(docs.select(id_col, text), text, id_col).select(
        F.col(id_col).alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(_joined_words(F.col(text)), 256).alias("kept_sha256")
    )
