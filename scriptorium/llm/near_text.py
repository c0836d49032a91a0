"""Near-duplicate detection: by SimHash (pigeonhole blocks, Hamming verification) or by Jaccard similarity; classes.

A fingerprint has 64 bits; a bit is set if more than half of the hashes of the text's word shingles (repeats
included) have it. Two fingerprints at ``distance`` or fewer differing bits agree whole on at least
``BLOCKS - distance`` of the ``BLOCKS`` stretches of bits, so they meet under one of the choices of that many
stretches. Only distinct fingerprints meet (copies are one), only under keys that two of them share, and a
key with many of them is cut into tiles of bounded size; a tile returns a spanning forest, not its pairs.

Three bits lie near a Jaccard similarity of 0.98. `keep_first_similar` links fingerprints so and, beyond that, texts of a
similarity of 0.8: distinct shingle sets that share a band of minima form candidate groups; within a group all pairs are
compared by the exact similarity of their sets. Its classes are those of both kinds of links together.

Defined results: null and empty texts (and texts of white space) have fingerprint zero and are linked like any
other; a null id is kept as it is; equal rows give equal rows; rows with one id and different texts stay
separate rows; extra columns are ignored by `fingerprints`; an empty table gives no rows.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.tables import components, written

BLOCKS = 6
#: `keep_first_similar`: a pair at Jaccard 0.8 agrees in none of the bands with a chance of (1 - 0.8 ** 5) ** 40 = 1.3e-7.
BANDS = 40
BAND_ROWS = 5
#: Distinct shingle sets, and shingles, that a tile of a candidate group takes from each of its two sides.
SET_TILE = 1024
SET_TILE_SHINGLES = 4_000_000
#: Fingerprints of one key that a tile takes from each of its two sides.
TILE = 4096
_HASHES_AT_ONCE = 1 << 16
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def _shingle_hashes(text: bytes | None, shingle: int):
    """Arrays of hashes of the text's word shingles in order, repeats included; no array for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    for at in range(0, len(starts), _HASHES_AT_ONCE):
        a, b = starts[at : at + _HASHES_AT_ONCE].tolist(), (ends[at : at + _HASHES_AT_ONCE] - 1).tolist()
        yield np.fromiter((_hash(joined[i:j]) for i, j in zip(a, b, strict=True)), dtype="<u8", count=len(a))


def simhash(text: bytes | None, shingle: int) -> int:
    """The fingerprint as a signed 64-bit number. Words end at ASCII white space; A-Z count as a-z."""
    return _fingerprint(_shingle_hashes(text, shingle))


def _fingerprint(parts) -> int:
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles."""
    return _distinct(list(_shingle_hashes(text, shingle)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype="<u8")


#: Odd factors and summands of the hash functions modulo 2 ** 32.
_MINHASH = np.random.default_rng(42).integers(0, 1 << 32, size=(2, BANDS * BAND_ROWS), dtype=np.uint32)
_MINHASH[0] |= np.uint32(1)


def band_keys(shingles: np.ndarray) -> list[int]:
    """One key for each band of ``BAND_ROWS`` minima of the set under ``BANDS * BAND_ROWS`` hash functions."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(low), 512):
        hashed = _MINHASH[0][:, None] * low[None, at : at + 512]
        hashed += _MINHASH[1][:, None]
        least = np.minimum(least, hashed.min(axis=1))
    return [xxhash.xxh64_intdigest(band.tobytes(), seed=i) - (1 << 63) for i, band in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Star links (from, to) that connect exactly the sets reachable over pairs of at least this Jaccard similarity."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    label = np.arange(n)
    if n < 2 or not sizes.any():
        return label[:0], label[:0]
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    owner = np.repeat(label.copy(), sizes)
    mark = np.zeros(len(values), dtype=bool)
    for i in range(n):
        if not (label != label[i]).any():
            continue
        own = flat[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        shared = np.bincount(owner[mark[flat]], minlength=n)
        mark[own] = False
        near = (shared > 0) & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9)
        joined = np.unique(np.append(label[near], label[i]))
        label[np.isin(label, joined)] = joined[0]
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (bigint) of each row."""
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("_text"))

    def run(batches):
        for batch in batches:
            raw = batch.column("_text").cast(pa.binary())
            fps = pa.array([simhash(value.as_py(), shingle) for value in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], names=["doc_id", "fp"])

    return frame.mapInArrow(run, f"doc_id {frame.schema['doc_id'].dataType.simpleString()}, fp long")


def _masks(blocks: int, keep: int) -> list[int]:
    """One mask of 64 bits (signed) for each choice of ``keep`` of ``blocks`` stretches."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [int(np.array(sum(choice), dtype=np.uint64).astype(np.int64)) for choice in combinations(whole, keep)]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least reachable index of each of n nodes under links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _close(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (from, to) of the rows that are close to another row of their group; rows come sorted by group."""
    n, step, kept_a, kept_b, held = len(fp), 1, [], [], 0
    at = np.arange(n)
    while True:
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        kept_a.append(near)
        kept_b.append(near + step)
        held += len(near)
        if held > 8 * n + 100_000:  # many links within groups: keep what they connect
            label = _forest(n, np.concatenate(kept_a), np.concatenate(kept_b))
            own = np.flatnonzero(label != np.arange(n))
            kept_a, kept_b, held = [own], [label[own]], len(own)
        step += 1
    if not held:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    label = _forest(n, np.concatenate(kept_a), np.concatenate(kept_b))
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def links(distinct_fps: DataFrame, distance: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints (``fp``, distinct) reachable over ``distance`` bits."""
    masks = _masks(blocks, blocks - distance)
    rows = distinct_fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).bitwiseAND(F.col("fp")).alias("key")) for i, m in enumerate(masks)])).alias("block")
    ).select("fp", "block.*")
    shared = rows.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    # A key with many fingerprints gets several parts, and every two parts a tile of their own.
    parts = F.ceil(F.col("n") / TILE).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    tiles = (
        rows.join(shared, ["choice", "key"])
        .withColumn("parts", parts)
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("choice", "key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp")
    )
    group = ["choice", "key", "low", "high"]
    dealt = tiles.repartition(*group).sortWithinPartitions(*group)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 50_000:
                continue
            # The last group may go on in the next batch; a tile holds 2 * TILE rows, a few more by chance.
            table = pa.Table.from_batches(held)
            key = _group_numbers(table, group)
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield from found(table.slice(0, cut), key[:cut])
            held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from found(table, _group_numbers(table, group))

    def found(table, key):
        fp = table.column("fp").to_numpy()
        a, b = _close(key, fp, distance)
        yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _group_numbers(table: pa.Table, columns: list[str]) -> np.ndarray:
    changes = np.zeros(table.num_rows, dtype=bool)
    for name in columns:
        values = table.column(name).to_numpy()
        changes[1:] |= values[1:] != values[:-1]
    return np.cumsum(changes)


def _classes(marked: DataFrame, distance: int) -> DataFrame:
    """For each fingerprint of ``marked`` (doc_id, fp): ``named_fp``, ``component`` and ``component_id``."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    return _named(distinct, components(links(distinct.select("fp"), distance)))


def _named(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``named_fp``, ``component`` and ``component_id`` of each row of ``distinct`` (fp, first_id) under the components ``found``."""
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("named_fp"), "first_id", F.coalesce("component", "fp").alias("component")
    )
    named = written(named, "classes")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return named.join(least, "component").select("named_fp", "component", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, distance: int = 3) -> DataFrame:
    """Each row's doc_id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links."""
    marked = written(fingerprints(docs, text, id_col, shingle), "fingerprints")
    return marked.join(_classes(marked, distance), F.col("fp") == F.col("named_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of ``docs`` for each class: that of the class's smallest id.

    Of several rows with that id in one class the first by text and then by all columns stays. A class whose
    rows have no id keeps one row too.
    """
    columns = [c for c in docs.columns if c not in ("_fp", "named_fp", "component", "component_id")]

    def run(batches):
        for batch in batches:
            raw = batch.column(columns.index(text)).cast(pa.binary())
            fps = pa.array([simhash(value.as_py(), shingle) for value in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=[*columns, "_fp"])

    frame = docs.select(*columns)
    schema = T.StructType([*frame.schema.fields, T.StructField("_fp", T.LongType())])
    marked = written(frame.mapInArrow(run, schema), "marked")
    classes = _classes(marked.select(F.col(id_col).alias("doc_id"), F.col("_fp").alias("fp")), distance)
    return _first_of_classes(marked, classes, columns, text, id_col)


def _first_of_classes(marked: DataFrame, classes: DataFrame, columns: list[str], text: str, id_col: str) -> DataFrame:
    first = marked.join(classes, (F.col("_fp") == F.col("named_fp")) & F.col(id_col).eqNullSafe(F.col("component_id")))
    order = Window.partitionBy("component").orderBy(*[F.col(c) for c in (text, *(c for c in columns if c != text))])
    return first.withColumn("_row", F.row_number().over(order)).where("_row = 1").select(*columns)


def _candidate_groups(sets: DataFrame) -> DataFrame:
    """(node, component): groups of sets (``fp``, ``bands``; distinct) that hang together by shared band keys."""
    rows = sets.select("fp", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = rows.join(shared, ["band", "key"]).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return components(stars.distinct())


def similar_links(sets: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between shingle sets of at least this exact Jaccard similarity, up to the chains of other links.

    ``sets``: fp, n_shingles and bands of each distinct set; ``texts``: fp and text, sets possibly several times.
    Candidate groups come from bands of minima; within a group every pair is compared, in tiles of bounded size.
    """
    groups = written(_candidate_groups(sets), "candidate-groups")
    members = groups.join(sets.select("fp", "n_shingles"), F.col("node") == F.col("fp")).select("fp", "component", "n_shingles")
    sized = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"))
    parts = F.greatest(F.ceil(F.col("n") / SET_TILE), F.ceil(F.col("weight") / SET_TILE_SHINGLES), F.lit(1)).cast("int")
    placed = (
        members.join(sized.select("component", parts.alias("parts")), "component")
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .select("fp", "component", "parts", "part")
    )
    wanted = texts.join(groups.select("node"), F.col("fp") == F.col("node"), "left_semi").dropDuplicates(["fp"])
    tiles = (
        wanted.join(placed, "fp")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("component", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "fp", "text")
    )

    def found(table: pa.Table) -> pa.Table:
        sets = [shingle_set(value.as_py(), shingle) for value in table.column("text").cast(pa.binary())]
        a, b = _similar(sets, similarity)
        fp = table.column("fp").to_numpy()
        return pa.table({"a": pa.array(fp[a], pa.int64()), "b": pa.array(fp[b], pa.int64())})

    return tiles.groupBy("component", "low", "high").applyInArrow(found, "a long, b long")


def _fingerprint_links(marked: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) between shingle sets whose texts' fingerprints are equal or ``distance`` or fewer bits apart.

    ``marked``: _fp (set) and _sim (fingerprint); texts of one set differ in fingerprint where they repeat shingles otherwise.
    """
    met = marked.select(F.col("_sim").alias("sim"), F.col("_fp").alias("fp")).distinct()
    least = written(met.groupBy("sim").agg(F.min("fp").alias("least")), "fingerprint-sets")
    equal = met.join(least, "sim").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    near = links(least.select(F.col("sim").alias("fp")), distance)
    ends = near.join(least.select(F.col("sim").alias("a"), F.col("least").alias("_a")), "a").join(
        least.select(F.col("sim").alias("b"), F.col("least").alias("_b")), "b"
    )
    return equal.unionByName(ends.where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def keep_first_similar(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5, similarity: float = 0.8, distance: int = 3
) -> DataFrame:
    """One row of ``docs`` for each class of texts linked by their fingerprints or by the similarity of their shingle sets.

    Fingerprints link at ``distance`` or fewer bits, as in `keep_first`; sets of a Jaccard similarity of ``similarity`` or more
    link where fingerprints do not reach. The row that stays is chosen as in `keep_first`; null and empty texts are one
    class. Bands are made for a similarity of 0.8: what they miss of pairs there is given at ``BANDS``, of more similar ones
    it is less.
    """
    columns = [c for c in docs.columns if c not in ("_fp", "_sim", "_bands", "_n", "named_fp", "component", "component_id")]

    def run(batches):
        for batch in batches:
            found, sets = [], []
            for value in batch.column(columns.index(text)).cast(pa.binary()):
                # Hashed once for the fingerprint, which counts repeats, and the set, which does not.
                parts = list(_shingle_hashes(value.as_py(), shingle))
                found.append(_fingerprint(parts))
                sets.append(_distinct(parts))
            sims = pa.array(found, pa.int64())
            fps = pa.array([xxhash.xxh64_intdigest(s.tobytes(), seed=42) - (1 << 63) if len(s) else 0 for s in sets], pa.int64())
            bands = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps, sims, bands, sizes], names=[*columns, "_fp", "_sim", "_bands", "_n"])

    frame = docs.select(*columns)
    more = [
        T.StructField("_fp", T.LongType()), T.StructField("_sim", T.LongType()),
        T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_n", T.LongType()),
    ]
    marked = written(frame.mapInArrow(run, T.StructType([*frame.schema.fields, *more])), "marked")
    # One row of each set; copies differ neither in bands nor in size.
    sets = written(
        marked.groupBy("_fp").agg(F.min(id_col).alias("first_id"), F.min("_bands").alias("bands"), F.min("_n").alias("n_shingles"))
        .withColumnRenamed("_fp", "fp"),
        "shingle-sets",
    )
    by_bits = _fingerprint_links(marked, distance)
    by_sets = similar_links(sets, marked.select(F.col("_fp").alias("fp"), F.col(text).alias("text")), shingle, similarity)
    found = components(by_bits.unionByName(by_sets))
    return _first_of_classes(marked, _named(sets.select("fp", "first_id"), found), columns, text, id_col)
