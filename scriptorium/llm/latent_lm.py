"""Hidden Markov language model: counts, Baum-Welch over partitions, exact likelihood by the scaled forward recursion.

The model writes a text as words and one end. Hidden states follow a first-order chain; a state emits a symbol:
one of the most frequent words, the end, or a class of rarer words (by a digest of the last letters). A rarer word is
then drawn within its class by its smoothed count, the same in all states, so its share is a factor of the likelihood
that no state changes, and unknown words keep a share of their class. Everything that the corpus says is gathered
over all training rows:

1. Word counts: tasks count their words, partial counts are summed by word. The result is a table; only its
   most frequent ``HEAD`` words and the sums of the word classes are sent to tasks (both of bounded size).
2. Texts become symbol arrays, written once. Words beyond the head are joined with the count table by word; a
   document takes part with sums only.
3. For training, a text is cut into segments of ``SEGMENT`` tokens, the later ones starting from the states' overall
   shares. Baum-Welch starts from a few rounds on a bounded sample of segments from anywhere in texts
   (``SAMPLE_SEGMENTS``), which only sets the starting point; then passes go over all training segments until one gains
   less than ``GAIN`` of the log likelihood. Tasks add up expected counts and the log likelihood, the sums per symbol
   and state come to the driver: their number is fixed by the model.
4. Scoring runs the forward recursion over each whole text.

Defined results: null texts are empty (one end); a null id counts as the empty text for the fold and stays null; equal
rows are scored and counted one by one; without training rows the counts are zero and the base score is that of an
unseen token; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.tables import cut_at, held, text_slices, written

HEAD = 100_000
OWN = 24_000
CLASSES = 1024
STATES = 8
SEGMENT = 128
SAMPLE_SEGMENTS = 6_000
SAMPLE_ROUNDS = 25
#: Passes over all segments end when the log likelihood grows by less than this share of it.
GAIN = 1e-3
_LOCAL_WORDS = 250_000
_SEED = 11


def held_out(id_column: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold that is not learnt from."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def _words(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.lower().split() if text else []


def _class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _raw(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, class and count over all rows of ``docs``."""

    def run(batches):
        counts: Counter[bytes] = Counter()

        def flush():
            words = list(counts)
            columns = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(map(_class_of, words), pa.int32()), pa.array(counts.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "class", "n"])

        for batch in batches:
            for value in _raw(batch.column(0)):
                counts.update(_words(value))
                if len(counts) > _LOCAL_WORDS:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    return docs.select(text).mapInArrow(run, "word string, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """Counts that every task knows: head words in order of rank, class sums, totals."""

    words: list[bytes]
    counts: np.ndarray
    class_sums: np.ndarray
    total: int
    distinct: int
    ends: int
    #: How many head words have a symbol of their own.
    own: int

    @property
    def symbols(self) -> int:
        """Own words, then the end, then the classes."""
        return self.own + 1 + CLASSES

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def vocabulary(counts: DataFrame, n_docs: int) -> Vocabulary:
    """``counts`` (word, class, c) of the training texts and their number, which is the count of ends."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # The head: all words from a count on, so that no task has to send its own most frequent ones. Counts are
    # binned eight to a doubling; the lowest bin that still fits is the border.
    bins = F.floor(F.log2("c") * 8).cast("int").alias("bin")
    room, border = HEAD, None
    for r in counts.groupBy(bins).agg(F.count("*").alias("n")).orderBy(F.col("bin").desc()).collect():
        room -= r["n"]
        if room < 0:
            break
        border = r["bin"]
    head = counts.where(bins >= border if border is not None else F.lit(False)).select("word", "c").toArrow()
    head = head.sort_by([("c", "descending"), ("word", "ascending")])
    words = head.column("word").cast(pa.binary()).to_pylist()
    frequency = head.column("c").to_numpy()
    own = words[:OWN]
    sums = np.full(CLASSES, 0.5)  # the share of unknown words
    for r in counts.groupBy("class").agg(F.sum(F.col("c") + 0.5).alias("s")).collect():
        sums[r["class"]] += r["s"]
    np.subtract.at(sums, np.array([_class_of(w) for w in own], dtype=np.int64), frequency[:OWN] + 0.5)
    sums = np.maximum(sums, 0.5)
    return Vocabulary(words, frequency, sums, totals["n"] + n_docs, totals["v"] + (n_docs > 0), n_docs, len(own))


class _Encoder:
    """Symbols and known sums of texts, in one worker."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.rank = {w: i for i, w in enumerate(v.words)}
        head = np.arange(len(v.words))
        classes = np.fromiter(map(_class_of, v.words), dtype=np.int64, count=len(v.words))
        self.symbol = np.where(head < v.own, head, v.own + 1 + classes).astype(np.int32)
        self.base = v.base(v.counts.astype(np.float64))
        # What a head word without a symbol of its own adds to the likelihood within its class.
        self.share = np.where(head < v.own, 0.0, np.log10((v.counts + 0.5) / v.class_sums[classes]))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes], int, float, float]:
        """Symbols with the end, words beyond the head, number of head words, their base score, the classes' shares."""
        find = self.rank.get
        ranks = np.fromiter((find(w, -1) for w in words), dtype=np.int64, count=len(words))
        far = np.flatnonzero(ranks < 0)
        symbols = np.empty(len(words) + 1, dtype=np.int32)
        symbols[-1] = self.v.own
        near = ranks >= 0
        symbols[:-1][near] = self.symbol[ranks[near]]
        tail = [words[i] for i in far.tolist()]
        base, share = float(self.base[ranks[near]].sum()), float(self.share[ranks[near]].sum())
        if tail:
            classes = np.fromiter(map(_class_of, tail), dtype=np.int64, count=len(tail))
            symbols[far] = self.v.own + 1 + classes
            share -= float(np.log10(self.v.class_sums[classes]).sum())
        return symbols, tail, int(near.sum()), base, share


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """row, doc_id, held_out, symbols, tail words and the sums over head words of each row (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(v)
    names = ["row", "doc_id", "held_out", "symbols", "tail", "n_head", "base", "share"]

    def run(batches):
        encoder, row = None, TaskContext.get().partitionId() << 36
        for batch in text_slices(batches, "text"):
            encoder = encoder or held("encoder", shared.value, lambda: _Encoder(shared.value))
            out = [encoder.encode(_words(value)) for value in _raw(batch.column("text"))]
            symbols, tails, n_head, base, share = zip(*out, strict=True) if out else ((),) * 5
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in symbols])]).astype(np.int32))
            flat = pa.array(np.concatenate(symbols) if symbols else np.zeros(0, np.int32))
            tail_offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tails])]).astype(np.int32))
            tail = pa.array([w for t in tails for w in t], pa.binary()).cast(pa.string())
            columns = [
                pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), batch.column("held_out"),
                pa.ListArray.from_arrays(offsets, flat), pa.ListArray.from_arrays(tail_offsets, tail),
                pa.array(n_head, pa.int64()), pa.array(base, pa.float64()), pa.array(share, pa.float64()),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, symbols array<int>, tail array<string>, n_head long, base double, share double"
    )


@dataclass
class Model:
    """Start, transition (from, to) and emission (symbol, state) probabilities, and the states' overall shares."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    shares: np.ndarray


def _first_model(symbols: int, counts: np.ndarray, rng: np.random.Generator) -> Model:
    """States that differ a little at random around the overall shares of symbols, and like to stay."""
    emit = (counts + 0.5)[:, None] * rng.uniform(0.2, 1.8, size=(symbols, STATES))
    step = np.full((STATES, STATES), 0.4 / (STATES - 1)) if STATES > 1 else np.ones((1, 1))
    np.fill_diagonal(step, 0.6 if STATES > 1 else 1.0)
    even = np.full(STATES, 1 / STATES)
    return Model(even, step, emit / emit.sum(axis=0), even)


def _padded(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments by falling size as columns of a (time, segment) matrix, and how many are still open at each time."""
    longest = int(sizes.max())
    at = np.arange(longest)[:, None]
    inside = at < sizes[None, :]
    table = symbols[np.where(inside, starts[None, :] + at, 0)]
    return table, inside.sum(axis=1)


def expected_counts(model: Model, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray):
    """Expected starts, transitions and emissions (symbol, state) over segments; ``first``: those that begin a text.

    Segments come by falling size. Forward and backward variables are scaled by the same factors.
    """
    table, open_ = _padded(symbols, starts, sizes)
    longest, n = table.shape
    alpha = np.zeros((longest, n, STATES))
    scale = np.ones((longest, n))
    entry = np.where(first[:, None], model.start, model.shares)
    for t in range(longest):
        k = open_[t]
        a = (entry if t == 0 else alpha[t - 1, :k] @ model.step)[:k] * model.emit[table[t, :k]]
        scale[t, :k] = a.sum(axis=1)
        alpha[t, :k] = a / scale[t, :k, None]
    beta = np.ones((n, STATES))
    transitions = np.zeros((STATES, STATES))
    emitted = np.zeros((model.emit.shape[0], STATES))
    gamma = alpha  # overwritten from the end: alpha[t] * beta[t]
    for t in range(longest - 1, -1, -1):
        k = open_[t]
        if t + 1 < longest and open_[t + 1]:
            m = open_[t + 1]
            onward = model.emit[table[t + 1, :m]] * beta[:m] / scale[t + 1, :m, None]
            transitions += model.step * (alpha[t, :m].T @ onward)
            beta[:m] = onward @ model.step.T
        gamma[t, :k] = alpha[t, :k] * beta[:k]
    inside = np.arange(n)[None, :] < open_[:, None]
    flat, weight = table[inside], gamma[inside]
    for s in range(STATES):
        emitted[:, s] = np.bincount(flat, weights=weight[:, s], minlength=len(emitted))
    return gamma[0][first].sum(axis=0), transitions, emitted, float(np.log(scale[inside]).sum())


def updated(model: Model, starts: np.ndarray, transitions: np.ndarray, emitted: np.ndarray, overall: np.ndarray) -> Model:
    """The next model; emissions keep a little of the overall shares of symbols, so that none is impossible."""
    start = (starts + 0.1) / (starts + 0.1).sum()
    step = (transitions + 0.1) / (transitions + 0.1).sum(axis=1, keepdims=True)
    emit = emitted + overall[:, None] * (1 + 0.01 * emitted.sum(axis=0))
    total = emitted.sum(axis=0) + 1e-9
    return Model(start, step, emit / emit.sum(axis=0), total / total.sum())


def _segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and first flags of the segments of texts that lie one after the other, by falling size."""
    ends = np.cumsum(sizes)
    parts = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = (ends - sizes)[text] + number * SEGMENT
    size = np.minimum(SEGMENT, ends[text] - start)
    order = np.argsort(-size, kind="stable")
    return start[order], size[order], number[order] == 0


def _token_slices(batches, column: int, most: int):
    """Batches with about ``most`` symbols at most in a list column, or one row."""
    for batch in batches:
        if batch.num_rows:
            sizes = np.diff(batch.column(column).offsets.to_numpy())
            yield from cut_at(batch, sizes, most)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _pass(training: DataFrame, model: Model, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts and the log likelihood over all training rows, summed across tasks."""
    shared = training.sparkSession.sparkContext.broadcast(model)
    names = ["kind", "place", *(f"s{i}" for i in range(STATES))]

    def run(batches):
        model = shared.value
        sums = None
        for batch in _token_slices(batches, 0, 400_000):
            symbols, sizes = _flat(batch.column(0))
            starts, lengths, first = _segments(sizes)
            for at in range(0, len(starts), 1024):
                part = slice(at, at + 1024)
                got = expected_counts(model, symbols, starts[part], lengths[part], first[part])
                sums = [a + b for a, b in zip(sums, got, strict=True)] if sums else list(got)
        if sums:
            start, step, emitted, log = sums
            seen = np.flatnonzero(emitted.any(axis=1))
            rows = np.vstack([start[None, :], step, emitted[seen], np.full((1, STATES), log)])
            kinds = np.repeat([0, 1, 2, 3], [1, STATES, len(seen), 1]).astype(np.int32)
            places = np.concatenate([[0], np.arange(STATES), seen, [0]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(places), *(pa.array(rows[:, i]) for i in range(STATES))], names=names)

    schema = ", ".join(["kind int", "place int", *(f"s{i} double" for i in range(STATES))])
    sums = training.select("symbols").mapInArrow(run, schema).groupBy("kind", "place").agg(*[F.sum(n).alias(n) for n in names[2:]])
    start, step, emitted, log = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((v.symbols, STATES)), np.zeros((1, STATES))
    got = sums.toArrow()
    kind, place = got.column("kind").to_numpy(), got.column("place").to_numpy()
    values = np.stack([got.column(n).to_numpy() for n in names[2:]], axis=1) if len(kind) else np.zeros((0, STATES))
    for number, target in enumerate((start[None, :], step, emitted, log)):
        target[place[kind == number]] = values[kind == number]
    return start, step, emitted, float(log[0, 0])


def _overall(v: Vocabulary) -> np.ndarray:
    counts = np.concatenate([v.counts[: v.own] + 0.5, [v.ends + 0.5], v.class_sums])
    return counts / counts.sum()


def _sample(training: DataFrame) -> pa.Table:
    """symbols and first flag of about ``SAMPLE_SEGMENTS`` segments from anywhere in texts, by a digest of text and place."""
    parts = F.ceil(F.size("symbols") / SEGMENT).cast("int")
    total = training.agg(F.sum(parts)).first()[0] or 0
    chance = int((1 << 40) * min(1.0, SAMPLE_SEGMENTS / max(total, 1)))
    numbers = F.filter(F.sequence(F.lit(0), parts - 1), lambda i: F.pmod(F.xxhash64("row", i), F.lit(1 << 40)) < chance)
    chosen = training.where(F.size("symbols") > 0).select("symbols", F.explode(numbers).alias("number"))
    return chosen.select(F.slice("symbols", F.col("number") * SEGMENT + 1, SEGMENT).alias("symbols"), (F.col("number") == 0).alias("first")).toArrow()


def train(training: DataFrame, v: Vocabulary) -> Model:
    """The model after a start on a bounded sample of segments and passes over all training rows until they gain little."""
    overall = _overall(v)
    rng = np.random.default_rng(_SEED)
    model = _first_model(v.symbols, overall * v.total, rng)
    sample = _sample(training)
    if sample.num_rows:
        symbols, sizes = _flat(sample.column("symbols").combine_chunks())
        order = np.argsort(-sizes, kind="stable")
        starts, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
        first = sample.column("first").to_numpy()[order]
        for _ in range(SAMPLE_ROUNDS):
            parts = [slice(i, i + 1024) for i in range(0, len(starts), 1024)]
            got = [expected_counts(model, symbols, starts[p], lengths[p], first[p])[:3] for p in parts]
            model = updated(model, *(sum(x) for x in zip(*got, strict=True)), overall)
    before = -np.inf
    while True:
        *counts, log = _pass(training, model, v)
        if not log:
            return model
        model = updated(model, *counts, overall)
        if log - before < GAIN * abs(log):
            return model
        before = log


def log_likelihoods(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log10 probability of each whole symbol sequence, by the scaled forward recursion."""
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    size = sizes[order]
    open_ = np.searchsorted(-size, -np.arange(int(size.max())), side="left") if len(size) else []
    alpha = np.tile(model.start, (len(size), 1))
    total = np.zeros(len(size))
    for t, k in enumerate(open_):
        if t:
            alpha = alpha[:k] @ model.step
        alpha = alpha[:k] * model.emit[symbols[starts[:k] + t]]
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:k] += np.log10(scale)
    out = np.empty(len(size))
    out[order] = total
    return out


def _likelihoods(texts: DataFrame, model: Model) -> DataFrame:
    """row and log10 likelihood of the symbols of each row."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in _token_slices(batches, 1, 4_000_000):
            scores = log_likelihoods(shared.value, *_flat(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), *batch.columns[2:]], names=["row", "chain", *batch.schema.names[2:]]
            )

    rest = ["doc_id", "held_out", "n_head", "base", "share", "n_tokens"]
    frame = texts.select("row", "symbols", *rest[:-1], F.size("symbols").cast("long").alias("n_tokens"))
    schema = ", ".join(f"{n} {frame.schema[n].dataType.simpleString()}" for n in rest)
    return frame.mapInArrow(run, f"row long, chain double, {schema}")


def score(docs: DataFrame, text: str = "text", id_col: str = "doc_id", fold: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``."""
    out = held_out(F.col(id_col)) if fold is None else fold
    rows = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = written(word_counts(training, "text"), "word-counts")
    v = vocabulary(counts, training.count())
    texts = written(encoded(rows, v), "symbols")
    model = train(texts.where(~F.col("held_out")), v)

    # Words beyond the head: their counts are met by a join on the word; a row keeps two sums.
    tail = texts.select("row", F.explode("tail").alias("word"))
    tail_sums = (
        tail.join(counts.select("word", "c"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"), F.count("c").alias("tail_known"), F.count("*").alias("n_tail"))
    )
    scores = _likelihoods(texts, model).join(tail_sums, "row", "left")
    norm = float(np.log10(v.total + 0.5 * (v.distinct + 1)))
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("base") + tail_log - norm * F.coalesce("n_tail", F.lit(0)) + F.lit(float(v.base(np.float64(v.ends))))
    return scores.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("tail_known", F.lit(0)) + int(v.ends > 0)).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("chain") + F.col("share") + tail_log).alias("score"),
    )
