"""Toxicity by a subsequence string kernel support vector machine with Nystroem landmarks.

Strings are compared by the gap-weighted subsequence kernel (Lodhi et al., 2002) of order three: a feature for each
triple of letters, to which every occurrence in order adds DECAY to the power of its span. Signs that are not
letters are gaps; vectors have length one, so a string stretched evenly (``i.d.i.o.t``, ``i d i o t``) stays
close to the plain one and an inserted letter changes little.

The units compared are the words of a sentence; runs of single letters count as one unit. A sentence is as toxic as
its worst unit and a text as its worst sentence. Labels come with whole texts, so training finds the
units that make the sentences of toxic texts toxic: those that are, or share a stretch of four letters with,
strings whose presence in toxic texts is no chance (likelihood ratio against the number of strings tried). They are
the positive units; units of the sentences of clean texts are negative, the hardest of them added in rounds. The
most frequent positive and the hardest negative units are landmarks; the kernel with them gives the features of a linear machine with squared hinge
loss. The result is a sum over landmark kernels, which is again one weight for each triple: scoring a unit is a sum
over its triples divided by its norm. Margins of whole texts become probabilities by a logistic fit.

Learning uses a bounded sample of labelled rows, whole texts: about ``TOXIC`` toxic and ``CLEAN`` clean ones by a
digest of the id; scoring uses every unit of every text, each different one once for each task's cache.

Defined results: null and empty texts have the margin of a text without letters; without toxic or without clean
labelled rows every score is 0; several labels of an id count as toxic if one is; null ids and labels teach nothing;
equal rows are scored alike; equal texts teach once; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.tables import held, written

TOXIC, CLEAN = 4000, 16_000
LANDMARKS = 600
NEGATIVES, HARD, ROUNDS = 2000, 1000, 4
POSITIVES = 20_000
DECAY = 0.7
#: Letters: a to z, then other letters by their code point, then the marks of a unit's start and end; 0 is a gap.
LETTERS = 42
_START, _END = 40, 41
#: Units beyond this length are compared window by window, half a window on.
WINDOW = 18
CACHE_UNITS = 400_000
_NO_LETTERS = -9.0


@cache
def _triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (3, n) of all triples of a string, and their decays."""
    places = np.array(list(combinations(range(length), 3)), dtype=np.int64).reshape(-1, 3).T
    return places, (DECAY ** (places[2] - places[0] + 1)).astype(np.float32)


_CODES = {chr(97 + i): i + 1 for i in range(26)}


def codes_of(unit: str) -> list[int]:
    """A lower-cased unit's letter codes between marks; gaps at the ends say nothing and go. No letters: nothing."""
    codes = [_CODES.get(c) or (27 + ord(c) % 13 if c.isalpha() else 0) for c in unit]
    while codes and not codes[-1]:
        codes.pop()
    start = next((i for i, c in enumerate(codes) if c), 0)
    return [_START, *codes[start:], _END] if codes else []


def windows_of(codes: list[int]) -> list[list[int]]:
    """The stretches of a unit that are compared; between them they hold every triple within half a window."""
    if len(codes) <= WINDOW:
        return [codes]
    return [codes[i : i + WINDOW] for i in range(0, len(codes) - WINDOW // 2, WINDOW // 2)]


def _by_length(strings: list[list[int]]):
    """Indices and code matrix of the strings of each length that has triples."""
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    for length in np.unique(lengths):
        if length >= 3:
            at = np.flatnonzero(lengths == length)
            yield at, np.array([strings[i] for i in at], dtype=np.int64)


def _features(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights (string, triple) of strings of one length; triples with a gap weigh 0."""
    places, decay = _triples(table.shape[1])
    a, b, c = (table[:, p] for p in places)
    return (a * LETTERS + b) * LETTERS + c, np.where((a > 0) & (b > 0) & (c > 0), decay, np.float32(0))


def norms(table: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each string of one length with itself, by the kernel's recursion."""
    n, length = table.shape
    same = (table[:, :, None] == table[:, None, :]) & (table > 0)[:, :, None]
    prefix = np.ones((length + 1, length + 1, n))
    for _ in range(2):
        nxt = np.zeros((length + 1, length + 1, n))
        for i in range(length):
            run = np.zeros(n)
            for j in range(length):
                run = DECAY * run + DECAY**2 * same[:, i, j] * prefix[i, j]
                nxt[i + 1, j + 1] = DECAY * nxt[i, j + 1] + run
        prefix = nxt
    total = np.einsum("nij,ijn->n", same, prefix[:length, :length]) * DECAY**2
    return np.sqrt(total)


class Landmarks:
    """Landmark strings as rows of length one over the triples that they hold."""

    def __init__(self, strings: list[list[int]]):
        found = [_features(table)[0].ravel() for _, table in _by_length(strings)]
        self.triples = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        #: The column of each triple; what no landmark holds goes to a last one that nobody reads.
        self.column = np.full(LETTERS**3, len(self.triples), dtype=np.int32)
        self.column[self.triples] = np.arange(len(self.triples), dtype=np.int32)
        self.rows = np.zeros((len(strings), len(self.triples)), dtype=np.float32)
        for at, part in self._vectors(strings):
            self.rows[at] = part

    def _vectors(self, strings: list[list[int]], block: int = 100):
        """Indices and vectors of length one over the landmarks' triples, some strings at a time."""
        for at, table in _by_length(strings):
            size = norms(table)
            for i in range(0, len(at), block):
                number, weight = _features(table[i : i + block])
                out = np.zeros((len(number), len(self.triples) + 1), dtype=np.float32)
                np.add.at(out, (np.arange(len(number))[:, None], self.column[number]), weight)
                part = size[i : i + block]
                yield at[i : i + block], out[:, :-1] / np.where(part > 0, part, 1)[:, None].astype(np.float32)

    def kernel(self, strings: list[list[int]]) -> np.ndarray:
        """Kernel of each string with each landmark."""
        out = np.zeros((len(strings), len(self.rows)), dtype=np.float32)
        for at, part in self._vectors(strings):
            out[at] = part @ self.rows.T
        return out

    def weights(self, by_landmark: np.ndarray) -> np.ndarray:
        """The weight of each triple in a sum over landmark kernels."""
        out = np.zeros(LETTERS**3, dtype=np.float32)
        out[self.triples] = by_landmark @ self.rows
        return out


@dataclass
class Model:
    """One weight for each triple, the offset, and the logistic map of margins; ``weights`` None knows nothing."""

    weights: np.ndarray | None = None
    offset: float = 0.0
    slope: float = 1.0
    middle: float = 0.0

    def margins(self, units: list[str]) -> np.ndarray:
        """The margin of each unit: its worst window."""
        parts, owner = [], []
        for i, unit in enumerate(units):
            for window in windows_of(codes_of(unit)):
                parts.append(window)
                owner.append(i)
        values = np.full(len(parts), self.offset)
        for at, table in _by_length(parts):
            for i in range(0, len(at), 5_000):
                number, weight = _features(table[i : i + 5_000])
                size = norms(table[i : i + 5_000])
                values[at[i : i + 5_000]] += (weight * self.weights[number]).sum(axis=1) / np.where(size > 0, size, 1)
        out = np.full(len(units), -np.inf)
        np.maximum.at(out, np.array(owner, dtype=np.int64), values)
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -60, 60)))


def separate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    width = x.shape[1] + 1
    penalty = ridge * np.eye(width)
    penalty[-1, -1] = 1e-9
    active = np.ones(len(x), dtype=bool)
    share = weight / weight.sum()
    parts = [slice(i, i + 1000) for i in range(0, len(x), 1000)]
    with_one = lambda part: np.hstack([x[part].astype(np.float64), np.ones((len(x[part]), 1))])
    for _ in range(40):
        square, side = penalty.copy(), np.zeros(width)
        for part in parts:  # some rows at a time: the driver holds no copy of them all
            a = with_one(part)[active[part]]
            weighed = a * share[part][active[part], None]
            square += a.T @ weighed
            side += weighed.T @ y[part][active[part]]
        w = np.linalg.solve(square, side)
        now = y * np.concatenate([with_one(part) @ w for part in parts]) < 1
        if np.array_equal(now, active):
            break
        active = now
    return w[:-1], float(w[-1])


def machine(positives: list[str], weights: list[float], negatives: list[str]) -> Model:
    """Kernel machine on landmark features; landmarks are taken evenly from both sides."""
    units = [codes_of(u)[:WINDOW] for u in (*positives, *negatives)]
    y = np.repeat([1.0, -1.0], [len(positives), len(negatives)])
    # Both sides weigh the same at first; hard negatives are more rows, not lighter ones.
    share = np.concatenate([np.array(weights) / max(sum(weights), 1e-9) * NEGATIVES, np.ones(len(negatives))])
    # Half of the landmarks are positive, from the most frequent on; of the negative ones the last come first: they
    # are the hardest.
    own = min(len(positives), LANDMARKS // 2)
    chosen = [*range(own), *range(max(len(positives), len(units) - (LANDMARKS - own)), len(units))]
    marks = Landmarks([units[i] for i in chosen])
    values, vectors = np.linalg.eigh((marks.rows @ marks.rows.T).astype(np.float64))
    large = values > 1e-5 * values.max()
    to_features = vectors[:, large] / np.sqrt(values[large])
    w, offset = separate(marks.kernel(units) @ to_features.astype(np.float32), y, share)
    return Model(marks.weights(to_features @ w), offset)


def _logistic(margin: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic fit with Platt's targets, both classes weighing the same."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic, 0.5 / n1, 0.5 / n0)
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * np.array([w[0], 0])
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-4, 1e-9])
        move = np.linalg.solve(hessian, gradient)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-7:
            break
    slope = max(w[0], 1e-3)
    return float(slope), float(-w[1] / slope)


@dataclass
class Units:
    """A worker's units and their margins."""

    model: Model
    number: dict[str, int] = field(default_factory=dict)
    margin: np.ndarray = field(default_factory=lambda: np.zeros(0))
    single: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=bool))

    def _learn(self, units: list[str]) -> None:
        at = len(self.number)
        values = self.model.margins([u.lower() for u in units])
        single = np.array([len(u) == 1 and u.isalpha() for u in units], dtype=bool)
        need = at + len(units)
        if need > len(self.margin):
            grown = max(need, 2 * len(self.margin), 4096)
            self.margin = np.concatenate([self.margin, np.zeros(grown - len(self.margin))])
            self.single = np.concatenate([self.single, np.zeros(grown - len(self.single), dtype=bool)])
        self.margin[at:need], self.single[at:need] = values, single
        self.number.update(zip(units, range(at, need), strict=True))

    def worst(self, texts: list[str | None]) -> tuple[np.ndarray, list[str | None]]:
        """The worst margin of each text and the unit that has it."""
        tokens = [t.split() if t else [] for t in texts]
        if len(self.number) > CACHE_UNITS:
            self.number.clear()
        new = list(set(chain.from_iterable(tokens)).difference(self.number))
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        known = self.number.__getitem__
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = np.fromiter(map(known, chain.from_iterable(tokens)), dtype=np.int64, count=int(sizes.sum()))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        worst = np.full(len(texts), max(self.model.offset, _NO_LETTERS) if self.model.weights is not None else _NO_LETTERS)
        unit: list[str | None] = [None] * len(texts)
        margin = self.margin[flat]
        filled = np.flatnonzero(sizes)
        if len(filled):
            worst[filled] = np.maximum.reduceat(margin, starts[filled])
        for i in filled.tolist():
            unit[i] = tokens[i][int(margin[starts[i] : ends[i]].argmax())]
        for i, spelled in self._spelled(tokens, flat, starts, sizes):
            value = float(self.model.margins([spelled.lower()])[0])
            if value > worst[i]:
                worst[i], unit[i] = value, spelled
        return worst, unit

    def _spelled(self, tokens, flat, starts, sizes):
        """Runs of three single letters or more, with the text they are in."""
        alone = self.single[flat]
        if not alone.any():
            return
        text = np.repeat(np.arange(len(sizes)), sizes)
        begins = alone.copy()
        begins[1:] &= ~(alone[:-1] & (text[1:] == text[:-1]))
        run = np.cumsum(begins) - 1
        length = np.bincount(run[alone])
        for r, at in zip(np.flatnonzero(length >= 3), np.flatnonzero(begins)[length >= 3], strict=True):
            i = int(text[at])
            first = int(at - starts[i])
            yield i, " ".join(tokens[i][first : first + int(length[r])])


def units_of(text: str | None) -> set[str]:
    """Different units of a text, lower-cased, as learning counts them."""
    tokens = text.lower().split() if text else []
    found = {t for t in tokens if len(t) > 1}
    run: list[str] = []
    for token in [*tokens, ""]:
        if len(token) == 1 and token.isalpha():
            run.append(token)
        else:
            if len(run) >= 3:
                found.add(" ".join(run))
            run = []
    return found


def _stretches(unit: str) -> set[str]:
    letters = "".join(c for c in unit if c.isalpha())
    return {letters[i : i + 4] for i in range(len(letters) - 3)}


def _evidence(sample: DataFrame) -> DataFrame:
    """How many toxic and clean texts of (text, toxic) hold each unit (kind 0) and each stretch of four letters (kind 1)."""

    def run(batches):
        counts: dict[tuple[int, str], list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = units_of(text)
                for key in [*((0, u) for u in units), *((1, s) for s in set().union(*map(_stretches, units)))] if units else []:
                    counts.setdefault(key, [0, 0])[0 if toxic else 1] += 1
                if len(counts) > 300_000:
                    yield flush(counts)
                    counts = {}
        if counts:
            yield flush(counts)

    def flush(counts):
        kinds, texts = zip(*counts, strict=True)
        toxic, clean = zip(*counts.values(), strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.int32()), pa.array(texts), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["kind", "unit", "a", "b"]
        )

    return sample.mapInArrow(run, "kind int, unit string, a long, b long").groupBy("kind", "unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of a bounded number of labelled rows (about ``TOXIC`` and ``CLEAN``), equal texts once."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    most = {True: TOXIC, False: CLEAN}
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    is_toxic = F.col("toxic") == 1
    limit = F.when(is_toxic, min(1.0, most[True] / max(counts.get(True, 0), 1))).otherwise(min(1.0, most[False] / max(counts.get(False, 0), 1)))
    # The ids that are left are bounded by the two numbers above, so they may be sent to every task.
    ids = known.where(chance < limit).select(F.col("doc_id").alias("_id"), is_toxic.alias("toxic"))
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).where("text is not null")
    return rows.groupBy("text").agg(F.max("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the texts (doc_id, text) that have labels (doc_id, toxic)."""
    spark = docs.sparkSession
    sample = written(_sample(docs, labels), "toxicity-sample").repartition(max(8, spark.sparkContext.defaultParallelism))
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return Model()
    evidence = written(_evidence(sample), "toxicity-evidence")
    rate = toxic / (toxic + clean)
    tried = evidence.where("kind = 0 and a + b >= 4").count()  # fewer texts cannot be beyond chance
    a, b = F.col("a"), F.col("b")
    purity = a / (a + b)
    ratio = a * F.log(purity / rate) + F.when(b > 0, b * F.log((1 - purity) / (1 - rate))).otherwise(0.0)
    beyond_chance = evidence.where((a > 0) & (purity >= F.when(F.col("kind") == 0, 0.8).otherwise(0.95)) & (ratio > math.log(max(tried, 2)) + 1))
    strong = beyond_chance.select("kind", "unit", "a").orderBy(a.desc(), "unit").limit(POSITIVES).collect()
    units = {r["unit"] for r in strong if r["kind"] == 0}
    stretches = {r["unit"] for r in strong if r["kind"] == 1}
    pure = evidence.where((F.col("kind") == 0) & (a > 0) & (purity >= 0.8)).select("unit", "a").orderBy(a.desc(), F.xxhash64("unit")).limit(POSITIVES).collect()
    positive = {r["unit"]: r["a"] for r in pure if r["unit"] in units or _stretches(r["unit"]) & stretches}
    positive = {u: n for u, n in positive.items() if len(codes_of(u)) >= 5}
    if not positive:
        return Model()
    chosen = sorted(positive, key=lambda u: (-positive[u], u))[:2000]
    others = evidence.where((F.col("kind") == 0) & (b > 0) & (purity < 0.5)).select("unit")
    negatives = [r["unit"] for r in others.orderBy(F.xxhash64("unit"), "unit").limit(NEGATIVES).collect()]
    for turn in range(ROUNDS):
        model = machine(chosen, [math.sqrt(positive[u]) for u in chosen], negatives)
        if turn + 1 < ROUNDS:
            # The hardest ones come last, where landmarks are taken from.
            worst = _unit_margins(others, model).orderBy(F.col("margin").desc(), "unit").limit(HARD).collect()
            hardest = [r["unit"] for r in reversed(worst)]
            negatives = [u for u in negatives if u not in set(hardest)] + hardest
    scored = _text_margins(sample, model, ("toxic",)).select("toxic", F.col("_margin").alias("margin")).toPandas()
    model.slope, model.middle = _logistic(scored["margin"].to_numpy(), scored["toxic"].to_numpy(dtype=bool))
    return model


def _unit_margins(units: DataFrame, model: Model) -> DataFrame:
    shared = units.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.margins(batch.column(0).to_pylist()))], names=["unit", "margin"])

    return units.mapInArrow(run, "unit string, margin double")


def _text_margins(docs: DataFrame, model: Model, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep``, ``_margin`` and ``_worst``, the worst unit, of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*keep, F.col(text).alias("_text"))
    names = [*keep, "_margin", "_worst"]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            for a, b in _blocks(texts):
                if shared.value.weights is None:
                    margin, worst = np.full(b - a, _NO_LETTERS), [None] * (b - a)
                else:
                    margin, worst = held("units", shared.value, lambda: Units(shared.value)).worst(texts[a:b])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(margin, pa.float64()), pa.array(worst, pa.string())], names=names)

    more = [T.StructField("_margin", T.DoubleType()), T.StructField("_worst", T.StringType())]
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields[: len(keep)], *more]))


def _blocks(texts: list[str | None], most: int = 3_000_000):
    """Index ranges of texts that hold a bounded number of characters together, or one text."""
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if texts:
        yield start, len(texts)


def _probability(model: Model) -> Column:
    if model.weights is None:
        return F.lit(0.0)
    bounded = F.greatest(F.least(F.lit(model.slope) * (F.col("_margin") - F.lit(model.middle)), F.lit(60.0)), F.lit(-60.0))
    return 1 / (1 + F.exp(-bounded))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score (0 to 1) and the worst unit of each row."""
    return _text_margins(docs, model, keep, text).select(*keep, _probability(model).alias("score"), F.col("_worst").alias("worst"))


def held_out(id_column: Column, folds: int = 3, out: int = 1) -> Column:
    """Whether crc32 of the id as text falls in the fold that is not learnt from."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == out


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 at the threshold or above) and the worst unit of each row of ``docs``."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    learnable = labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = learn(rows.where(~F.col("held_out")).select("doc_id", "text"), learnable)
    return score(rows, model, keep=("doc_id", "held_out")).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst"
    )


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    model = learn(docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))), labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"))))
    return _text_margins(docs, model, tuple(docs.columns)).where(_probability(model) < threshold).select(*docs.columns)
