"""Language identification: script ranges narrow the candidates, Viterbi over word scores labels spans.

Learning counts character n-grams (1 to 4, with word borders) and scripts by language on a bounded sample of the
labelled rows: about ``SAMPLE`` rows of each language, chosen by a digest of the text, whole texts. The ``GRAMS`` most
frequent n-grams become the model, whose size therefore is fixed. A word's score for a language is the sum of its
n-grams' log shares, less their mean over languages, damped and bounded; languages that hardly ever use the word's script
are out, unless none uses it. The best sequence of labels pays ``SWITCH`` for every change of language. A text's
language is the one with the most letters under its labels.

Defined results: null texts and texts without letters are ``und`` with score 0; without labelled rows every text is
``und``; equal counts of letters go to the language with more training rows, then to the first name; null ids and
repeated rows are rows like any others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.tables import held, written

SAMPLE = 4000
GRAMS = 120_000
SWITCH = 6.0
#: Damping of a word's score (its n-grams overlap) and its bound.
DAMPING, BOUND = 0.5, 8.0
CACHE_WORDS = 900_000
_CELLS = 8_000_000

#: Code point ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}

_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


_NAMES = [*SCRIPTS, "other"]
_STARTS, _ENDS, _OWNERS = (np.array(x) for x in zip(*sorted((a, b, i) for i, r in enumerate(SCRIPTS.values()) for a, b in r), strict=True))
_SPACE = 32


def letters_of(token: str) -> str:
    """The letters of a token without white space, lower-cased; parts that other signs divide are kept apart by a space."""
    if not token.isalpha():
        token = " ".join(_LETTERS.findall(token))
    return token.lower() if token.isascii() else unicodedata.normalize("NFC", token.lower())


class Grams:
    """N-grams, scripts and letters of many words at once.

    The words stand in one array of code points, each after a space. An n-gram is a 64-bit number; it may begin or end
    with a space, the border of its word, but holds none inside.
    """

    def __init__(self, words: list[str]):
        self.n = len(words)
        self.points = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        self.owner = np.repeat(np.arange(len(words)), sizes)
        self.letter = self.points != _SPACE

    def numbers(self):
        """For each length: the numbers of its n-grams and the words that have them."""
        key = np.zeros(len(self.points), dtype=np.uint64)
        free = np.ones(len(self.points), dtype=bool)
        for n in (1, 2, 3, 4):
            last = len(self.points) - n + 1
            if last <= 0:
                return
            key = (key[:last] * np.uint64(0x9E3779B97F4A7C15)) ^ (self.points[n - 1 :] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n))
            key ^= key >> np.uint64(29)
            if n > 2:  # what was the last sign is inside now
                free = free[:last] & self.letter[n - 2 : n - 2 + last]
            fits = free[:last] & (self.letter[:last] | self.letter[n - 1 : n - 1 + last])
            at = np.flatnonzero(fits[: len(self.owner)])
            yield key[at], self.owner[at]

    def scripts(self) -> tuple[np.ndarray, np.ndarray]:
        """The script of most letters of each word (a number of ``_NAMES``), and its number of letters."""
        at = np.flatnonzero(self.letter)
        point = self.points[at].astype(np.int64)
        range_ = np.searchsorted(_STARTS, point, side="right") - 1
        script = np.where((range_ >= 0) & (point <= _ENDS[range_]), _OWNERS[range_], len(_NAMES) - 1)
        counts = np.bincount(self.owner[at] * len(_NAMES) + script, minlength=self.n * len(_NAMES)).reshape(self.n, len(_NAMES))
        return counts.argmax(axis=1), counts.sum(axis=1)


@dataclass
class Model:
    """Languages by falling number of training rows, n-grams (sorted numbers), their scores (n-gram, language), scripts (script, language)."""

    languages: list[str]
    grams: np.ndarray
    scores: np.ndarray
    scripts: np.ndarray


def learn(docs: DataFrame, sample: int = SAMPLE, grams: int = GRAMS) -> Model:
    """The model of labelled rows (text, lang); rows with a null text or language teach nothing."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").collect()
    languages = [r["lang"] for r in sizes]
    if not languages:
        return Model([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32), np.zeros((len(_NAMES), 0), bool))
    if len(languages) > 500:
        raise ValueError("more than 500 languages")
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["n"])))])
    number = F.create_map(*[x for i, r in enumerate(sizes) for x in (F.lit(r["lang"]), F.lit(i))])
    chance = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000.0
    drawn = rows.where(chance < F.element_at(share, F.col("lang"))).select(F.element_at(number, F.col("lang")).alias("lang"), "text")

    def run(batches):
        words: dict[int, Counter[str]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, words.values())) > 300_000:
                yield from counted(words)
                words = {}
        yield from counted(words)

    def counted(words):
        for lang, tokens in words.items():
            letters = {t: letters_of(t) for t in tokens}
            kept = [t for t, w in letters.items() if w]
            if not kept:
                continue
            found, times = Grams([letters[t] for t in kept]), np.array([tokens[t] for t in kept], dtype=np.float64)
            scripts, n_letters = found.scripts()
            by_script = np.bincount(scripts, weights=times * n_letters, minlength=len(_NAMES))
            yield rows_of(lang, 0, np.arange(len(_NAMES), dtype=np.int64), by_script)
            for keys, owners in found.numbers():
                unique, place = np.unique(keys, return_inverse=True)
                yield rows_of(lang, 1, unique.view(np.int64), np.bincount(place, weights=times[owners]))

    def rows_of(lang, kind, keys, n):
        columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.full(len(keys), lang, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "lang", "key", "n"])

    counts = drawn.mapInArrow(run, "kind int, lang int, key long, n long")
    by_key = written(counts.groupBy("kind", "key").pivot("lang", list(range(len(languages)))).agg(F.sum("n")).na.fill(0), "language-counts")
    columns = [str(i) for i in range(len(languages))]
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    kept = written(by_key.where("kind = 1").orderBy(total.desc(), "key").limit(grams), "language-grams").toArrow().sort_by("key")
    scripts = by_key.where("kind = 0").toArrow().sort_by("key")
    table = np.stack([kept.column(c).to_numpy() for c in columns], axis=1).astype(np.float64)
    logs = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table) + 1))
    # The mean over languages is taken away: an n-gram that tells nothing counts nothing.
    logs = np.clip(logs - logs.mean(axis=1, keepdims=True), -6, 6)
    used = np.stack([scripts.column(c).to_numpy() for c in columns], axis=1).astype(np.float64)
    keys = kept.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    usual = np.zeros((len(_NAMES), len(languages)), dtype=bool)
    if len(used):
        usual[scripts.column("key").to_numpy()] = used >= 0.01 * np.maximum(used.sum(axis=0), 1)
    return Model(languages, keys[order], logs[order].astype(np.float32), usual)


class _Finder:
    """Places of numbers in a sorted array, by tables of one guess each; what shares a slot goes to the next table."""

    def __init__(self, keys: np.ndarray):
        self.tables = []
        left = np.arange(len(keys))
        bits = max(10, int(np.ceil(np.log2(max(len(keys), 1)))) + 3)
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5):
            slots = np.full(1 << bits, -1, dtype=np.int32)
            slot = (keys[left] * np.uint64(factor)) >> np.uint64(64 - bits)
            slots[slot] = left
            self.tables.append((np.uint64(factor), np.uint64(64 - bits), slots))
            left = left[slots[slot] != left]
        self.keys, self.left = keys, left

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that are missing."""
        out = np.full(len(wanted), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        open_ = np.arange(len(wanted))
        for factor, shift, slots in self.tables:
            guess = slots[(wanted[open_] * factor) >> shift]
            right = (guess >= 0) & (self.keys[guess] == wanted[open_])
            out[open_[right]] = guess[right]
            open_ = open_[~right & (guess >= 0)]
            if not len(open_):
                return out
        for place in self.left:
            out[open_[wanted[open_] == self.keys[place]]] = place
        return out


class Labeller:
    """A worker's word scores and the labelling of texts by them."""

    def __init__(self, model: Model):
        self.model = model
        self.finder = _Finder(model.grams)
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.used = 0
        self.scores = np.zeros((1024, len(self.model.languages)), dtype=np.float32)
        self.letters = np.zeros(1024, dtype=np.int32)

    def _learn(self, tokens: list[str]) -> None:
        """Scores of new tokens; a token without letters has the number -1, tokens of equal letters share a row."""
        words = list(map(letters_of, tokens))
        new = {w: i for i, w in enumerate(dict.fromkeys(w for w in words if w))}
        at, need = self.used, self.used + len(new)
        self.rows.update((t, at + new[w] if w else -1) for t, w in zip(tokens, words, strict=True))
        if not new:
            return
        if need > len(self.scores):
            grown = max(need, 2 * len(self.scores))
            self.scores = np.concatenate([self.scores, np.zeros((grown - len(self.scores), self.scores.shape[1]), dtype=np.float32)])
            self.letters = np.concatenate([self.letters, np.zeros(grown - len(self.letters), dtype=np.int32)])
        found = Grams(list(new))
        block = np.zeros((len(new), self.scores.shape[1]))
        for keys, owners in found.numbers():
            place = self.finder.find(keys)
            known = place >= 0
            place, owners = place[known], owners[known]
            for lang in range(block.shape[1]):
                block[:, lang] += np.bincount(owners, weights=self.model.scores[place, lang], minlength=len(new))
        block *= DAMPING
        block -= block.max(axis=1, keepdims=True)
        np.maximum(block, -BOUND, out=block)
        scripts, letters = found.scripts()
        usual = self.model.scripts[scripts]
        usual |= ~usual.any(axis=1, keepdims=True)
        block[~usual] = -1000.0
        self.scores[at:need] = block - block.max(axis=1, keepdims=True)
        self.letters[at:need] = letters
        self.used = need

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Score rows of the lettered tokens of texts, one text after the other, and their number in each text."""
        tokens = [t.split() if t else [] for t in texts]
        if len(self.rows) > CACHE_WORDS:
            self._forget()
        new = list(set(chain.from_iterable(tokens)).difference(self.rows))
        for i in range(0, len(new), 50_000):
            self._learn(new[i : i + 50_000])
        known = self.rows.__getitem__
        sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        flat = np.fromiter(map(known, chain.from_iterable(tokens)), dtype=np.int64, count=int(sizes.sum()))
        text = np.repeat(np.arange(len(tokens)), sizes)
        return flat[flat >= 0], np.bincount(text[flat >= 0], minlength=len(tokens))

    def labels(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The language number of each token of texts that lie one after the other."""
        return viterbi(self.scores, rows, sizes, SWITCH)


def viterbi(scores: np.ndarray, rows: np.ndarray, sizes: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each token: the sum of ``scores[row, label]`` less ``switch`` for each change within a text.

    All texts advance by one token together, longest first, so that the open ones are a prefix.
    """
    labels = np.empty(len(rows), dtype=np.int16)
    if not len(rows):
        return labels
    order = np.argsort(-sizes, kind="stable")
    size, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    open_ = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
    stay = np.empty((len(rows), scores.shape[1]), dtype=bool)
    best_before = np.empty(len(rows), dtype=np.int16)
    value = scores[rows[starts[: open_[0]]]].astype(np.float64)
    final = np.empty(int(open_[0]), dtype=np.int64)
    for t in range(1, len(open_)):
        k = open_[t]
        if k < len(value):
            final[k : len(value)] = value[k:].argmax(axis=1)
            value = value[:k]
        best = value.argmax(axis=1)
        top = value[np.arange(k), best] - switch
        at = starts[:k] + t
        keep = value >= top[:, None]
        stay[at], best_before[at] = keep, best
        value = np.where(keep, value, top[:, None]) + scores[rows[at]]
    final[: len(value)] = value.argmax(axis=1)
    label = np.zeros(len(final), dtype=np.int64)
    for t in range(len(open_) - 1, -1, -1):
        k = open_[t]
        following = open_[t + 1] if t + 1 < len(open_) else 0
        label[following:k] = final[following:k]
        at = starts[:k] + t
        labels[at] = label[:k]
        if t:
            label[:k] = np.where(stay[at, label[:k]], label[:k], best_before[at])
    return labels


def _labeller(shared) -> Labeller:
    return held("labeller", shared.value, lambda: Labeller(shared.value))


def _blocks(texts: list[str | None], languages: int):
    """Index ranges of texts that hold a bounded number of characters together, or one text."""
    most = _CELLS // max(languages, 1) * 5
    start = held = 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if texts:
        yield start, len(texts)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score (its share of the letters) and n_spans of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*keep, F.col(text).alias("_text"))
    names = [*keep, "lang_pred", "score", "n_spans"]

    def run(batches):
        for batch in batches:
            labeller, texts = _labeller(shared), batch.column(len(keep)).to_pylist()
            languages = np.array([*labeller.model.languages, "und"], dtype=object)
            found = [_predict_block(labeller, texts[a:b]) for a, b in _blocks(texts, len(languages))]
            best, score, spans = (np.concatenate(x) if x else np.zeros(0, int) for x in (zip(*found, strict=True) if found else ((), (), ())))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(languages[best.astype(int)].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.int32())],
                names=names,
            )

    schema = "".join(f"`{n}` {frame.schema[n].dataType.simpleString()}, " for n in keep)
    return frame.mapInArrow(run, f"{schema}lang_pred string, score double, n_spans int")


def _predict_block(labeller: Labeller, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, count = len(texts), len(labeller.model.languages)
    if not count:
        return np.zeros(n, dtype=np.int64), np.zeros(n), np.zeros(n, dtype=np.int32)
    rows, sizes = labeller.words(texts)
    labels = labeller.labels(rows, sizes)
    text = np.repeat(np.arange(n), sizes)
    letters = np.bincount(text * count + labels, weights=labeller.letters[rows], minlength=n * count).reshape(n, count)
    total = letters.sum(axis=1)
    best = np.where(total > 0, letters.argmax(axis=1), count)
    score = np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0)
    begins = np.ones(len(rows), dtype=bool)
    begins[1:] = (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])
    return best, score, np.bincount(text[begins], minlength=n).astype(np.int32)


def label_spans(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``: start and end (code points, end exclusive) and language of each stretch of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    frame = docs.select(*keep, F.col(text).alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def spans_of(labeller, value):
        if not value or not labeller.model.languages:
            return []
        rows, sizes = labeller.words([value])
        labels = iter(labeller.labels(rows, sizes).tolist())
        out: list[dict] = []
        for m in regex.finditer(r"\S+", value):
            if labeller.rows.get(m[0], -1) >= 0:
                lang = labeller.model.languages[next(labels)]
                if out and out[-1]["lang"] == lang:
                    out[-1]["end"] = m.end()
                else:
                    out.append({"start": m.start(), "end": m.end(), "lang": lang})
        return out

    def run(batches):
        for batch in batches:
            labeller = _labeller(shared)
            spans = pa.array([spans_of(labeller, t) for t in batch.column(len(keep)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], spans], names=[*keep, "spans"])

    schema = "".join(f"`{n}` {frame.schema[n].dataType.simpleString()}, " for n in keep)
    return frame.mapInArrow(run, f"{schema}spans array<struct<start: int, end: int, lang: string>>")


def fold(id_column: Column, folds: int = 4, out: int = 2) -> Column:
    """Whether crc32 of the id as text falls in the fold that is not learnt from."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == out


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score and n_spans of each row, learnt from the rows outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fold(F.col(id_col)).alias("held_out"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = learn(rows.where(~F.col("held_out")).select("text", "lang"))
    return predict(rows, model, keep=("doc_id", "held_out"))
