"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside Spark partitions.

A task splits its texts into matches of the tokenizer's pattern. Matches it has not met before go through
one recursive DuckDB query: rows (word, position, token) meet the merge table, each word contracts its
leftmost pair of least rank, and words without a pair left drop out of the recursion. Decoding is an
ordered aggregation over (document, position, token). Nothing is shuffled: Spark deals out the documents.

Defined results: null text is the empty text (no tokens); a null id stays null; equal rows give equal
rows; extra columns are ignored. Memory of a task is bounded: texts come in Arrow batches, the word cache
is dropped beyond ``CACHE_WORDS`` entries, decoding takes ``DECODE_ROWS`` tokens at a time, and the recursion
over a long word is cut every 16 rounds.
"""

from __future__ import annotations

import base64
import hashlib
import sys

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from scriptorium.llm.tables import held, text_slices

CACHE_WORDS = 550_000
ENCODE_BYTES = 150_000
DECODE_ROWS = 300_000
#: Texts taken from an Arrow batch at a time.
TEXT_BYTES = 3_000_000
#: Words beyond this many bytes are contracted by rounds of equal rank instead of one pair at a time.
LONG_WORD = 64

# A row knows the token and the place to its right, so a round needs no sorting: the pair of least rank of each
# word, at its leftmost place, becomes one token; its right neighbour's row goes and the row before it learns the
# new token. A word without a pair has no partner in the join and leaves the recursion with the round before as its result.
_ENCODE = """
WITH RECURSIVE steps AS (
    SELECT word, 0 AS round, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos
    FROM pieces WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    SELECT p.word, p.round + 1, p.pos,
           CASE WHEN p.pos = b.pos THEN b.rank ELSE p.id END,
           CASE WHEN p.pos = b.pos THEN b.after_id WHEN p.next_pos = b.pos THEN b.rank ELSE p.next_id END,
           CASE WHEN p.pos = b.pos THEN b.after_pos ELSE p.next_pos END
    FROM steps p JOIN (
        SELECT f.word, f.least // 256 AS rank, f.least % 256 AS pos, c.next_pos AS gone, n.next_id AS after_id, n.next_pos AS after_pos
        FROM (
            SELECT s.word, min(m.rank * 256 + s.pos) AS least
            FROM steps s JOIN merges m ON m.pair = s.id::BIGINT * 65536 + s.next_id GROUP BY s.word
        ) f
        JOIN steps c ON c.word = f.word AND c.pos = f.least % 256
        JOIN steps n ON n.word = f.word AND n.pos = c.next_pos
    ) b ON b.word = p.word
    WHERE p.pos <> b.gone
)
SELECT s.word, s.id FROM steps s JOIN (SELECT word, max(round) AS round FROM steps GROUP BY word) USING (word, round)
ORDER BY s.word, s.pos
"""

_DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS text
FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc
"""

# The same for long words, a bounded number of rounds at a time: a round contracts every occurrence of the
# least pair, every second one within a run of equal tokens. That equals one-at-a-time order as long as the new
# token starts no pair of lesser rank (``settled``); otherwise only the leftmost occurrence is taken.
_ENCODE_LONG = """
WITH RECURSIVE steps AS (
    SELECT word, 0 AS round, pos, id FROM pieces
    UNION ALL
    SELECT word, round + 1, pos, CASE WHEN taken THEN rank ELSE id END
    FROM (
        SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY pos) AS swallowed
        FROM (
            SELECT *, rank IS NOT NULL AND rank = least_rank
                      AND CASE WHEN settled THEN row_number() OVER (PARTITION BY word, island, rank = least_rank ORDER BY pos) % 2 = 1
                               ELSE pos = min(CASE WHEN rank = least_rank THEN pos END) OVER (PARTITION BY word) END AS taken
            FROM (
                SELECT *, place - row_number() OVER (PARTITION BY word, rank = least_rank ORDER BY pos) AS island
                FROM (
                    SELECT s.*, m.rank, m.settled, min(m.rank) OVER (PARTITION BY word) AS least_rank
                    FROM (
                        SELECT word, round, pos, id, lead(id) OVER w AS next_id, row_number() OVER w AS place
                        FROM steps WINDOW w AS (PARTITION BY word ORDER BY pos)
                    ) s LEFT JOIN merges m ON m.pair = s.id::BIGINT * 65536 + s.next_id
                )
            )
        )
    )
    WHERE least_rank IS NOT NULL AND NOT swallowed AND round < 16
)
SELECT word, pos, id, max(round) OVER () AS rounds FROM steps
QUALIFY round = max(round) OVER (PARTITION BY word)
ORDER BY word, pos
"""


class Tokenizer:
    """One worker's DuckDB connection with the merge table, and the words it has met."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        if max(self.ranks.values()) >= 65536:
            raise ValueError("pairs are packed with 16 bits a token")
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})
        self._load_tables()
        self.words: dict[str, bytes] = {}

    def _load_tables(self) -> None:
        left, right, rank = [], [], []
        for token, number in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(number)
        a, b, r = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(rank, dtype=np.int32)
        early = np.unique(np.concatenate([a[r < a], b[r < b]]))
        self._store("merges", pa.table({"pair": a * 65536 + b, "rank": r, "settled": ~np.isin(r, early)}))
        # A byte is written as the character 256 places up, so that any bytes make valid text.
        pieces = ["".join(chr(256 + byte) for byte in token) for token in self.ranks]
        ids = pa.array(list(self.ranks.values()), pa.int32())
        self._store("vocabulary", pa.table({"id": ids, "piece": pieces}))

    def _store(self, name: str, table: pa.Table) -> None:
        self.con.register("incoming", table)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def _query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.con.register(name, table)
        try:
            return self.con.sql(sql).to_arrow_table()
        finally:
            self.con.unregister(name)

    def _pieces(self, words: list[bytes]) -> pa.Table:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        return pa.table({"word": word, "pos": (np.arange(len(text)) - starts).astype(np.int32), "id": self.byte_ids[text]})

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Little-endian ids of each word, all of a moderate length."""
        out = self._query(_ENCODE, "pieces", self._pieces(words))
        return self._by_word(out, len(words))

    def _contract_long(self, word: bytes) -> bytes:
        pieces = self._pieces([word])
        while True:
            out = self._query(_ENCODE_LONG, "pieces", pieces)
            if out.column("rounds")[0].as_py() < 16:
                return self._by_word(out, 1)[0]
            pieces = out.select(["word", "pos", "id"])

    @staticmethod
    def _by_word(out: pa.Table, n_words: int) -> list[bytes]:
        ids = out.column("id").to_numpy().astype("<u4").tobytes()
        ends = np.searchsorted(out.column("word").to_numpy(), np.arange(n_words), side="right") * 4
        starts = np.concatenate([[0], ends[:-1]])
        return [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _learn(self, unknown: set[str]) -> None:
        if len(self.words) + len(unknown) > CACHE_WORDS:
            self.words.clear()
        block: list[str] = []
        size = 0
        for word in unknown:
            raw = word.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.words[word] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_WORD:
                self.words[word] = self._contract_long(raw)
            else:
                block.append(word)
                size += len(raw)
                if size >= ENCODE_BYTES:
                    self._learn_block(block)
                    block, size = [], 0
        if block:
            self._learn_block(block)

    def _learn_block(self, block: list[str]) -> None:
        self.words.update(zip(block, self._contract([w.encode("utf-8") for w in block]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        matches = [self.split(text) if text else [] for text in texts]
        unknown = set().union(*matches) - self.words.keys() if matches else set()
        if len(self.words) + len(unknown) > CACHE_WORDS:
            unknown = set().union(*matches)
        if unknown:
            self._learn(unknown)
        known = self.words.__getitem__
        return [b"".join(map(known, found)) for found in matches]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        sizes = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
        flat = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        parts: list[list[bytes]] = [[] for _ in ids]
        for start in range(0, len(flat), DECODE_ROWS):
            stop = min(start + DECODE_ROWS, len(flat))
            rows = pa.table({"doc": doc[start:stop], "pos": np.arange(stop - start, dtype=np.int32), "id": flat[start:stop]})
            out = self._query(_DECODE, "tokens", rows)
            for d, text in zip(out.column("doc").to_pylist(), out.column("text").to_pylist(), strict=True):
                parts[d].append(text.encode("utf-16-le")[::2])
        return [b"".join(p) for p in parts]


def _tokenizer(vocabulary: bytes, pattern: str) -> Tokenizer:
    """The worker's tokenizer for this vocabulary."""
    key = sys.intern(hashlib.sha256(vocabulary + pattern.encode()).hexdigest())
    return held("tokenizer", key, lambda: Tokenizer(vocabulary, pattern))


def _vocabulary(spark, path: str):
    """The rank file's bytes as a broadcast: their size is the vocabulary's, whatever the input."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _id_lists(ids: list[bytes]) -> pa.Array:
    flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the token ids of each text (``ids`` array<int>), one row for each row."""
    shared = _vocabulary(docs.sparkSession, vocabulary_path)
    frame = docs.select(*keep, docs[text].alias("_text"))

    def run(batches):
        tokenizer = _tokenizer(shared.value, pattern)
        for batch in text_slices(batches, "_text", TEXT_BYTES):
            ids = tokenizer.encode(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), _id_lists(ids)], names=[*keep, "ids"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{schema}, ids array<int>" if keep else "ids array<int>")


def decode(tokens: DataFrame, vocabulary_path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the decoded bytes of each id list (``decoded`` binary); a null list is the empty one."""
    shared = _vocabulary(tokens.sparkSession, vocabulary_path)
    frame = tokens.select(*keep, tokens[ids].alias("_ids"))

    def run(batches):
        tokenizer = _tokenizer(shared.value, pattern)
        for batch in batches:
            packed = [np.array(x or [], dtype="<u4").tobytes() for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(tokenizer.decode(packed), pa.binary())], names=[*keep, "decoded"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{schema}, decoded binary" if keep else "decoded binary")


def round_trip(
    docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", id_col: str = "doc_id", with_ids: bool = False
) -> DataFrame:
    """``id_col``, n_tokens, and the digests of the ids and of the bytes decoded from them, in one pass over the texts.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded bytes;
    ``with_ids`` adds the ids themselves (array<int>).
    """
    shared = _vocabulary(docs.sparkSession, vocabulary_path)
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("_text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches):
        tokenizer = _tokenizer(shared.value, pattern)
        for batch in text_slices(batches, "_text", TEXT_BYTES):
            ids = tokenizer.encode(batch.column("_text").to_pylist())
            decoded = tokenizer.decode(ids)
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            yield pa.RecordBatch.from_arrays([*columns, *[_id_lists(ids)] * with_ids], names=names)

    kind = frame.schema["doc_id"].dataType.simpleString()
    return frame.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
