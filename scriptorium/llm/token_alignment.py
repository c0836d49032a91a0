"""Alignment of two tokenizers over the same bytes: overlap links, shared groups and how common each linked pair is.

A byte-level BPE (A) reads space + text, a piece BPE with byte fallback (B) reads the text and adds the space itself.
Tokens are rows of a sparse matrix with one column per byte, kept in compressed rows (`Csr`). The row-by-row product
A * transpose(B) (Gustavson, 1978) has an entry for each pair of tokens that share bytes, its value being their
number: the overlap links. Byte offsets where tokens of both end cut the tokens into groups; the product of the
matrices (token, group) of A and B has an entry for each pair in one group: the shared-group links. A long stretch
without a common end can have very many of these, so the operator takes their number from the sizes of the product's
rows and `shared_links` gives them in blocks.

A text is cut before each single space that follows neither white space nor U+2581. No token of either vocabulary can cross
such a place (B: no piece has a space after another sign, which is checked when it is loaded), so every segment is
encoded and multiplied once per task cache, and a text's tokens, groups and links are those of its segments in order.

How often an id pair is linked is counted over all texts. A chunk of documents (``CHUNK_BYTES`` of text, or one
longer document) reports each of its pairs once with a number, so no pair makes up more of the rows than there are
chunks; counts return to the chunks by an equality join on the pair, and a chunk's own segments turn them into sums per
document. What is sent to every task is the largest count of each id of B, as many rows as its vocabulary has.

Defined results: a null or empty text, or one whose joined bytes in A or B differ from space + text, has no tokens: all
numbers are zero and the digest is the empty string; equal rows give equal rows; a null id stays; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.tables import held, written

#: Text that is aligned together; a chunk reports each of its id pairs once.
CHUNK_BYTES = 8_000_000
#: Segments and tokens a task remembers; beyond them it starts anew, which costs time only.
CACHED_SEGMENTS = 150_000
CACHED_TOKENS = 1_500_000
#: Products of entries that a block of rows multiplies at a time.
BLOCK = 1 << 21
#: How A's byte-level entries split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=[^\s▁]) ")


class Csr(NamedTuple):
    """A sparse matrix by rows: row i has the columns ``cols[ptr[i]:ptr[i + 1]]`` with ``values`` at the same places."""

    ptr: np.ndarray
    cols: np.ndarray
    values: np.ndarray
    width: int


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens as rows and bytes as columns, for tokens of these lengths one after another."""
    ptr = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    total = int(ptr[-1])
    return Csr(ptr, np.arange(total), np.ones(total, dtype=np.int64), total)


def membership(group: np.ndarray, groups: int) -> Csr:
    """Tokens as rows and groups as columns: each token is in one group."""
    n = len(group)
    return Csr(np.arange(n + 1), group.astype(np.int64), np.ones(n, dtype=np.int64), groups)


def transposed(m: Csr) -> Csr:
    """Rows and columns exchanged, by a stable counting of the columns."""
    rows = np.repeat(np.arange(len(m.ptr) - 1), np.diff(m.ptr))
    order = np.argsort(m.cols, kind="stable")
    ptr = np.concatenate([[0], np.cumsum(np.bincount(m.cols, minlength=m.width))])
    return Csr(ptr, rows[order], m.values[order], len(m.ptr) - 1)


def row_work(x: Csr, y: Csr) -> np.ndarray:
    """How many products of entries each row of x * y takes; with one group per token, the row's number of entries."""
    ends = np.concatenate([[0], np.cumsum(np.diff(y.ptr)[x.cols])])
    return ends[x.ptr[1:]] - ends[x.ptr[:-1]]


def row_products(x: Csr, y: Csr, block: int = BLOCK) -> Iterator[tuple[int, Csr]]:
    """x * y in blocks of rows, each with the number of its first row.

    Row i is the sum of the rows of y that the entries of row i of x name, scaled by them: they are laid out one after another,
    and entries that meet in a column are added up. A block takes about ``block`` products, or is one row.
    """
    work = np.concatenate([[0], np.cumsum(row_work(x, y))])
    sizes = np.diff(y.ptr)
    first, n = 0, len(x.ptr) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(work, work[first] + block, "right")) - 1))
        entries = slice(x.ptr[first], x.ptr[last])
        through, taken = x.cols[entries], sizes[x.cols[entries]]
        rows = np.repeat(np.repeat(np.arange(last - first), np.diff(x.ptr[first : last + 1])), taken)
        starts = np.cumsum(taken) - taken
        places = np.arange(int(taken.sum())) - np.repeat(starts, taken) + np.repeat(y.ptr[through], taken)
        products = np.repeat(x.values[entries], taken) * y.values[places]
        keys = rows * y.width + y.cols[places]
        if len(keys) and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, products = keys[order], products[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        met = keys[heads]
        ptr = np.searchsorted(met // max(y.width, 1), np.arange(last - first + 1))
        yield first, Csr(ptr, met % max(y.width, 1), np.add.reduceat(products, heads) if len(heads) else products, y.width)
        first = last


def product(x: Csr, y: Csr, block: int = BLOCK) -> Csr:
    """The whole of x * y; see `row_products`."""
    parts = [part for _, part in row_products(x, y, block)]
    sizes = np.concatenate([np.zeros(0, dtype=np.int64), *(np.diff(p.ptr) for p in parts)])
    empty = np.zeros(0, dtype=np.int64)
    return Csr(
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        np.concatenate([empty, *(p.cols for p in parts)]),
        np.concatenate([empty, *(p.values for p in parts)]),
        y.width,
    )


def common_ends(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where tokens of both end, and the group of each token of A and of B."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    at = np.searchsorted(b_ends, a_ends)
    ends = a_ends[b_ends[at] == a_ends] if len(b_ends) else a_ends[:0]
    return ends, np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Csr:
    """Tokens of A as rows, tokens of B as columns, common bytes as values."""
    return product(incidence(a_lengths), transposed(incidence(b_lengths)))


def shared_links(a_lengths: np.ndarray, b_lengths: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, Csr]]:
    """Pairs of tokens of one group, in blocks of rows of A."""
    ends, a_group, b_group = common_ends(a_lengths, b_lengths)
    yield from row_products(membership(a_group, len(ends)), transposed(membership(b_group, len(ends))), block)


class Tokenizers:
    """Both tokenizers, the bytes of their entries, and the alignments of the segments met lately."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a_bytes = _byte_level(self.a.get_vocab(with_added_tokens=True))
        model = json.loads(self.a.to_str())["model"]
        ranks = dict(zip(_byte_level(model["vocab"]), range(len(model["vocab"])), strict=True))
        if not _merged_in_order(model, ranks):
            raise ValueError("A's entries must be numbered in the order of their merges")
        self.a_ranks = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("pieces with a space after another sign: texts cannot be cut at spaces")
        byte = [self.b.is_byte(i) for i in range(len(pieces))]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if byte[i] else piece.replace("▁", " ").encode() for i, piece in enumerate(pieces)
        ]
        self.a_sizes = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        self.b_space = self.b.piece_to_id("▁")
        a_text, b_text = ([str(i) for i in range(len(x))] for x in (self.a_bytes, self.b_bytes))
        # An id and the sign after it: within its side of a group, and at the side's end.
        self.signed = [x + "," for x in a_text] + [x + "|" for x in a_text] + [x + "," for x in b_text] + [x + ";" for x in b_text]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.numbers = np.zeros((0, 6), dtype=np.int64)
        self.link_ptr = np.zeros(1, dtype=np.int64)
        self.link_keys = np.zeros(0, dtype=np.int64)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each segment in A and B; none where the bytes of either differ from space + segment."""
        # Signs below U+0250 have been in their classes in every version of Unicode: the same merges, found faster by ranks.
        old = [i for i, s in enumerate(segments) if s.isascii() or max(s) < "\u0250"]
        new = sorted(set(range(len(segments))) - set(old)) if len(old) < len(segments) else []
        in_a: list[list[int]] = [[]] * len(segments)
        for i in old:
            in_a[i] = self.a_ranks.encode_ordinary(" " + segments[i])
        for i, e in zip(new, self.a.encode_batch_fast([" " + segments[i] for i in new], add_special_tokens=False), strict=True):
            in_a[i] = e.ids
        in_b = [ids if s else [self.b_space] for s, ids in zip(segments, self.b.encode(segments, num_threads=1), strict=True)]
        whole = [b" " + s.encode() for s in segments]
        sizes = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        for ids, table, lengths in ((in_a, self.a_bytes, self.a_sizes), (in_b, self.b_bytes, self.b_sizes)):
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = list(chain.from_iterable(ids))
            ends = np.concatenate([[0], np.cumsum(lengths[np.array(flat, dtype=np.int64)])])[np.cumsum(n)]
            # All sizes and all bytes in a row agree, or segments are looked at one by one.
            if np.array_equal(ends, np.cumsum(sizes)) and b"".join([table[k] for k in flat]) == b"".join(whole):
                continue
            for i, want in enumerate(whole):
                if b"".join([table[k] for k in ids[i]]) != want:
                    in_a[i] = in_b[i] = []
                    whole[i], sizes[i] = b"", 0
        return in_a, in_b

    def learn(self, segments: list[str]) -> None:
        """Align segments not known yet: one product over all of them, as the blocks of one diagonal."""
        for at in range(0, len(segments), 20_000):
            self._learn(segments[at : at + 20_000])

    def _learn(self, segments: list[str]) -> None:
        in_a, in_b = self.encode(segments)
        n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (in_a, in_b))
        a = np.fromiter(chain.from_iterable(in_a), dtype=np.int64, count=int(n_a.sum()))
        b = np.fromiter(chain.from_iterable(in_b), dtype=np.int64, count=int(n_b.sum()))
        links = overlap_links(self.a_sizes[a], self.b_sizes[b])
        keys = np.repeat(a, np.diff(links.ptr)) << 32 | b[links.cols]
        ends, a_group, b_group = common_ends(self.a_sizes[a], self.b_sizes[b])
        shared = row_work(membership(a_group, len(ends)), transposed(membership(b_group, len(ends))))
        a_last = np.cumsum(n_a)
        n_links = np.diff(np.concatenate([[0], links.ptr[a_last]]))
        n_shared = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(shared)])[a_last]]))
        # A segment's last token ends its last group.
        groups_to = np.where(a_last > 0, np.concatenate([[-1], a_group])[a_last] + 1, 0)
        n_groups = np.diff(np.concatenate([[0], groups_to]))
        self.texts += self._group_texts(a, b, a_group, b_group, n_a + n_b)
        self.numbers = np.concatenate([self.numbers, np.stack([n_a > 0, n_a, n_b, n_groups, n_links, n_shared], axis=1).astype(np.int64)])
        self.link_ptr = np.concatenate([self.link_ptr, self.link_ptr[-1] + np.cumsum(n_links)])
        self.link_keys = np.concatenate([self.link_keys, keys])
        for s in segments:
            self.known[s] = len(self.known)

    def _group_texts(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, sizes: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3;`` of each segment of ``sizes`` tokens."""
        n = len(self.a_bytes)
        groups = int(a_group[-1]) + 1 if len(a_group) else 0
        a_to, b_to = (np.searchsorted(g, np.arange(groups), "right") for g in (a_group, b_group))
        a_last, b_last = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        a_last[a_to - 1] = b_last[b_to - 1] = 1
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], b_to])[a_group]] = a + n * a_last
        order[np.arange(len(b)) + a_to[b_group]] = 2 * n + b + len(self.b_bytes) * b_last
        signed = self.signed
        texts = [signed[i] for i in order.tolist()]
        ends = np.cumsum(sizes).tolist()
        return ["".join(texts[i:j]) for i, j in zip([0, *ends], ends, strict=False)]


def _byte_level(vocabulary: dict[str, int]) -> list[bytes]:
    """Each entry's bytes; entries write bytes without a sign of their own as signs from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
    return out


def _merged_in_order(model: dict, ranks: dict[bytes, int]) -> bool:
    """Whether entries are numbered as their merges come, so that ranks and merges encode alike."""
    merged = [model["vocab"].get("".join(pair) if isinstance(pair, list) else pair.replace(" ", "")) for pair in model["merges"]]
    return None not in merged and merged == sorted(merged) and len(ranks) == len(model["vocab"])


_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


def _chunk(number: int, ids: pa.Array, texts: list[str | None], tools: Tokenizers) -> pa.RecordBatch:
    """One row per document with its numbers and segments; the first also has the chunk's pairs and what its segments link."""
    if len(tools.texts) > CACHED_SEGMENTS or len(tools.link_keys) > CACHED_TOKENS:
        tools.forget()
    cut = [_CUT.split(text) if text else [] for text in texts]
    known = tools.known
    tools.learn([s for s in dict.fromkeys(chain.from_iterable(cut)) if s not in known])
    sizes = np.array([len(x) for x in cut], dtype=np.int64)
    flat = np.fromiter((known[s] for s in chain.from_iterable(cut)), dtype=np.int64, count=int(sizes.sum()))
    owner = np.repeat(np.arange(len(cut)), sizes)
    # One bad segment, and the text has no tokens.
    bad = np.bincount(owner[tools.numbers[flat, 0] == 0], minlength=len(cut)) > 0
    digests = [
        "" if bad[i] or not segments else hashlib.sha256("".join([tools.texts[known[s]] for s in segments])[:-1].encode()).hexdigest()
        for i, segments in enumerate(cut)
    ]
    kept = ~bad[owner]
    flat, owner = flat[kept], owner[kept]
    sizes = np.where(bad, 0, sizes)
    sums = [np.bincount(owner, weights=tools.numbers[flat, k], minlength=len(cut)).astype(np.int64) for k in range(1, 6)]
    mine, local, times = np.unique(flat, return_inverse=True, return_counts=True)
    n_links = tools.link_ptr[mine + 1] - tools.link_ptr[mine]
    starts = np.cumsum(n_links) - n_links
    places = np.arange(int(n_links.sum())) - np.repeat(starts, n_links) + np.repeat(tools.link_ptr[mine], n_links)
    keys, pair = np.unique(tools.link_keys[places], return_inverse=True)
    pair_n = np.bincount(pair, weights=np.repeat(times, n_links), minlength=len(keys)).astype(np.int64)
    only_first = lambda values, kind: pa.ListArray.from_arrays(
        pa.array([0] + [len(values)] * len(cut), pa.int32()), pa.array(values, kind)
    )
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number] * len(cut), pa.int64()), ids, *[pa.array(x) for x in sums], pa.array(digests, pa.string()),
            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(local.reshape(-1), pa.int32())),
            only_first(np.concatenate([[0], np.cumsum(n_links)]), pa.int32()), only_first(pair.reshape(-1), pa.int32()),
            only_first(keys, pa.int64()), only_first(pair_n, pa.int64()),
        ],
        names=["chunk", "doc_id", *_COUNTS, "groups_sha256", "segments", "link_ends", "link_pairs", "pairs", "pair_n"],
    )


def encoded(docs: DataFrame, path_a: str, path_b: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents in chunks; see `_chunk`."""
    frame = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("_text"))

    def run(batches):
        tools = held("alignment", sys.intern(f"{path_a}\n{path_b}"), lambda: Tokenizers(path_a, path_b))
        number, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            column = batch.column("_text")
            for i in range(batch.num_rows):
                value = column[i].as_py()
                if texts and size + len(value or "") > CHUNK_BYTES:
                    yield _chunk(number, _joined(ids), texts, tools)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(batch.column("doc_id").slice(i, 1))
                texts.append(value)
                size += len(value or "")
        if texts:
            yield _chunk(number, _joined(ids), texts, tools)

    def _joined(parts):
        return pa.concat_arrays(parts)

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    lists = "segments array<int>, link_ends array<int>, link_pairs array<int>, pairs array<long>, pair_n array<long>"
    return frame.mapInArrow(run, f"chunk long, doc_id {frame.schema['doc_id'].dataType.simpleString()}, {counts}, groups_sha256 string, {lists}")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, count and whether it is the largest of the pair's id of B, of each linked id pair (a << 32 | b)."""
    each = chunks.where(F.size("pairs") > 0).select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("p"))
    counts = written(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_n").alias("count")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    # One row per id of B: bounded by its vocabulary.
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, n_best and count_sum of each row."""
    chunks = written(encoded(docs, path_a, path_b, text, id_col), "aligned-chunks")
    asked = chunks.where(F.size("pairs") > 0).select("chunk", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(pair_counts(chunks), "pair").select(F.col("chunk").alias("of_chunk"), "at", "count", "best")

    def sums(rows: pa.Table, counted: pa.Table) -> pa.Table:
        flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        link_ends, link_pairs, segments = flat("link_ends"), flat("link_pairs"), flat("segments")
        at = counted.column("at").to_numpy()
        sizes = rows.column("segments").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(rows.num_rows), sizes)
        out = []
        for name in ("best", "count"):
            per_pair = np.zeros(len(at), dtype=np.int64)
            per_pair[at] = counted.column(name).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(per_pair[link_pairs])])
            per_segment = np.diff(ends[link_ends]) if len(link_ends) else np.zeros(0, dtype=np.int64)
            total = np.zeros(rows.num_rows, dtype=np.int64)
            np.add.at(total, owner, per_segment[segments])
            out.append(pa.array(total))
        keep = ["doc_id", *_COUNTS, "groups_sha256"]
        return pa.table([*(rows.column(c) for c in keep), *out], names=[*keep, "n_best", "count_sum"])

    own = chunks.select("chunk", "doc_id", *_COUNTS, "groups_sha256", "segments", "link_ends", "link_pairs")
    schema = f"doc_id {chunks.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string, n_best long, count_sum long"
    return own.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(sums, schema)
