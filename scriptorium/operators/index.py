"""A written search index over chunks: which chunks hold which words, and the chunks' texts in key order.

Three tables below one folder, each read in part only:

* ``postings``: one row per chunk and different spelling of a word, lower-cased, in folders by a hash of the word. Each task
  that reads texts sorts and writes its own, so postings are cut out of the texts once and not shuffled. The postings of a
  word are read from its folder, and there from the row groups around it in each file. A word that every chunk holds is
  spread over all files.
* ``grams``: the words under the three characters (fewer at the word's end) from each of their places on, each file sorted by
  these. A query term can only occur in words that are listed under its first three characters, or, if it is shorter,
  under characters that begin with it.
* ``texts``: the chunks sorted by key, so that the texts of the winners are read from the row groups that hold them.

A term has no blanks, so a chunk contains it exactly when one of the chunk's words does.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import BLANK_RUN
from scriptorium.session import spread, work_folder

#: Characters of a term under which its words are listed.
ANCHOR = 3
#: Words that a read of the postings names one by one; terms that more words hold read all postings, but no text.
NAMED_WORDS = 2_000
#: Chunks for each folder of postings, about a hundred words each; a folder holds a file of each task that wrote postings.
CHUNKS_A_FOLDER = 1_000_000
#: Bytes of a row group: small ones let a read skip more.
ROW_GROUP = 4 * 1024 * 1024
_BITS = 62


class SearchIndex(NamedTuple):
    spark: SparkSession
    folder: str
    key: str
    buckets: int
    #: The types of key and chunk_id, as DDL.
    places: str

    def table(self, name: str) -> DataFrame:
        columns = {"postings": f"{self.places}, word string, bucket int", "texts": f"{self.places}, text string", "grams": "gram string, word string"}
        return self.spark.read.schema(columns[name]).parquet(f"{self.folder}/{name}")


def _bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def grams(word: Column) -> Column:
    """The different stretches of three characters of a word, and the shorter ones at its end."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.array_distinct(F.transform(places, lambda at: F.substring(word, at, F.lit(ANCHOR))))


def chunk_words(chunks: DataFrame, key: str) -> DataFrame:
    """``(key, chunk_id, word)``: the words of each chunk, lower-cased; a word spelled in two ways comes twice.

    Words are lower-cased one by one, after equal ones are dropped: whole texts take the slow way if one letter is not ASCII.
    """
    spelled = F.array_distinct(F.split("text", BLANK_RUN))
    return chunks.select(key, "chunk_id", F.explode(spelled).alias("word")).where("word <> ''").withColumn("word", F.lower("word"))


def _write(df: DataFrame, path: str, mode: str, by: str | None = None) -> None:
    out = df.write.mode(mode).option("parquet.block.size", ROW_GROUP)
    (out.partitionBy(by) if by else out).parquet(path)


def _write_texts(index: SearchIndex, chunks: DataFrame, name: str) -> DataFrame:
    key, path = index.key, f"{index.folder}/{name}"
    sorted_texts = chunks.select(key, "chunk_id", "text").repartitionByRange(key, "chunk_id").sortWithinPartitions(key, "chunk_id")
    _write(sorted_texts, path, "overwrite")
    return index.spark.read.schema(f"{index.places}, text string").parquet(path)


def _write_postings(index: SearchIndex, written: DataFrame, mode: str) -> None:
    each = chunk_words(spread(written), index.key).withColumn("bucket", _bucket(F.col("word"), index.buckets))
    _write(each.sortWithinPartitions("bucket", "word"), f"{index.folder}/postings", mode, "bucket")


def _write_grams(index: SearchIndex, vocabulary: DataFrame, mode: str) -> None:
    listed = vocabulary.select(F.explode(grams(F.col("word"))).alias("gram"), "word")
    _write(listed.sortWithinPartitions("gram", "word"), f"{index.folder}/grams", mode)


def build(chunks: DataFrame, key: str = "doc_id", folder: str | None = None, buckets: int | None = None) -> SearchIndex:
    """Write the index of ``chunks`` (key, chunk_id, text). The number of postings folders follows the number of chunks."""
    spark = chunks.sparkSession
    folder = folder or work_folder(spark, "search-index")
    places = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in (key, "chunk_id"))
    index = SearchIndex(spark, folder, key, buckets or 1, places)
    written = _write_texts(index, chunks, "texts")
    if not buckets:
        index = index._replace(buckets=max(1, math.ceil(written.count() / CHUNKS_A_FOLDER)))
    _write_postings(index, written, "overwrite")
    _write_grams(index, index.table("postings").select("word").distinct(), "overwrite")
    return index


def extend(index: SearchIndex, chunks: DataFrame) -> SearchIndex:
    """The index with the chunks of further documents: new files beside the old ones, nothing is rewritten.

    Chunks of removed documents may stay: a search joins its hits with the library.
    """
    # Each word stands once under the characters it begins with; found again at another place, they are the same row.
    old_words = index.table("grams").where(F.col("gram") == F.substring("word", 1, ANCHOR)).select("word")
    new = _write_texts(index, chunks, "texts-new")
    _write_postings(index, new, "append")
    vocabulary = chunk_words(new, index.key).select("word").distinct().join(old_words, "word", "left_anti")
    _write_grams(index, vocabulary, "append")
    _write(new.sortWithinPartitions(index.key, "chunk_id"), f"{index.folder}/texts", "append")
    return index


def holding_words(index: SearchIndex, terms: list[str]) -> list[str] | None:
    """The words that hold one of ``terms``, read from the stretches the terms begin with; None if there are too many to name."""
    gram, either = F.col("gram"), lambda tests: reduce(lambda a, b: a | b, tests)
    full = sorted({term[:ANCHOR] for term in terms if len(term) >= ANCHOR})
    short = sorted({term for term in terms if len(term) < ANCHOR})
    listed = either([*([gram.isin(full)] if full else []), *[gram.startswith(term) for term in short]])
    holds = either([F.contains("word", F.lit(term)) & gram.startswith(term[:ANCHOR]) for term in terms])
    found = index.table("grams").where(listed).where(holds).select("word").distinct()
    named = [r.word for r in found.limit(NAMED_WORDS + 1).collect()]
    return named if len(named) <= NAMED_WORDS else None


def scores(index: SearchIndex, query: str) -> DataFrame:
    """``(key, chunk_id, relevance)`` of the chunks that hold a word of the query: the share of its words they hold, as substrings.

    Each posting says by bits which terms its word holds; a chunk's bits are or-ed with partial aggregation.
    """
    terms = Counter(query.lower().split())
    postings = index.table("postings")
    if not terms:
        return postings.where("false").select(index.key, "chunk_id", F.lit(0.0).alias("relevance"))
    named = holding_words(index, list(terms))
    if named is not None:
        homes = index.spark.createDataFrame([(w,) for w in named], "word string").select(_bucket(F.col("word"), index.buckets)).distinct().collect()
        postings = postings.where(F.col("bucket").isin([r[0] for r in homes])).where(F.col("word").isin(named))
    parts = [list(terms)[i : i + _BITS] for i in range(0, len(terms), _BITS)]
    held = []
    for part in parts:
        bits = F.lit(0).cast("long")
        for i, term in enumerate(part):
            bits = bits + F.when(F.contains("word", F.lit(term)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
        held.append(bits)
    masks = postings.select(index.key, "chunk_id", *[bits.alias(f"held_{i}") for i, bits in enumerate(held)])
    masks = masks.where(" OR ".join(f"held_{i} <> 0" for i in range(len(parts))))
    masks = masks.groupBy(index.key, "chunk_id").agg(*[F.bit_or(f"held_{i}").alias(f"held_{i}") for i in range(len(parts))])
    found = F.lit(0)
    for i, part in enumerate(parts):
        for bit, term in enumerate(part):
            found = found + F.when(F.col(f"held_{i}").bitwiseAND(F.lit(1 << bit).cast("long")) != 0, terms[term]).otherwise(0)
    return masks.select(index.key, "chunk_id", (found.cast("double") / float(sum(terms.values()))).alias("relevance"))


def texts_of(index: SearchIndex, keys: list) -> DataFrame:
    """``(key, chunk_id, text)`` of the documents with these keys; other row groups are skipped."""
    return index.table("texts").where(F.col(index.key).isin(keys))
