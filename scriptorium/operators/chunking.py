"""Cutting texts into chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import annotate as annotations
from scriptorium.functions.extract import chunk_language
from scriptorium.functions.split import recursive_split

# Default chunk size and overlap in characters.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200


def fixed_chunks(docs: DataFrame, key: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Sliding windows of ``size`` characters; numbered from 0 per document. No shuffle."""
    step = size - overlap
    last = F.floor((F.greatest(F.length("text") - overlap, F.lit(1)) - 1) / step).cast("int")
    return docs.withColumn("chunk_id", F.explode(F.sequence(F.lit(0), last))).select(
        key, "chunk_id", F.substring(F.col("text"), F.col("chunk_id") * step + 1, F.lit(size)).alias("text")
    )


def recursive_chunks(docs: DataFrame, key: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks cut at paragraph, line, sentence and word ends; numbered from 0 per document. No shuffle."""
    kept = [c for c in docs.columns if c != "text"]
    cut = docs.select(*kept, recursive_split(F.col("text"), size, overlap).alias("_chunks"))
    # The outer form keeps the planner from running the splitter twice to drop empty arrays early.
    chunks = cut.select(*kept, F.posexplode_outer("_chunks").alias("chunk_id", "text"))
    return chunks.filter("chunk_id IS NOT NULL")


def _annotations(words: Column) -> dict[str, Column]:
    return {
        "entities": annotations.entities(F.col("text")),
        "keywords": annotations.keywords(F.col("text"), words=words),
        "token_count": annotations.token_count(F.col("text"), words=words),
    }


def _improvements(words: Column | None = None) -> dict[str, Column]:
    return {
        "summary": annotations.summary(F.col("text")),
        "sentiment": annotations.sentiment(F.col("text"), words=words),
        "improved": F.lit(True),
    }


def _from_words(chunks: DataFrame, columns: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Cut every text into words once, for all columns that need them."""
    cut = chunks.withColumn("_words", annotations.lower_words(F.col("text")))
    return cut.withColumns(columns(F.col("_words"))).drop("_words")


def annotate(chunks: DataFrame) -> DataFrame:
    """Entities, keywords and token count beside each chunk."""
    return _from_words(chunks, _annotations)


def improve(chunks: DataFrame) -> DataFrame:
    """Summary, sentiment and the ``improved`` flag beside the annotations."""
    return chunks.withColumns(_improvements())


def annotate_and_improve(chunks: DataFrame) -> DataFrame:
    """``annotate`` and ``improve`` in one pass over the words."""
    return _from_words(chunks, lambda words: _annotations(words) | _improvements(words))


def chunk_documents(
    docs: DataFrame, key: str = "id", language: str = "language", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Whole documents to annotated chunks; the language is settled on the whole text before it is cut."""
    settled = docs.select(key, "text", chunk_language(F.col(language), F.col("text")).alias("language"))
    return annotate(recursive_chunks(settled, key, size, overlap))
