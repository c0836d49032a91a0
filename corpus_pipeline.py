"""From documents to tokens: toxic texts out, repeated lines out, near-duplicates out, sources mixed, texts encoded.

Each stage takes (spark, docs, sf_dir), reads all that its predecessor kept and returns a table; `run` writes it
and reads it again for the next. The stages before the last return the columns of documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, line_dedup, mixing, near_text, toxicity
from scriptorium.llm.tables import written
from scriptorium.session import FOLDERS, remove_folders

_left: list[str] = []


def _stage(function):
    """A stage that first removes what the stage before it left in the shared folder.

    The result of the stage before has been written and read again by then; tables that ``docs`` still reads stay.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _left:
            read = docs.inputFiles()
            remove_folders(spark, [f for f in _left if not any(f.rpartition("/")[2] in file for file in read)])
        made = len(FOLDERS)
        result = function(spark, docs, sf_dir)
        _left[:] = FOLDERS[made:]
        return result

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that the classifier predicts toxic; it learns from the labelled rows outside its held-out fold."""
    return toxicity.remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, without the lines that repeat or nearly repeat an earlier one; n_chars follows the text."""
    return line_dedup.dedup(docs).select(*docs.columns).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: fingerprints of five-word shingles within three bits of each other, or sets of
    these shingles with a Jaccard similarity of 0.8 or more."""
    return near_text.keep_first_similar(docs, shingle=5, similarity=0.8, distance=3)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.emitted(docs)


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded bytes, and the ids of each row."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("tokenize", tokenize),
]

#: A trained classifier and connected components are not SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
