"""Library statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import extension, human_size
from scriptorium.schema import present


def chunk_counts(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks_count"))


def library_totals(library: DataFrame, counts: DataFrame, key: str = "doc_id") -> DataFrame:
    return library.join(counts, key, "left").agg(
        F.count("*").alias("total_documents"),
        F.coalesce(F.sum("page_count"), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum("chunks_count"), F.lit(0)).alias("total_chunks"),
    )


def file_types(library: DataFrame) -> DataFrame:
    return library.groupBy(extension(F.col("filename")).alias("file_type")).agg(F.count("*").alias("documents"))


def years(library: DataFrame) -> DataFrame:
    return (
        library.filter(present("year"))
        .groupBy(F.col("year").cast("string").alias("year"))
        .agg(F.count("*").alias("documents"))
    )


def languages(library: DataFrame) -> DataFrame:
    return library.filter(present("language")).groupBy("language").agg(F.count("*").alias("documents"))


def histograms(library: DataFrame) -> DataFrame:
    """File type, year and language histograms in one pass: ``(facet, value, documents)``."""
    facets = library.select(
        extension(F.col("filename")).alias("file_type"),
        F.when(present("year"), F.col("year").cast("string")).alias("year"),
        F.when(present("language"), F.col("language")).alias("language"),
    )
    sets = [[F.col("file_type")], [F.col("year")], [F.col("language")]]
    counted = facets.groupingSets(sets, "file_type", "year", "language").agg(
        F.grouping_id().alias("g"), F.count("*").alias("documents")
    )
    # grouping_id has one bit per column, set where the column is not grouped.
    facet = F.when(F.col("g") == 3, "file_type").when(F.col("g") == 5, "year").otherwise("language")
    value = F.coalesce("file_type", "year", "language")
    return counted.select(facet.alias("facet"), value.alias("value"), "documents").filter(F.col("value").isNotNull())


def histogram_maps(library: DataFrame) -> DataFrame:
    """The histograms as one map per facet; their size is the number of distinct values."""
    entries = F.map_from_entries(F.collect_list(F.struct("value", "documents")))
    return histograms(library).groupBy("facet").agg(entries.alias("counts"))


def storage_used(files: DataFrame, size: str = "length") -> DataFrame:
    total = F.coalesce(F.sum(size), F.lit(0).cast("bigint"))
    return files.agg(total.alias("total_bytes")).withColumn("storage_used", human_size(F.col("total_bytes")))
