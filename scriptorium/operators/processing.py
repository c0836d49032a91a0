"""From read documents to library, full texts and chunks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.extract import fill_missing
from scriptorium.operators.chunking import chunk_documents
from scriptorium.operators.enrich import enrich, per_source
from scriptorium.operators.mutate import patch, select_for_reprocessing
from scriptorium.operators.resolve import resolve
from scriptorium.operators.stats import chunk_counts
from scriptorium.schema import FIELD_TYPES
from scriptorium.session import cut_lineage


class Results(NamedTuple):
    fulltext: DataFrame
    library: DataFrame
    chunks: DataFrame


def process(
    documents: DataFrame,
    catalogue: DataFrame | None = None,
    override: DataFrame | None = None,
    language: str = "auto",
) -> Results:
    """Fill metadata from the text, put reviewed values over it, enrich from the catalogue, cut into chunks.

    ``documents`` has ``id, filename, text`` and whatever metadata the reader found. After extraction the
    text takes no part in any join: metadata travels by id alone.
    """
    needed = ["title", "author", "language", "page_count", "doi", "isbn"]
    missing = {n: F.lit(None).cast(FIELD_TYPES[n]) for n in needed if n not in documents.columns}
    complete = documents.withColumns(missing) if missing else documents
    library = fill_missing(complete, language=language).drop("text")
    if override is not None:
        library = patch(library, override)
    if catalogue is not None:
        # Written once: resolving reads the metadata several times, the texts must be read only once.
        library = cut_lineage(library, "library")
        library = enrich(library, per_source(library, resolve(library, catalogue, "id"), "id"), "id")
    # The language is settled from the text, so chunking does not wait for the enrichment.
    # Written once: they are returned and counted.
    chunks = chunk_documents(complete.select("id", "text", F.coalesce("language", F.lit(language)).alias("language")))
    chunks = cut_lineage(chunks, "chunks")
    counted = library.join(chunk_counts(chunks, "id"), "id", "left")
    library = counted.withColumn("chunks_count", F.coalesce("chunks_count", F.lit(0).cast("bigint")))
    return Results(complete.select("id", "text"), library, chunks)


def reprocess(documents: DataFrame, ids: DataFrame, **options) -> Results:
    """The same for the listed documents only; upsert the results to replace the stored rows."""
    return process(select_for_reprocessing(documents, ids), **options)
