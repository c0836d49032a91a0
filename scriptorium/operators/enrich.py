"""Merging found catalogue records into a document's metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.scoring import metadata_score, source_position
from scriptorium.schema import FIELD_TYPES, RECORD_FIELDS, present, value_or

# Thresholds, and the fields taken from a weak match per service.
FULL_MERGE = 70.0
FIELD_MERGE = 30.0
WEAK_FIELDS = {
    "crossref": ["journal", "publisher", "doi", "issn", "year"],
    "openalex": ["journal", "publisher", "doi", "year", "keywords"],
    "googlebooks": ["publisher", "isbn", "year", "page_count", "keywords"],
    "openlib": ["publisher", "isbn", "year", "page_count", "keywords", "language"],
    "k10plus": ["publisher", "isbn", "year", "page_count", "language"],
}
COMBINED_FIELDS = [
    "title", "author", "year", "publisher", "journal", "doi", "isbn", "page_count", "language", "keywords", "abstract",
]


def with_record_fields(library: DataFrame) -> DataFrame:
    """Library rows with every catalogue field, null where the library has none."""
    missing = {n: F.lit(None).cast(FIELD_TYPES[n]) for n in RECORD_FIELDS if n not in library.columns}
    return library.withColumns(missing) if missing else library


def _takes_weakly(source: Column, name: str) -> Column:
    return source.isin([s for s, names in WEAK_FIELDS.items() if name in names])


def per_source(library: DataFrame, matches: DataFrame, key: str = "doc_id", similarity: str = "levenshtein") -> DataFrame:
    """Each match merged into its document: ``(key, source, record_score, score, merged)``.

    A record scored above 70 gives all its filled fields, a weaker one those its service is trusted for.
    ``score`` rates the merged metadata. Every source sees the document's own values.
    """
    base = with_record_fields(library).select(key, F.struct(*RECORD_FIELDS).alias("base"))
    paired = matches.select(key, "source", "record").join(base, key)
    source = F.col("source")

    def at(struct: str):
        return lambda name: F.col(f"{struct}.{name}")

    own_title, own_author = F.col("base.title"), F.col("base.author")
    scored = paired.withColumn("record_score", metadata_score(source, at("record"), own_title, own_author, similarity))
    merged = [
        F.when(
            present(n, F.col(f"record.{n}"))
            & ((F.col("record_score") > FULL_MERGE) | _takes_weakly(source, n)),
            F.col(f"record.{n}"),
        )
        .otherwise(F.col(f"base.{n}"))
        .alias(n)
        for n in RECORD_FIELDS
    ]
    return (
        scored.withColumn("merged", F.struct(*merged))
        .withColumn("score", metadata_score(source, at("merged"), own_title, own_author, similarity))
        .select(key, "source", "record_score", "score", "merged")
    )


def _rank() -> Column:
    return F.struct(F.col("score").alias("score"), (-source_position(F.col("source"))).alias("place"))


def _best_source_column() -> Column:
    return F.max_by(F.struct("source", "score", "merged"), _rank()).alias("best")


def _best_field_columns() -> list[Column]:
    columns = []
    for name in COMBINED_FIELDS:
        value = F.col(f"merged.{name}")
        ranked = F.struct(
            F.col("score").alias("score"), (-source_position(F.col("source"))).alias("place"), value.alias("value")
        )
        columns.append(F.max(F.when(present(name, value), ranked)).alias(f"field_{name}"))
    return columns


def best_source(merged: DataFrame, key: str = "doc_id") -> DataFrame:
    """The best-scored source per document, ties by service order. Aggregated map-side, no window."""
    return merged.groupBy(key).agg(_best_source_column()).select(key, "best.*")


def best_fields(merged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document and field the value of the best-scored source that has one, as ``field_<name>`` structs."""
    return merged.groupBy(key).agg(*_best_field_columns())


def enrich(library: DataFrame, merged: DataFrame, key: str = "doc_id") -> DataFrame:
    """Library rows with the best source's values, or the best value per field when no source is good enough.

    One aggregation per document finds both. A result is taken only if it fills more fields than the
    document had, and documents without title and author stay as they are. ``enriched_by`` names the
    source, ``combined``, or is null.
    """
    docs = with_record_fields(library)
    found = merged.groupBy(key).agg(_best_source_column(), *_best_field_columns())
    winner = F.col("best.score") > FULL_MERGE
    values = []
    for name in RECORD_FIELDS:
        own = F.col(name)
        from_fields = own
        if name in COMBINED_FIELDS:
            pick = F.col(f"field_{name}")
            take = pick.isNotNull() & ((pick["score"] > FIELD_MERGE) | ~present(name, own))
            from_fields = F.when(take, pick["value"]).otherwise(own)
        from_best = value_or(name, F.col(f"best.merged.{name}"), own)
        values.append(F.when(winner, from_best).otherwise(from_fields).alias(name))

    def filled(field) -> Column:
        total = F.lit(0)
        for name in RECORD_FIELDS:
            total = total + present(name, field(name)).cast("int")
        return total

    searchable = present("title") | present("author")
    more = filled(lambda n: F.col(f"result.{n}")) > filled(F.col)
    result = docs.join(found, key, "left").withColumn("result", F.struct(*values))
    taken = F.col("best").isNotNull() & searchable & more
    by = F.when(taken, F.when(winner, F.col("best.source")).otherwise("combined"))
    out = result.withColumn("enriched_by", by).withColumns(
        {n: F.when(F.col("enriched_by").isNotNull(), F.col(f"result.{n}")).otherwise(F.col(n)) for n in RECORD_FIELDS}
    )
    return out.select(*docs.columns, "enriched_by")
