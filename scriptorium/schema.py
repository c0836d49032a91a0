"""The library's fixed metadata schema and the one null rule used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

METADATA = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("author", STRINGS),
        T.StructField("year", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("publisher_location", T.StringType()),
        T.StructField("volume", T.StringType()),
        T.StructField("issue", T.StringType()),
        T.StructField("pages", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("isbn", T.StringType()),
        T.StructField("issn", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("creator", T.StringType()),
        T.StructField("keywords", STRINGS),
        T.StructField("page_count", T.LongType()),
        T.StructField("cited_by_count", T.LongType()),
        T.StructField("is_open_access", T.BooleanType()),
        T.StructField("filename", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("created", T.StringType()),
        T.StructField("modified", T.StringType()),
        T.StructField("file_extension", T.StringType()),
        T.StructField("ocr_applied", T.BooleanType()),
        T.StructField("ocr_language", T.StringType()),
    ]
)

FIELD_TYPES = {f.name: f.dataType for f in METADATA.fields}

# What a catalogue record carries after normalisation, in column order.
RECORD_FIELDS = [
    "title", "author", "year", "publisher", "journal", "doi", "isbn", "issn", "page_count",
    "language", "keywords", "abstract", "type", "cited_by_count", "is_open_access",
]


def present(name: str, c: Column | None = None) -> Column:
    """Missing, empty text, empty list, zero and false are all "absent"."""
    c = F.col(name) if c is None else c
    kind = FIELD_TYPES[name]
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def value_or(name: str, preferred: Column, fallback: Column) -> Column:
    """The preferred value where it is present, else the fallback."""
    return F.when(present(name, preferred), preferred).otherwise(fallback)


def has_text(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
