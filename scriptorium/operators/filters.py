"""Row predicates over the library and over text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import extension, strip
from scriptorium.schema import FIELD_TYPES, present

# Upload rules.
ACCEPTED_UPLOADS = [".pdf", ".docx", ".epub", ".pptx", ".txt"]
UPLOAD_LIMIT_BYTES = 100 * 1024 * 1024
MIN_TEXT_CHARS = 100


def contains_ci(c: Column, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def author_contains(needle: str) -> Column:
    query = F.lit(needle.lower())
    return F.coalesce(F.exists("author", lambda a: F.contains(F.lower(a), query)), F.lit(False))


def year_between(low: int | str | None = None, high: int | str | None = None) -> Column:
    year = F.col("year").try_cast("int")
    keep = F.lit(True)
    if low:
        keep = keep & present("year", year) & (year >= int(low))
    if high:
        keep = keep & present("year", year) & (year <= int(high))
    return keep


def source_contains(needle: str) -> Column:
    return contains_ci(F.col("journal"), needle) | contains_ci(F.col("publisher"), needle) | contains_ci(
        F.col("source"), needle
    )


def search_filter(filters: dict | None) -> Column:
    """Conjunction of the given search filters; empty values are ignored."""
    given = {k: v for k, v in (filters or {}).items() if v}
    keep = F.lit(True)
    if "author" in given:
        keep = keep & author_contains(given["author"])
    if "year_min" in given or "year_max" in given:
        keep = keep & year_between(given.get("year_min"), given.get("year_max"))
    if "source" in given:
        keep = keep & source_contains(given["source"])
    if "document_id" in given:
        keep = keep & (F.col("id") == given["document_id"])
    return keep


def exact_filter(filters: dict | None) -> Column:
    """Equality on year (compared as text), type and language; empty values are ignored."""
    keep = F.lit(True)
    for name in ("year", "type", "language"):
        wanted = (filters or {}).get(name)
        if wanted:
            keep = keep & present(name) & (F.col(name).cast("string") == str(wanted))
    return keep


def metadata_search(library: DataFrame, query: str, filters: dict | None = None, dup_quirk: bool = False) -> DataFrame:
    """Documents whose title, authors, journal, publisher or abstract contain the query.

    Each document appears once. ``dup_quirk=True`` repeats a document whose title does not match but
    whose authors and another field both do.
    """
    title = contains_ci(F.col("title"), query)
    author = author_contains(query)
    other = F.lit(False)
    for name in ("journal", "publisher", "abstract"):
        if name in library.columns:
            other = other | contains_ci(F.col(name), query)
    kept = library.filter(exact_filter(filters)).filter(title | author | other)
    if not dup_quirk:
        return kept
    times = F.when(~title & author & other, 2).otherwise(1)
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")


def list_filter(text: str | None = None, year: str | None = None, kind: str | None = None) -> Column:
    """The library page's filters: text on title/author, a year or ``older``, a type or ``other``."""
    keep = F.lit(True)
    if text:
        keep = keep & (contains_ci(F.col("title"), text) | author_contains(text))
    if year == "older":
        keep = keep & present("year") & (F.col("year") < 2020)
    elif year:
        keep = keep & F.coalesce(F.col("year") == int(year), F.lit(False))
    if kind == "other":
        keep = keep & ~F.coalesce(F.col("type").isin("article", "book", "thesis"), F.lit(False))
    elif kind:
        keep = keep & F.coalesce(F.col("type") == kind, F.lit(False))
    return keep


def needs_ocr(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < MIN_TEXT_CHARS


def upload_accepted(name: Column, size: Column, limit: int = UPLOAD_LIMIT_BYTES) -> Column:
    return extension(name).isin(ACCEPTED_UPLOADS) & (size <= limit)


def chunk_contains(needle: str) -> Column:
    return contains_ci(F.col("text"), needle)


def enabled_sources(options: dict[str, bool]) -> list[str]:
    """Names of the switched-on catalogues; a ``use_`` prefix is dropped."""
    return [name.removeprefix("use_") for name, on in options.items() if on]


def lookup(library: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids with their metadata; unknown ids keep a row with ``found = false`` and empty values."""
    found = ids.join(library.withColumn("found", F.lit(True)), "id", "left")
    defaults = {"found": F.coalesce("found", F.lit(False))}
    for name in library.columns:
        if name in FIELD_TYPES and FIELD_TYPES[name].simpleString() == "string":
            defaults[name] = F.coalesce(name, F.lit(""))
    return found.withColumns(defaults)


def lookup_text(ids: DataFrame, fulltext: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids with their text; the empty text for unknown ids."""
    return ids.join(fulltext.select(key, "text"), key, "left").withColumn("text", F.coalesce("text", F.lit("")))


def lookup_chunks(ids: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids with their chunks in order (``chunks``, structs of chunk_id and text); no chunks for unknown ids.

    Only the requested documents' chunks are gathered, each document's in its own row.
    """
    listed = chunks.join(ids.select(key).distinct(), key, "left_semi").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("chunks")
    )
    joined = ids.join(listed, key, "left")
    empty = F.array().cast(listed.schema["chunks"].dataType)
    return joined.withColumn("chunks", F.coalesce("chunks", empty))
