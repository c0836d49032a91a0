"""Display projections, sort orders and status of library rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import UNKNOWN, file_name
from scriptorium.schema import METADATA, has_text, present

UNKNOWN_SOURCE = "Unbekannte Quelle"


def source_label() -> Column:
    """``Author (year) title: journal`` as far as the parts exist."""
    count = F.size("author")
    authors = (
        F.when(count == 1, F.get("author", F.lit(0)))
        .when(count == 2, F.concat(F.get("author", F.lit(0)), F.lit(" & "), F.get("author", F.lit(1))))
        .when(count > 2, F.concat(F.get("author", F.lit(0)), F.lit(" et al.")))
    )
    year = F.when(present("year"), F.concat(F.lit("("), "year", F.lit(")")))
    place = F.when(present("journal"), F.col("journal")).when(present("publisher"), F.col("publisher"))
    work = F.concat_ws(": ", F.when(present("title"), F.col("title")), place)
    label = F.concat_ws(" ", authors, year, F.when(has_text(work), work))
    return F.when(has_text(label), label).otherwise(UNKNOWN_SOURCE)


def listing(library: DataFrame, default: str = UNKNOWN) -> DataFrame:
    """Rows as the library page shows them, gaps filled with defaults."""
    place = F.when(present("journal"), F.col("journal")).when(present("publisher"), F.col("publisher"))
    return library.withColumns(
        {
            "title": F.when(present("title"), F.col("title")).otherwise(file_name(F.col("filename"))),
            "author": F.when(present("author"), F.col("author")).otherwise(F.array(F.lit(default))),
            "year": F.when(present("year"), F.col("year").cast("string")).otherwise(default),
            "source": F.coalesce(F.col("source"), place, F.lit(default)),
        }
    )


def card_line(library: DataFrame) -> DataFrame:
    """Title, joined authors and ``journal, year`` for a start-page card."""
    place = F.when(present("journal"), F.col("journal")).when(present("publisher"), F.col("publisher"))
    year = F.when(present("year"), F.concat(F.lit(", "), "year"))
    return library.withColumns(
        {
            "authors": F.coalesce(F.array_join("author", ", "), F.lit("")),
            "place": F.concat(F.coalesce(place, F.lit("")), F.coalesce(year, F.lit(""))),
        }
    )


def recent(library: DataFrame, n: int = 4) -> DataFrame:
    return library.orderBy(F.desc("added_at"), "id").limit(n)


def recent_searches(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def sort_listing(library: DataFrame, by: str = "added") -> DataFrame:
    first_author = F.get("author", F.lit(0))
    orders = {
        "added": [F.desc("added_at"), F.col("id")],
        "title": [F.asc_nulls_last("title"), F.col("id")],
        "author": [first_author.asc_nulls_last(), F.col("id")],
        "year": [F.desc_nulls_last("year"), F.col("id")],
    }
    return library.orderBy(*orders[by])


def document_status(requested: DataFrame, index: DataFrame, markers: DataFrame) -> DataFrame:
    """``complete`` when indexed, or when only the completion marker exists (then ``reload``), else ``processing``."""
    known = index.select("id", F.lit(True).alias("_indexed"))
    done = markers.select("id", F.lit(True).alias("_done"))
    indexed, marked = F.coalesce("_indexed", F.lit(False)), F.coalesce("_done", F.lit(False))
    return (
        requested.join(known, "id", "left")
        .join(done, "id", "left")
        .select(
            *requested.columns,
            F.when(indexed | marked, "complete").otherwise("processing").alias("status"),
            (marked & ~indexed).alias("reload"),
        )
    )


def metadata_rows(library: DataFrame, key: str) -> DataFrame:
    """One row per document and filled metadata field; lists are joined with commas."""
    shown = []
    for field in METADATA.fields:
        if field.name not in library.columns:
            continue
        listed = field.dataType.typeName() == "array"
        value = F.array_join(field.name, ", ") if listed else F.col(field.name).cast("string")
        shown.append(F.struct(F.lit(field.name).alias("field"), value.alias("value")))
    return (
        library.select(key, F.explode(F.array(*shown)).alias("row"))
        .select(key, "row.field", "row.value")
        .filter(F.col("value").isNotNull())
    )


def export_json(library: DataFrame) -> DataFrame:
    return library.select(F.to_json(F.struct("*")).alias("value"))
