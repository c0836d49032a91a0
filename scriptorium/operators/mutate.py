"""Changing library tables: upsert, patch, delete, recover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import split_names
from scriptorium.schema import FIELD_TYPES, has_text, present

# Columns an upsert keeps from the stored row.
KEPT_ON_UPDATE = ["added_at", "filename", "filepath"]


def upsert(stored: DataFrame, incoming: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """Replace or add rows by key; stored rows keep ``added_at``, ``filename`` and ``filepath``.

    ``incoming`` has one row per key. Both times of a new row are ``now``; replaced rows get a new
    ``updated_at``. Applying the same batch twice gives the same table.
    """
    columns = stored.columns
    old = stored.select(key, F.struct(*[c for c in columns if c != key]).alias("old"))
    new = incoming.select(key, F.struct(*[c for c in incoming.columns if c != key]).alias("new"))
    is_new, is_old = F.col("new").isNotNull(), F.col("old").isNotNull()
    out = [F.col(key)]
    for name in columns:
        if name == key:
            continue
        was = F.col(f"old.{name}")
        if name == "updated_at":
            value = F.when(is_new, now).otherwise(was)
        elif name == "added_at":
            value = F.when(is_old, was).otherwise(now)
        elif name not in incoming.columns:
            value = was
        elif name in KEPT_ON_UPDATE:
            value = F.when(is_old, was).otherwise(F.col(f"new.{name}"))
        else:
            value = F.when(is_new, F.col(f"new.{name}")).otherwise(was)
        out.append(value.alias(name))
    return old.join(new, key, "full_outer").select(*out)


def last_of_each(rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row per key: the last by ``order``, among equals and without it the last by content."""
    whole = F.struct(*rows.columns)
    by = F.struct(F.col(order), F.to_json(whole)) if order else F.to_json(whole)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, by).alias("_row")).select("_row.*")


def form_patch(forms: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Submitted form fields as a patch: authors split at commas, year a number where it is one.

    Of several forms with one key the last by ``order`` counts, without it the last by content.
    """
    columns = {}
    if "authors" in forms.columns:
        columns["author"] = F.when(has_text(F.col("authors")), split_names(F.col("authors"), "form"))
    if "year" in forms.columns:
        columns["year"] = F.col("year").try_cast("int")
    return last_of_each(forms, key, order).withColumns(columns).drop("authors", *([order] if order else []))


def patch(library: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Take the filled fields of the patch; rows without a patch and patches without a row change nothing."""
    fields = [c for c in changes.columns if c != key and c in library.columns]
    patched = changes.select(key, F.struct(*fields).alias("_patch"))
    joined = library.join(patched, key, "left")
    values = {}
    for name in fields:
        new = F.col(f"_patch.{name}")
        filled = present(name, new) if name in FIELD_TYPES else new.isNotNull()
        values[name] = F.when(filled, new).otherwise(F.col(name))
    return joined.withColumns(values).select(*library.columns)


def delete(tables: dict[str, DataFrame], ids: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Remove the listed documents from every table."""
    doomed = ids.select(key).distinct()
    return {name: df.join(doomed, key, "left_anti") for name, df in tables.items()}


def recover(index: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Index rows plus the stored documents the index does not know."""
    missing = stored.join(index.select(key), key, "left_anti")
    return index.withColumn("recovered", F.lit(False)).unionByName(
        missing.withColumn("recovered", F.lit(True)), allowMissingColumns=True
    )


def select_for_reprocessing(documents: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The documents to run through the pipeline again."""
    return documents.join(ids.select(key), key, "left_semi")


def apply_review(staged: DataFrame, confirmed: DataFrame, key: str = "id") -> DataFrame:
    """Staged uploads without error, with the reviewer's metadata put over the extracted."""
    return patch(staged.filter(F.coalesce(F.col("status") != "failed", F.lit(True))), confirmed, key)
