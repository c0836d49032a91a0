"""Streaming ingestion with the batch functions: files in, library tables out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.operators.mutate import KEPT_ON_UPDATE, last_of_each
from scriptorium.sources.files import BINARY_FILE, text_documents
from scriptorium.sources.tables import folders, read_manifest, remove, replace_table, write_manifest

LOG = "log"
BUCKET = "bucket"
#: Folders of the first snapshot, by a hash of the key.
BUCKETS = 16


def stream_files(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder and its subfolders as a stream."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    return reader.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(directory)


def documents(files: DataFrame, language: str = "auto") -> DataFrame:
    """Files to cleaned documents; the same columns for batch and stream."""
    return text_documents(files).withColumn("language", F.lit(language))


def run(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into a parquet folder, exactly once per file."""
    writer = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start()


def log_batch(root: str, now: Column | None = None, order: str | None = None, key: str = "id"):
    """A ``foreachBatch`` function that adds a batch of library rows to the log below ``root``.

    Each batch writes only its own rows. A replayed batch overwrites the folder of its number. Of several rows of
    a batch with one id the last by ``order`` counts, without it the last by content.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        stamp = F.current_timestamp().cast("timestamp_ntz") if now is None else now
        rows = last_of_each(batch, key, order).withColumn("seen_at", stamp)
        rows.write.mode("overwrite").parquet(f"{root}/{LOG}/batch={batch_id}")

    return apply


def run_upsert(stream: DataFrame, root: str, checkpoint: str, **options) -> StreamingQuery:
    """Add everything available of a stream of library rows to the log below ``root``; see `log_batch`."""
    writer = stream.writeStream.foreachBatch(log_batch(root, **options)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def open_batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the log's batches that no snapshot holds yet."""
    merged = (read_manifest(spark, root) or {"batch": -1})["batch"]
    numbers = [int(name.removeprefix("batch=")) for name in folders(spark, f"{root}/{LOG}") if name.startswith("batch=")]
    return sorted(n for n in numbers if n > merged)


def _snapshot(spark: SparkSession, root: str, manifest: dict, buckets: list[str] | None = None) -> DataFrame | None:
    """The snapshot's rows as log rows before the first batch; of some buckets, or of all."""
    paths = [f"{root}/snapshot/{version}/{BUCKET}={b}" for b, version in manifest["buckets"].items() if buckets is None or b in buckets]
    if not paths:
        return None
    return spark.read.parquet(*paths).withColumnRenamed("updated_at", "seen_at").withColumn("batch", F.lit(-1))


def _merged(log: DataFrame, key: str) -> DataFrame:
    """The latest row per key, with the first row's ``added_at`` and file columns."""
    times = ("added_at", "updated_at")
    kept = [c for c in KEPT_ON_UPDATE if c in log.columns and c not in times]
    newest = [c for c in log.columns if c not in (key, "batch", "seen_at", *kept, *times)]
    # Rows that bring the time they were added keep it.
    added = F.coalesce("added_at", "seen_at") if "added_at" in log.columns else F.col("seen_at")
    first = F.min_by(F.struct(added.alias("added_at"), *kept), "batch").alias("first")
    last = F.max_by(F.struct("seen_at", *newest), "batch").alias("last")
    return log.groupBy(key).agg(first, last).select(
        key,
        *[F.col(f"first.{c}") for c in kept],
        *[F.col(f"last.{c}") for c in newest],
        F.col("first.added_at"),
        F.col("last.seen_at").alias("updated_at"),
    )


def library_from_log(spark: SparkSession, root: str, key: str = "id") -> DataFrame:
    """The upserted library: the snapshot with the batches after it merged in.

    Read are the snapshot and the open batches only, however long the log has become.
    """
    manifest = read_manifest(spark, root) or {"batch": -1, "buckets": {}}
    rows = _snapshot(spark, root, manifest)
    numbers = open_batches(spark, root)
    if numbers:
        log = spark.read.option("basePath", f"{root}/{LOG}").parquet(*[f"{root}/{LOG}/batch={n}" for n in numbers])
        if rows is None:
            return _merged(log, key)
        rows = rows.unionByName(log, allowMissingColumns=True)
    if rows is None:
        raise FileNotFoundError(f"neither snapshot nor batches below {root}")
    return _merged(rows, key) if numbers else rows.drop("batch").withColumnRenamed("seen_at", "updated_at")


def compact(spark: SparkSession, root: str, key: str = "id", buckets: int = BUCKETS) -> dict:
    """Merge the open batches into the snapshot and switch the manifest to it.

    Rows are kept in folders by a hash of the key. Only folders that a new batch has keys of are written anew, as parts of
    a new version; the manifest names the version of each folder, so the others stay where they are. The manifest is
    switched by one rename: a run that fails before it changes nothing, and one that is repeated finds nothing to do.
    The number of folders is that of the first snapshot.
    """
    manifest = read_manifest(spark, root) or {"batch": -1, "buckets": {}, "of": buckets}
    numbers = open_batches(spark, root)
    if not numbers:
        return manifest
    log = spark.read.option("basePath", f"{root}/{LOG}").parquet(*[f"{root}/{LOG}/batch={n}" for n in numbers])
    bucket = F.pmod(F.xxhash64(key), F.lit(manifest["of"]))
    # As many numbers as there are folders, at most.
    touched = sorted(str(r[0]) for r in log.select(bucket).distinct().collect())
    old = _snapshot(spark, root, manifest, touched)
    rows = log if old is None else old.unionByName(log, allowMissingColumns=True)
    version = f"v-{uuid.uuid4().hex[:12]}"
    merged = _merged(rows, key).withColumn(BUCKET, bucket)
    merged.repartition(BUCKET, F.pmod(F.xxhash64(F.lit(1), key), F.lit(8))).write.partitionBy(BUCKET).parquet(f"{root}/snapshot/{version}")
    named = {"batch": numbers[-1], "of": manifest["of"], "buckets": manifest["buckets"] | dict.fromkeys(touched, version)}
    write_manifest(spark, root, named)
    return named


def drop_merged(spark: SparkSession, root: str) -> None:
    """Remove batches that the snapshot holds, and versions of which no folder is named any more."""
    manifest = read_manifest(spark, root)
    if manifest is None:
        return
    for name in folders(spark, f"{root}/{LOG}"):
        if name.startswith("batch=") and int(name.removeprefix("batch=")) <= manifest["batch"]:
            remove(spark, f"{root}/{LOG}/{name}")
    for version in folders(spark, f"{root}/snapshot"):
        if version not in manifest["buckets"].values():
            remove(spark, f"{root}/snapshot/{version}")


def publish(spark: SparkSession, root: str, table: str) -> str:
    """Publish the log's present state as a table version."""
    return replace_table(library_from_log(spark, root), table)
