"""Writing results and replacing tables in one step."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"
MANIFEST = "MANIFEST"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri() if target.toUri().getScheme() else jvm.java.io.File(path).toURI(),
        spark._jsc.hadoopConfiguration(),
    )
    return context, target


def _switch(spark: SparkSession, root: str, name: str, content: str) -> None:
    """Put ``content`` into the small file ``name`` by an atomic rename: readers see the old content or the new one."""
    jvm = spark._jvm
    context, target = _files(spark, f"{root}/{name}")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.{uuid.uuid4().hex[:12]}")
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    parent = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 1)
    parent[0] = jvm.org.apache.hadoop.fs.Options.CreateOpts.createParent()
    stream = context.create(fresh, flags, parent)
    stream.write(bytearray(content.encode()))
    stream.close()
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fresh, target, rename)


def _pointed(spark: SparkSession, root: str, name: str) -> str | None:
    """Content of the small file ``name``, or None where there is none yet."""
    context, target = _files(spark, f"{root}/{name}")
    if not context.util().exists(target):
        return None
    return spark.read.text(f"{root}/{name}", wholetext=True).first()[0]


def read_manifest(spark: SparkSession, root: str) -> dict | None:
    """What the manifest of ``root`` names, or None before the first one."""
    content = _pointed(spark, root, MANIFEST)
    return None if content is None else json.loads(content)


def write_manifest(spark: SparkSession, root: str, named: dict) -> None:
    _switch(spark, root, MANIFEST, json.dumps(named, sort_keys=True))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing names any more."""
    context, target = _files(spark, path)
    context.delete(target, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``; none where it does not exist."""
    context, target = _files(spark, path)
    if not context.util().exists(target):
        return []
    return sorted(s.getPath().getName() for s in context.util().listStatus(target) if s.isDirectory())


def current_version(spark: SparkSession, root: str) -> str | None:
    """Folder the table's pointer names, or None before the first write."""
    version = _pointed(spark, root, POINTER)
    return None if version is None else f"{root}/{version.strip()}"


def _new_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    version = f"v-{uuid.uuid4().hex[:12]}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{version}")
    return version


def replace_table(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write a new version beside the old one, then switch the pointer by an atomic rename.

    Readers see the old table until the switch and the new one after it; a failed write changes nothing.
    """
    version = _new_version(df, root, partition_by)
    _switch(df.sparkSession, root, POINTER, version)
    return f"{root}/{version}"


def read_table(spark: SparkSession, root: str) -> DataFrame | None:
    path = current_version(spark, root)
    return None if path is None else spark.read.parquet(path)


#: The tables that results consist of.
RESULTS = ["fulltext", "library", "chunks", "status"]


def write_results(fulltext: DataFrame, library: DataFrame, chunks: DataFrame, root: str) -> dict[str, str]:
    """Texts, metadata, chunks and the completion markers of the documents written, as one version.

    Four tables are written beside the old ones; one manifest then names all four, switched by one rename. A reader
    sees the four of one write, and a write that fails on the way changes nothing.
    """
    spark = library.sparkSession
    named = {name: _new_version(df, f"{root}/{name}") for name, df in (("fulltext", fulltext), ("library", library), ("chunks", chunks))}
    done = spark.read.parquet(f"{root}/library/{named['library']}").select("id", F.lit("complete").alias("status"))
    named["status"] = _new_version(done, f"{root}/status")
    write_manifest(spark, root, named)
    return named


def read_results(spark: SparkSession, root: str, named: dict[str, str] | None = None) -> dict[str, DataFrame] | None:
    """The four tables of one version: that of the manifest, or the one ``named`` that a reader has looked up before."""
    named = named or read_manifest(spark, root)
    return None if named is None else {name: spark.read.parquet(f"{root}/{name}/{named[name]}") for name in RESULTS}


def vacuum_results(spark: SparkSession, root: str, keep: list[dict[str, str]] | None = None) -> list[str]:
    """Remove the versions that neither the manifest nor ``keep`` (versions still being read) names; their folders."""
    kept = [named for named in (read_manifest(spark, root), *(keep or [])) if named]
    gone = []
    for name in RESULTS:
        used = {named[name] for named in kept}
        gone += [f"{root}/{name}/{v}" for v in folders(spark, f"{root}/{name}") if v.startswith("v-") and v not in used]
    for path in gone:
        remove(spark, path)
    return gone


def export_metadata(library: DataFrame, path: str) -> None:
    library.write.mode("errorifexists").json(path)
