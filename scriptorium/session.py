"""Session settings and the shared work folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Documents differ in length by four orders of magnitude; small Arrow batches keep the
    # splitter's Python workers flat in memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Call sites recorded per column expression make building wide plans slow.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("scriptorium")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Small local shuffles still carry heavy text work: do not merge them into one task.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when a table has fewer splits than cores.

    Files of one row group are read by one task; text work on it would use one core. A table with enough
    splits, as any large one has, is returned unchanged and keeps its scan partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


@functools.cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="scriptorium-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only where that setting is missing *and* the session is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    FOLDERS.append(folder)
    return folder


#: The work folders this driver has asked for, in order.
FOLDERS: list[str] = []


def remove_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete work folders that nothing will read any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so a lost executor re-reads files."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Mark a written table for broadcast if its files are small; otherwise leave the join as it is.

    Columns may take some times their file size in memory: the bound leaves room for that.
    """
    spark = df.sparkSession
    conf, new_path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    measured = sum(new_path(f).getFileSystem(conf).getContentSummary(new_path(f)).getLength() for f in folders)
    return F.broadcast(df) if folders and measured <= max_bytes else df
