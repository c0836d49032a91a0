"""Running library statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptorium.functions.text import extension
from scriptorium.schema import present
from scriptorium.sources.tables import replace_table


def running_histograms(library: DataFrame) -> DataFrame:
    """``(facet, value, documents)`` over a stream of library rows."""
    facets = F.array(
        F.struct(F.lit("file_type").alias("facet"), extension(F.col("filename")).alias("value")),
        F.struct(F.lit("year").alias("facet"), F.when(present("year"), F.col("year").cast("string")).alias("value")),
        F.struct(F.lit("language").alias("facet"), F.when(present("language"), F.col("language")).alias("value")),
    )
    rows = library.select(F.explode(facets).alias("f")).select("f.*").filter(F.col("value").isNotNull())
    return rows.groupBy("facet", "value").agg(F.count("*").alias("documents"))


def run(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Publish the small result table after every batch; readers (`tables.read_table`) see whole versions only."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        replace_table(batch.coalesce(1), sink)

    writer = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(publish).trigger(availableNow=True).start()
