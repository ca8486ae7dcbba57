"""Structured Streaming: keep an index up to date with newly arriving file rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seamline.functions import terms
from seamline.operators.snapshots import latest_files
from seamline.plans.engine import Engine


def follow_files(stream: DataFrame, engine: Engine, checkpoint: str, snapshot_path: str) -> StreamingQuery:
    """Apply each micro-batch of (path, content, loaded_at) rows to a snapshot table and re-index what changed.

    The snapshot is written under the number of the batch, so a repeated batch overwrites its own output only.
    """
    spark = stream.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", "content", "loaded_at")
        if number:
            rows = spark.read.parquet(f"{snapshot_path}/{number - 1}").unionByName(rows)
        newest = rows.groupBy("path").agg(F.max_by("content", F.struct("loaded_at", "content")).alias("content"), F.max("loaded_at").alias("loaded_at"))
        newest.write.mode("overwrite").parquet(f"{snapshot_path}/{number}")
        files = latest_files(spark.read.parquet(f"{snapshot_path}/{number}"))
        from seamline.functions import suffix

        engine.index(files.withColumn("extension", suffix(F.col("file_path"))).where(F.col("content").isNotNull()), incremental=True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_terms(stream: DataFrame, time_col: str, text_col: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Term counts per time window, with a watermark for late rows."""
    rows = stream.withWatermark(time_col, late).select(time_col, F.explode(terms(F.col(text_col))).alias("term"))
    return rows.groupBy(F.window(time_col, window), "term").agg(F.count("*").alias("n"))
