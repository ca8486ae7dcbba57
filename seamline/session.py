"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: object) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seamline")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may do without: it gets a folder of its own."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"seamline-{uuid.uuid4().hex}")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that later stages neither recompute nor depend on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_kept: set[str] = set()


def _forget(spark: SparkSession, folder: str) -> None:
    from seamline.sources.files import delete

    with contextlib.suppress(Exception):  # the session may be gone
        delete(spark, folder)


def written(df: DataFrame, row_group_mb: int = 128) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: later reads take only the columns they need.

    A row group is read by one task, so smaller ones can be dealt out evenly. The tables of an application are deleted when its driver ends.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in _kept:
        _kept.add(folder)
        atexit.register(_forget, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", row_group_mb << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
