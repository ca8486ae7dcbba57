"""Small files on any file system that Spark reads: local, HDFS or object stores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str | Iterable[str]) -> None:
    """Write a file beside the old one and put it in its place, so that readers see either of the two."""
    jvm = spark.sparkContext._jvm
    target, fs = _at(spark, path)
    target = fs.makeQualified(target)
    fs.mkdirs(target.getParent())
    fresh = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.partial")
    stream = fs.create(fresh, True)
    try:
        for part in [text] if isinstance(text, str) else text:
            stream.write(bytearray(part.encode("utf-8")))
    finally:
        stream.close()
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, target, options)
