"""Difference of two content snapshots and the upkeep of tables that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_files(files: DataFrame, path_col: str = "path", text_col: str = "content", time_col: str = "loaded_at") -> DataFrame:
    """One row (file_path, content) per path: the text loaded last, ties broken by the larger text."""
    newest = F.max_by(text_col, F.struct(F.col(time_col), F.col(text_col)))
    return files.where(F.col(path_col).isNotNull()).groupBy(F.col(path_col).alias("file_path")).agg(newest.alias("content"))


def file_hashes(files: DataFrame) -> DataFrame:
    """(file_path, content_md5); a null text has a null hash."""
    return files.select("file_path", F.md5("content").alias("content_md5"))


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths of `new` that `old` lacks or holds with another hash. Both: (file_path, content_md5)."""
    before = old.select("file_path", F.col("content_md5").alias("old_md5"), F.lit(True).alias("known"))
    joined = new.select("file_path", "content_md5").join(before, "file_path", "left")
    return joined.where(F.col("known").isNull() | ~F.col("old_md5").eqNullSafe(F.col("content_md5"))).select("file_path")


def deleted_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.select("file_path").distinct().join(new.select("file_path"), "file_path", "left_anti")


def affected_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    return changed_paths(old, new).union(deleted_paths(old, new)).distinct()


def kept_rows(rows: DataFrame, affected: DataFrame) -> DataFrame:
    """Rows of files that did not change (null paths are kept)."""
    return rows.join(affected.select("file_path"), "file_path", "left_anti")


def removed_rows(rows: DataFrame, affected: DataFrame) -> DataFrame:
    return rows.join(affected.select("file_path"), "file_path", "left_semi")


def assign_ids(rows: DataFrame, high_water: DataFrame, order_by: str = "start_index", id_col: str = "chunk_id", ordinal: str | None = None) -> DataFrame:
    """Number rows of (file_path, start_index, ...) in file order after the largest id ever given.

    high_water: one row with column top. Ids come from a prefix sum over the counts per file plus the place in the
    file, so no stage sorts all rows in one task; the prefix sum itself handles one row per file, in ranges. Where rows
    already bear their place in the file (ordinal, from 0) the rows of a file are not brought together at all.
    """
    from seamline.session import cut

    place = F.col(ordinal) + 1 if ordinal else F.row_number().over(Window.partitionBy("file_path").orderBy(order_by))
    counts = rows.groupBy("file_path").agg(F.count("*").alias("n"))
    # The ranges come from a sample: they are drawn once.
    ranged = cut(counts.repartitionByRange("file_path").withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("earlier"))  # one row per partition
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("file_path")) - F.col("n")
    offsets = ranged.withColumn("inside", inside).join(F.broadcast(before), "part").select("file_path", (F.col("earlier") + F.col("inside")).alias("__offset"))
    numbered = rows.withColumn("__place", place).join(offsets, "file_path").crossJoin(F.broadcast(high_water.select(F.col("top").alias("__top"))))
    return numbered.withColumn(id_col, (F.col("__top") + F.col("__offset") + F.col("__place")).cast("bigint")).drop("__top", "__offset", "__place")


def merge_rows(old_rows: DataFrame, new_rows: DataFrame, affected: DataFrame) -> DataFrame:
    """Kept old rows plus new rows, by column name."""
    return kept_rows(old_rows, affected).unionByName(new_rows.select(*old_rows.columns))
