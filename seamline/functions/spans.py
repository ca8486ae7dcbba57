"""Half-open character spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap of two spans over their union. 0 where the union is empty or any bound is null."""
    zero = F.lit(0).cast("bigint")
    inter = F.greatest(zero, F.least(end_a, end_b) - F.greatest(start_a, start_b))
    union = (end_a - start_a) + (end_b - start_b) - inter
    known = start_a.isNotNull() & end_a.isNotNull() & start_b.isNotNull() & end_b.isNotNull()
    return F.when(known & (union != 0), inter.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def span(path: str = "file_path", start: str = "start_index", end: str = "end_index") -> Column:
    """A chunk's place as the struct used in questions and results."""
    return F.struct(
        F.col(path).alias("file_path"),
        F.col(start).cast("bigint").alias("first_character_index"),
        F.col(end).cast("bigint").alias("last_character_index"),
    )


def citation(path: str = "file_path", start: str = "start_index", end: str = "end_index") -> Column:
    """A readable place: path [start:end]."""
    return F.format_string("%s [%d:%d]", F.col(path), F.col(start), F.col(end))
