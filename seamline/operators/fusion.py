"""Reciprocal rank fusion of two ranked hit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.operators.lexical import check_k

RRF_CONSTANT = 60
_LATER = 1_000_000_000


def rrf_score(rank: Column, constant: int = RRF_CONSTANT) -> Column:
    """1 / (constant + rank), ranks counted from 0."""
    return F.lit(1.0) / (F.lit(constant) + rank).cast("double")


def fuse(keyword: DataFrame, semantic: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(question_id, rank, chunk_id, score) from two lists (question_id, rank, chunk_id).

    A chunk found by both lists gets the sum. Equal sums keep the order in which the lists name them: all keyword
    hits by rank, then hits of the semantic list alone. One shuffle; either list may be empty.
    """
    check_k(k)
    first = keyword.select("question_id", "chunk_id", F.col("rank").alias("place"), "rank")
    second = semantic.select("question_id", "chunk_id", (F.lit(_LATER) + F.col("rank")).alias("place"), "rank")
    merged = first.unionByName(second).groupBy("question_id", "chunk_id").agg(F.sum(rrf_score(F.col("rank"))).alias("score"), F.min("place").alias("place"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("place"))
    ranked = merged.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return ranked.select("question_id", "rank", "chunk_id", F.round("score", digits).alias("score"))
