"""A keyed table of earlier search results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["query", "k", "mode", "index_version"]


def split_by_cache(questions: DataFrame, cache: DataFrame, k: int, mode: str, index_version: str) -> tuple[DataFrame, DataFrame]:
    """(cached hits, questions still to be searched). questions: (question_id, question).

    A cached list is used only for the same text, k, mode and index version.
    """
    asked = questions.select("question_id", F.col("question").alias("query"))
    mine = cache.where((F.col("k") == k) & (F.col("mode") == mode) & (F.col("index_version") == index_version)).select("query", "rank", "chunk_id", "score")
    hits = asked.join(mine, "query").select("question_id", "rank", "chunk_id", "score")
    missed = asked.join(mine.select("query").distinct(), "query", "left_anti").select("question_id", F.col("query").alias("question"))
    return hits, missed


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with the rows of `fresh` in place of any older rows under the same key."""
    keys = fresh.select(*KEY).distinct()
    return cache.join(keys, KEY, "left_anti").unionByName(fresh.select(*cache.columns))
