"""Recall of retrieved spans against gold spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import iou

IOU_THRESHOLD = 0.05


def gold_spans(questions: DataFrame) -> DataFrame:
    """(question_id, gold_id, file_path, first_character_index, last_character_index), one row per listed source.

    Questions with null or empty sources give no rows; repeated rows of a question are read once.
    """
    single = questions.groupBy("question_id").agg(F.first("sources", ignorenulls=True).alias("sources"))
    return single.select("question_id", F.posexplode("sources").alias("gold_id", "s")).select("question_id", "gold_id", "s.*")


def gold_hits(gold: DataFrame, hits: DataFrame, k: int, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """Gold rows with hit = 1 where one of the first k hits lies in the same file and overlaps enough.

    hits: (question_id, rank, file_path, start_index, end_index). A gold span counts once however many hits
    cover it, and one hit may cover several.
    """
    best = hits.where(F.col("rank") < k).select("question_id", "file_path", "start_index", "end_index").distinct()
    gold = gold.select("question_id", "gold_id", "file_path", "first_character_index", "last_character_index")
    overlap = iou(F.col("first_character_index"), F.col("last_character_index"), F.col("start_index"), F.col("end_index"))
    found = gold.join(best, ["question_id", "file_path"]).where(overlap >= F.lit(threshold)).select("question_id", "gold_id").distinct().withColumn("hit", F.lit(1))
    return gold.join(found, ["question_id", "gold_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def recall_per_question(questions: DataFrame, hits: DataFrame, k: int, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """(question_id, n_gold, n_found, recall); 0.0 for questions without gold spans."""
    gold = gold_spans(questions)
    counted = gold_hits(gold, hits, k, threshold).groupBy("question_id").agg(F.count("*").alias("n_gold"), F.sum("hit").alias("n_found"))
    every = questions.select("question_id").distinct().join(counted, "question_id", "left")
    n_gold, n_found = F.coalesce("n_gold", F.lit(0)), F.coalesce("n_found", F.lit(0))
    recall = F.when(n_gold > 0, n_found.cast("double") / n_gold.cast("double")).otherwise(F.lit(0.0))
    return every.select("question_id", n_gold.cast("bigint").alias("n_gold"), n_found.cast("bigint").alias("n_found"), recall.alias("recall"))


def recall_at(questions: DataFrame, hits: DataFrame, ks: tuple[int, ...], threshold: float = IOU_THRESHOLD) -> DataFrame:
    """(k, recall): the mean recall at several k in one pass, by the smallest rank that hits each gold span."""
    hit = hits.where(F.col("rank") < max(ks)).groupBy("question_id", "file_path", "start_index", "end_index").agg(F.min("rank").alias("rank"))
    gold = gold_spans(questions)
    overlap = iou(F.col("first_character_index"), F.col("last_character_index"), F.col("start_index"), F.col("end_index"))
    first = gold.join(hit, ["question_id", "file_path"]).where(overlap >= F.lit(threshold)).groupBy("question_id", "gold_id").agg(F.min("rank").alias("first"))
    found = gold.select("question_id", "gold_id").join(first, ["question_id", "gold_id"], "left")
    counted = found.groupBy("question_id").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("first") < k, 1)).alias(f"found_{k}") for k in ks))
    every = questions.select("question_id").distinct().join(counted, "question_id", "left")
    means = every.agg(*(F.avg(F.coalesce(F.col(f"found_{k}").cast("double") / F.col("n").cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks))
    return means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("recall")) for k in ks))).alias("r")).select("r.k", "r.recall")


def mean_recall(per_question: DataFrame) -> DataFrame:
    """One row: n_questions and the plain mean of recall (null for no questions)."""
    return per_question.agg(F.count("*").alias("n_questions"), F.avg("recall").alias("recall"))


def check_sizes(results: int, questions: int) -> None:
    if results != questions:
        raise ValueError(f"{results} results for {questions} questions")
