"""Question sets and result files: single JSON documents with a list inside."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.schemas import QUESTION_FILE, RESULT_FILE
from seamline.sources.files import replace_text


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(pos, question_id, question, answer, sources); a missing id is replaced by a random one."""
    rows = spark.read.schema(QUESTION_FILE).option("multiLine", True).json(path)
    flat = rows.select(F.posexplode("rag_questions").alias("pos", "q")).select("pos", "q.*")
    return flat.withColumn("question_id", F.coalesce("question_id", F.uuid()))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(pos, question_id, question, question_str, retrieved_sources, answer, k)."""
    rows = spark.read.schema(RESULT_FILE).option("multiLine", True).json(path)
    return rows.select("k", F.posexplode("search_results").alias("pos", "r")).select("pos", "r.*", "k")


def result_hits(results: DataFrame) -> DataFrame:
    """(question_id, rank, file_path, start_index, end_index) of saved results."""
    flat = results.select("question_id", F.posexplode("retrieved_sources").alias("rank", "s"))
    return flat.select("question_id", "rank", F.col("s.file_path").alias("file_path"), F.col("s.first_character_index").alias("start_index"), F.col("s.last_character_index").alias("end_index"))


def write_results(results: DataFrame, path: str, k: int) -> None:
    """One indented JSON document under exactly this name; rows are streamed in question order, not collected."""
    order = "pos" if "pos" in results.columns else "question_id"
    lines = results.orderBy(order).select(F.to_json(F.struct(*[c for c in results.columns if c not in ("pos", "k")]), {"ignoreNullFields": "false"}))

    def parts() -> Iterator[str]:
        yield '{\n  "search_results": ['
        for i, row in enumerate(lines.toLocalIterator()):
            body = json.dumps(json.loads(row[0]), indent=2, ensure_ascii=False)
            yield (",\n    " if i else "\n    ") + body.replace("\n", "\n    ")
        yield f'\n  ],\n  "k": {int(k)}\n}}\n'

    replace_text(results.sparkSession, path, parts())


def result_path(save_directory: str, save_file: str | None, dataset_path: str) -> str:
    """The file of results: save_file, or the name of the data set, below the directory."""
    return f"{save_directory.rstrip('/')}/{save_file or os.path.basename(dataset_path)}"
