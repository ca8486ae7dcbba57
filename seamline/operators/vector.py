"""Exact nearest neighbours of a stated query set, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seamline.functions import usable_vector
from seamline.operators.lexical import check_k
from seamline.session import written

QUERY_BLOCK = 512
ROW_BLOCK = 4096
#: Query rows that are sent to all tasks; more meet the rows block by block in a product of partitions.
MOST_BROADCAST = 100_000


def usable(vectors: DataFrame, dim: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """(chunk_id, embedding) with repeated rows merged; null, short, NaN and all-zero vectors are left out."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable_vector(F.col(vector_col), dim))
    return rows.groupBy(F.col(id_col).cast("bigint").alias("chunk_id")).agg(F.first(vector_col).alias("embedding"))


def _packed(vectors: DataFrame, rows: int, prefix: str) -> DataFrame:
    """Rows of up to `rows` vectors each, as two byte strings: ids and a float32 matrix."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_flat"])

    return vectors.select("chunk_id", "embedding").mapInArrow(pack, f"{prefix}_ids binary, {prefix}_flat binary")


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int, dim: int = 64, digits: int = 6) -> DataFrame:
    """(question_id, rank, chunk_id, score): the k largest inner products per query row (chunk_id, embedding).

    Both sides travel as blocks; each pair of blocks is one matrix product and leaves only its own k best per
    query, so neither side needs to fit anywhere and no pair of single rows is ever emitted. Products are in
    double precision; scores are rounded before ranking and ties go to the smaller chunk_id. Both inputs are
    expected as `usable` returns them.
    """
    check_k(k)
    left, right = _packed(queries, QUERY_BLOCK, "q"), _packed(vectors, ROW_BLOCK, "v")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_flat, v_ids, v_flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                qi, vi = np.frombuffer(q_ids, "<i8"), np.frombuffer(v_ids, "<i8")
                q = np.frombuffer(q_flat, "<f4").reshape(len(qi), dim).astype("f8")
                v = np.frombuffer(v_flat, "<f4").reshape(len(vi), dim).astype("f8")
                order = np.argsort(vi, kind="stable")
                s = np.round(q @ v[order].T, digits)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qi, best.shape[1])), pa.array(vi[order][best].ravel()), pa.array(np.take_along_axis(s, best, 1).ravel())],
                    names=["question_id", "chunk_id", "score"],
                )

    # Blocks are packed once and read back; query blocks go to all tasks only below a checked number of rows.
    left, right = written(left), written(right)
    few = left.agg(F.coalesce(F.sum(F.length("q_ids")), F.lit(0)).alias("bytes")).first().bytes <= 8 * MOST_BROADCAST
    blocks = right.crossJoin(F.broadcast(left) if few else left).select("q_ids", "q_flat", "v_ids", "v_flat")
    scored = blocks.mapInArrow(score, "question_id bigint, chunk_id bigint, score double")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("question_id", "rank", "chunk_id", "score")
