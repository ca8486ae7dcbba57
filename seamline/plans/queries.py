"""Queries over the project's tables, each with its SQL twin in plans.oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import citation, iou, is_blank, suffix, terms, word_count
from seamline.operators import cache, chunking, fusion, lexical, prompting, recall, snapshots, vector

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
K = 10
DIM = 64


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.distinct_chunks(table(spark, sf, "chunks"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.latest_files(table(spark, sf, "source_files"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "questions")
    return rows.groupBy("question_id").agg(F.max(F.trim("question")).alias("question"), F.max("sources").alias("sources"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded searches: one row per question and rank, with the place of the chunk."""
    rows = table(spark, sf, "search_hits").groupBy("question_id", F.col("hit_rank").alias("rank")).agg(F.max("chunk_id").alias("chunk_id"), F.max("score").alias("score"))
    places = table(spark, sf, "chunks").groupBy(F.col("id").alias("chunk_id")).agg(F.max("file_path").alias("file_path"), F.max("start_index").alias("start_index"), F.max("end_index").alias("end_index"), F.max("content").alias("content"))
    return rows.join(places, "chunk_id")


# --- files ---------------------------------------------------------------------------------------------------


@query
def ext_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").select("file_id", "path", suffix(F.col("path")).alias("ext")).where(F.col("ext").isin(".py", ".md")).distinct()


@query
def blank_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").where(~is_blank(F.col("content"))).select("file_id", "path").distinct()


@query
def latest_files(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).select("file_path", F.length("content").alias("n_chars"))


@query
def file_md5(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.file_hashes(_files(spark, sf))


@query
def file_basename(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_files").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lower(suffix(F.col("path"))).alias("ext")).distinct()


def _old_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """The hashes recorded when the files were loaded (some stale or missing), and those of files no longer there."""
    recorded = table(spark, sf, "source_files").groupBy(F.col("path").alias("file_path")).agg(F.max("content_md5").alias("content_md5")).where(F.col("content_md5").isNotNull())
    gone = table(spark, sf, "upstream_files").select(F.col("path").alias("file_path"), F.md5("content").alias("content_md5"))
    return recorded.unionByName(gone.join(recorded, "file_path", "left_anti"))


@query
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.changed_paths(_old_hashes(spark, sf), file_md5(spark, sf))


@query
def deleted_files(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.deleted_paths(_old_hashes(spark, sf), file_md5(spark, sf))


@query
def affected_paths(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.affected_paths(_old_hashes(spark, sf), file_md5(spark, sf))


def _file_rows(spark: SparkSession, sf: str) -> DataFrame:
    old = _old_hashes(spark, sf)
    return old.withColumnRenamed("content_md5", "row_md5")


@query
def kept_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.kept_rows(_file_rows(spark, sf), affected_paths(spark, sf))


@query
def removed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.removed_rows(_file_rows(spark, sf), affected_paths(spark, sf))


@query
def incremental_merge(spark: SparkSession, sf: str) -> DataFrame:
    changed = changed_files(spark, sf)
    new = file_md5(spark, sf).join(changed, "file_path", "left_semi").withColumnRenamed("content_md5", "row_md5")
    return snapshots.merge_rows(_file_rows(spark, sf), new, affected_paths(spark, sf))


@query
def assigned_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids after the largest one in use, in order of path, for the files that changed."""
    rows = changed_files(spark, sf).withColumn("start_index", F.lit(0))
    top = table(spark, sf, "chunks").agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    return snapshots.assign_ids(rows, top).select("file_path", "chunk_id")


# --- text ----------------------------------------------------------------------------------------------------


@query
def tokenize_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(terms(F.col("text"), stop_words=False)).cast("bigint").alias("n_terms"))


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_frequencies(_chunks(spark, sf), stop_words=False).groupBy("term").agg(F.sum("tf").alias("n"))


@query
def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("chunk_id", F.size(terms(F.col("content"))).cast("bigint").alias("n_terms"))


@query
def token_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    words = _chunks(spark, sf).select(word_count(F.col("content")).alias("n"))
    return words.agg(F.round(F.avg(F.col("n").cast("double")), 6).alias("avg_len"), F.max("n").cast("bigint").alias("max_len"), F.min("n").cast("bigint").alias("min_len"), F.bool_or(F.col("n") > 256).alias("any_over"))


@query
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.corpus_stats(_chunks(spark, sf)).select("n_chunks", F.round("avgdl", 6).alias("avgdl"))


@query
def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.document_frequencies(lexical.term_frequencies(_chunks(spark, sf)))


@query
def term_freq(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_frequencies(_chunks(spark, sf))


@query
def bm25_impact(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25_postings(_chunks(spark, sf)).select("term", "chunk_id", "tf", F.round("impact", 6).alias("impact"))


# --- search --------------------------------------------------------------------------------------------------


@query
def bm25_search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25_search(_chunks(spark, sf), _questions(spark, sf), K)


@query
def bm25_single_query(spark: SparkSession, sf: str) -> DataFrame:
    one = spark.createDataFrame([("q", "How does the gateway retry a snapshot of the vocabulary?")], "question_id string, question string")
    return lexical.bm25_search(_chunks(spark, sf), one, K)


@query
def bm25_pad_to_k(spark: SparkSession, sf: str) -> DataFrame:
    one = spark.createDataFrame([("q1", "the of and"), ("q2", "nosuchtermatall"), ("q3", "quillcache")], "question_id string, question string")
    return lexical.bm25_search(_chunks(spark, sf), one, K, pad_to_k=True)


def _query_vectors(vectors: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50, against all rows."""
    return vectors.where(F.col("chunk_id") % 50 == 0)


@query
def vector_knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = vector.usable(table(spark, sf, "chunk_vectors"), DIM)
    return vector.knn_exact(_query_vectors(vectors), vectors, K, DIM)


@query
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    from seamline.functions import inner_product

    return vector.usable(table(spark, sf, "chunk_vectors"), DIM).select("chunk_id", F.round(inner_product(F.col("embedding"), F.col("embedding")), 6).alias("squared"))


@query
def unit_vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    vectors = vector.usable(table(spark, sf, "embeddings"), DIM, id_col="vec_id")
    return vector.knn_exact(_query_vectors(vectors), vectors, K, DIM)


@query
def rrf_score_table(spark: SparkSession, sf: str) -> DataFrame:
    ranks = table(spark, sf, "search_hits").select(F.col("hit_rank").alias("rank")).distinct()
    return ranks.select("rank", F.round(fusion.rrf_score(F.col("rank")), 9).alias("score"))


@query
def hybrid_rrf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded hits fused with fresh keyword hits."""
    fresh = lexical.bm25_search(lexical.distinct_chunks_in_place(table(spark, sf, "chunks")), _questions(spark, sf), K)
    recorded = _hits(spark, sf).select("question_id", "rank", "chunk_id")
    first = recorded.groupBy("question_id", "chunk_id").agg(F.min("rank").alias("rank"))
    return fusion.fuse(fresh, first, K)


@query
def hybrid_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword hits fused with vector hits: the stated query set asks with its own text and its own vector."""
    vectors = vector.usable(table(spark, sf, "chunk_vectors"), DIM)
    asked, chunks = _query_vectors(vectors), _chunks(spark, sf)
    questions = chunks.join(asked.select("chunk_id"), "chunk_id", "left_semi").select(F.col("chunk_id").alias("question_id"), F.col("content").alias("question"))
    by_vector = vector.knn_exact(asked.join(questions.select(F.col("question_id").alias("chunk_id")), "chunk_id", "left_semi"), vectors, K, DIM)
    return fusion.fuse(lexical.bm25_search(chunks, questions, K), by_vector, K)


@query
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    hits, _ = cache.split_by_cache(_questions(spark, sf), _cache(spark, sf), K, "keyword", "v1")
    return hits


@query
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    _, missed = cache.split_by_cache(_questions(spark, sf), _cache(spark, sf), K, "keyword", "v1")
    return missed


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier results: the recorded hits under the text of their question, for questions with an answer."""
    answered = table(spark, sf, "questions").where(F.col("answer").isNotNull()).select("question_id", F.trim("question").alias("query")).groupBy("query").agg(F.min("question_id").alias("question_id"))
    rows = _hits(spark, sf).join(answered, "question_id")
    return rows.select("query", F.lit(K).alias("k"), F.lit("keyword").alias("mode"), F.lit("v1").alias("index_version"), "rank", "chunk_id", F.round("score", 6).alias("score"))


@query
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    old = _cache(spark, sf)
    fresh = old.where(F.col("rank") == 0).withColumn("score", F.lit(0.0))
    return cache.upsert(old, fresh).select("query", "rank", "chunk_id", "score")


@query
def citation_format(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("question_id", "rank", citation().alias("place"))


@query
def ranked_sources_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = prompting.envelopes(_questions(spark, sf), _hits(spark, sf))
    listed = F.transform("retrieved_sources", lambda s: F.format_string("%s [%d:%d]", s["file_path"], s["first_character_index"], s["last_character_index"]))
    return rows.select("question_id", "question_str", F.array_join(listed, "; ").alias("sources"))


@query
def context_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return prompting.context_text(_hits(spark, sf)).select("question_id", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"))


@query
def last_marker_strip(spark: SparkSession, sf: str) -> DataFrame:
    """The last path part through the array form of 'everything after the last marker'."""
    parts = F.split(F.regexp_replace("path", "/", "\n/\n"), "\n")
    return table(spark, sf, "source_files").select("path", F.array_join(prompting.after_last_marker(parts, "/"), "").alias("tail")).distinct()


# --- evaluation ----------------------------------------------------------------------------------------------


@query
def span_iou(spark: SparkSession, sf: str) -> DataFrame:
    gold, hits = recall.gold_spans(_questions(spark, sf)), _hits(spark, sf)
    joined = gold.join(hits, ["question_id", "file_path"])
    overlap = iou(F.col("first_character_index"), F.col("last_character_index"), F.col("start_index"), F.col("end_index"))
    return joined.select("question_id", "gold_id", "rank", F.round(overlap, 9).alias("iou"))


@query
def gold_hit_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return recall.gold_hits(recall.gold_spans(_questions(spark, sf)), _hits(spark, sf), K).select("question_id", "gold_id", "hit")


@query
def recall_per_question(spark: SparkSession, sf: str) -> DataFrame:
    rows = recall.recall_per_question(_questions(spark, sf), _hits(spark, sf), K)
    return rows.select("question_id", "n_gold", "n_found", F.round("recall", 9).alias("recall"))


@query
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = recall.mean_recall(recall.recall_per_question(_questions(spark, sf), _hits(spark, sf), 5))
    return rows.select("n_questions", F.round("recall", 9).alias("recall"))


@query
def evaluate_multi_k(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 1, 3, 5 and 10 from one ranking."""
    rows = recall.recall_at(_questions(spark, sf), _hits(spark, sf), (1, 3, 5, 10))
    return rows.select("k", F.round("recall", 9).alias("recall"))


# --- chunking ------------------------------------------------------------------------------------------------


def _documents(spark: SparkSession, sf: str, ext: str) -> DataFrame:
    rows = _files(spark, sf).withColumn("extension", F.lower(suffix(F.col("file_path"))))
    return rows.where(F.col("extension") == ext)


@query
def chunk_python(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_documents(spark, sf, ".py")).select("file_path", "place", "start_index", "end_index", F.md5("content").alias("md5"))


@query
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_documents(_documents(spark, sf, ".md")).select("file_path", "place", "start_index", "end_index", F.md5("content").alias("md5"))
