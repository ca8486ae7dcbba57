"""The calls a user makes: index, search, answer, evaluate."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions import citation
from seamline.operators import cache as caching
from seamline.operators import chunking, fusion, lexical, prompting, recall, snapshots, vector
from seamline.sources import IndexStore, read_questions, read_results, read_tree, write_results
from seamline.sources.json_files import result_hits, result_path
from seamline.sources.store import Draft
from seamline.session import written

MODES = ("keyword", "semantic", "hybrid")


class Engine:
    """An index folder with its search calls. Models are functions: see operators.prompting."""

    def __init__(self, spark: SparkSession, index_path: str, embedder: Callable | None = None, model_name: str | None = None, dim: int = 64) -> None:
        self.spark, self.store = spark, IndexStore(spark, index_path)
        self.embedder, self.model_name, self.dim = embedder, model_name, dim

    # --- index -----------------------------------------------------------------------------------------------

    def index(self, raw: str | DataFrame, max_chunk_size: int = chunking.CHUNK_SIZE, use_embedding: bool = False, incremental: bool = False, use_keywords: bool = True) -> int:
        """Index a tree of files or a table (file_path, content, extension). Returns the number of chunks.

        Keywords, vectors or both are indexed. An incremental run re-chunks only files whose hash changed; it falls back to
        a full run where there is no earlier index, or the chunk size, the model or the kinds of index differ. All tables
        are written first and become current together, so a run that fails leaves the index as it was.
        """
        if not (use_keywords or use_embedding):
            raise ValueError("there must be keywords, vectors or both")
        documents = raw if isinstance(raw, DataFrame) else read_tree(self.spark, raw)
        if documents.isEmpty():
            raise ValueError(f"there is nothing to index{'' if isinstance(raw, DataFrame) else f' at {raw}'}")
        if isinstance(raw, DataFrame) and (left_out := chunking.unsupported(documents).count()):
            warnings.warn(f"{left_out} documents have an unsupported extension and are left out", stacklevel=2)
        meta = self.store.meta()
        hashes = snapshots.file_hashes(documents)
        same = meta.get("max_chunk_size") == max_chunk_size and self.store.has("file_hashes") and self.store.has("postings") == use_keywords
        # Vectors that exist must be of this engine's model, whether or not they are asked for.
        same = same and (meta.get("model") == self.model_name and self.embedder is not None if self.store.has("vectors") else not use_embedding)
        affected = None
        if incremental and same and self.store.has("chunks"):
            affected = snapshots.affected_paths(self.store.read("file_hashes"), hashes)
            if affected.isEmpty():
                return self.store.read("chunks").count()
        draft = self.store.draft()
        try:
            count, top = self._write(draft, documents, hashes, affected, max_chunk_size, use_keywords, use_embedding)
        except BaseException:
            draft.drop()
            raise
        draft.publish(top_id=top, max_chunk_size=max_chunk_size, model=self.model_name if "vectors" in draft.places else None)
        return count

    def _write(self, draft: Draft, documents: DataFrame, hashes: DataFrame, affected: DataFrame | None, max_chunk_size: int, use_keywords: bool, use_embedding: bool) -> tuple[int, int]:
        """All tables of a version; of an incremental one where the affected paths are given. Returns chunks and top id."""
        if affected is not None:
            old_chunks, top = self.store.read("chunks"), int(self.store.meta()["top_id"])
            fresh = chunking.chunk_documents(documents.join(affected, "file_path", "left_semi"), max_chunk_size)
            chunks = snapshots.merge_rows(old_chunks, chunking.with_chunk_ids(fresh, start=top), affected)
        else:
            chunks, top = chunking.with_chunk_ids(chunking.chunk_documents(documents, max_chunk_size)), 0
        stored = draft.write("chunks", chunks)
        row = stored.agg(F.count("*").alias("n"), F.max("chunk_id").alias("top")).first()
        if not row.n:
            raise ValueError("no document has text to index")
        if use_keywords:
            draft.write("postings", lexical.bm25_postings(stored).repartitionByRange("term").sortWithinPartitions("term", "chunk_id"))
        draft.write("file_hashes", hashes)
        if affected is not None and self.store.has("vectors"):
            kept = self.store.read("vectors").join(snapshots.kept_rows(old_chunks, affected).select("chunk_id"), "chunk_id", "left_semi")
            draft.write("vectors", kept.unionByName(self._embed(stored.where(F.col("chunk_id") > top))))
        elif use_embedding:
            draft.write("vectors", self._embed(stored))
        return row.n, max(top, row.top)

    def _embed(self, chunks: DataFrame) -> DataFrame:
        if self.embedder is None:
            raise ValueError("this engine has no embedder")
        return chunks.select("chunk_id", prompting.embed_column(self.embedder, F.col("content")).alias("embedding"))

    # --- search ----------------------------------------------------------------------------------------------

    def hits(self, questions: DataFrame, k: int = 1, mode: str = "keyword", use_cache: bool = False) -> DataFrame:
        """(question_id, rank, chunk_id, score) for all questions (question_id, question) in one plan. With the cache only
        questions that it lacks are searched, and what is found is put there."""
        k = lexical.check_k(k)
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not use_cache:
            return self._search(questions, k, mode)
        missed, cached = questions.select("question_id", "question"), None
        if self.store.has("query_cache"):
            cached, missed = caching.split_by_cache(questions, self.store.read("query_cache"), k, mode, self.store.meta()["version"])
        found = written(self._search(missed, k, mode))
        self.remember(missed, found, k, mode)
        return found if cached is None else cached.unionByName(found)

    def _search(self, questions: DataFrame, k: int, mode: str) -> DataFrame:
        by_keyword = by_vector = None
        if mode != "semantic":
            by_keyword = lexical.bm25_top_k(self.store.read("postings"), questions, k)
        if mode != "keyword":
            if self.embedder is None:
                raise ValueError("semantic search needs an embedder")
            if self.store.meta().get("model") != self.model_name:
                raise ValueError("the index was built with another model")
            asked_rows = questions.select("question_id", F.xxhash64("question_id").alias("chunk_id"), prompting.embed_column(self.embedder, F.col("question")).alias("embedding"))
            found = vector.knn_exact(asked_rows.select("chunk_id", "embedding"), self.store.read("vectors"), k, self.dim)
            by_vector = found.withColumnRenamed("question_id", "key").join(questions.select("question_id", F.xxhash64("question_id").alias("key")), "key").drop("key")
        if mode == "hybrid":
            return fusion.fuse(by_keyword, by_vector, k)
        return (by_keyword if mode == "keyword" else by_vector).select("question_id", "rank", "chunk_id", "score")

    def remember(self, questions: DataFrame, hits: DataFrame, k: int, mode: str) -> None:
        """Put the hits of these questions into the query cache."""
        version = self.store.meta()["version"]
        fresh = hits.join(questions.select("question_id", F.col("question").alias("query")), "question_id")
        fresh = fresh.select("query", F.lit(k).alias("k"), F.lit(mode).alias("mode"), F.lit(version).alias("index_version"), "rank", "chunk_id", "score").dropDuplicates([*caching.KEY, "rank"])
        table = caching.upsert(self.store.read("query_cache"), fresh) if self.store.has("query_cache") else fresh
        keep = tuple(t for t in self.store.meta()["tables"] if t != "query_cache")
        self.store.publish({"query_cache": table}, keep=keep, version=version)

    def _placed(self, hits: DataFrame) -> DataFrame:
        return hits.join(self.store.read("chunks"), "chunk_id")

    def search(self, query: str, k: int = 1, mode: str = "keyword", question_id: str = "0", use_cache: bool = False) -> list[str]:
        """Places of the k best chunks for one query, as 'path [start:end]'."""
        questions = self.spark.createDataFrame([(question_id, query)], "question_id string, question string")
        rows = self._placed(self.hits(questions, k, mode, use_cache)).orderBy("rank").select(citation().alias("place"))
        return [r.place for r in rows.take(k)]

    def search_dataset(self, dataset_path: str, save_path: str | None = None, k: int = 1, mode: str = "keyword", save_directory: str = ".", save_file: str | None = None) -> str:
        """Search all questions of a file; results go to save_path, or to save_file or the data set's name in a folder."""
        save_path = save_path or result_path(save_directory, save_file, dataset_path)
        questions = read_questions(self.spark, dataset_path)
        found = prompting.envelopes(questions, self._placed(self.hits(questions, k, mode)))
        write_results(found.join(questions.select("question_id", "pos"), "question_id"), save_path, k)
        return save_path

    # --- answers ---------------------------------------------------------------------------------------------

    def answer_rows(self, questions: DataFrame, placed: DataFrame, generator: Callable) -> DataFrame:
        """(question_id, answer) from hits with their content. A question without hits has a null answer."""
        context = prompting.context_text(placed)
        prompts = questions.join(context, "question_id", "left").select("question_id", F.to_json(prompting.chat_prompt(F.col("question"), F.col("context"))).alias("prompt"))
        return prompts.select("question_id", prompting.generate_column(generator, F.col("prompt")).alias("answer"))

    def answer(self, query: str, generator: Callable, k: int = 1, mode: str = "keyword", question_id: str = "0", save_path: str | None = None) -> str:
        questions = self.spark.createDataFrame([(question_id, query)], "question_id string, question string")
        hits = written(self._placed(self.hits(questions, k, mode)))
        if hits.isEmpty():
            raise ValueError("no chunk matches the query, so there is no context to answer from")
        answers = written(self.answer_rows(questions, hits, generator))
        if save_path:
            write_results(prompting.envelopes(questions, hits, answers), save_path, k)
        return answers.first().answer

    def answer_dataset(self, dataset_path: str, save_path: str | None = None, generator: Callable | None = None, k: int = 1, mode: str = "keyword", save_directory: str = ".") -> str:
        """Search and answer all questions of a file."""
        questions = read_questions(self.spark, dataset_path)
        return self._answer_all(questions, written(self._placed(self.hits(questions, k, mode))), save_path or result_path(save_directory, None, dataset_path), generator, k)

    def answer_results(self, results_path: str, save_path: str | None = None, generator: Callable | None = None, save_directory: str = ".") -> str:
        """Answer saved search results from the chunks they name; nothing is searched again."""
        results = written(read_results(self.spark, results_path))
        first = results.select("k").first()
        placed = result_hits(results).join(self.store.read("chunks"), ["file_path", "start_index", "end_index"])
        return self._answer_all(results.select("pos", "question_id", F.coalesce("question", "question_str").alias("question")), placed, save_path or result_path(save_directory, None, results_path), generator, int(first.k or 0) if first else 0)

    def _answer_all(self, questions: DataFrame, placed: DataFrame, save_path: str, generator: Callable | None, k: int) -> str:
        if generator is None:
            raise ValueError("answers need a generator")
        rows = prompting.envelopes(questions, placed, self.answer_rows(questions, placed, generator))
        write_results(rows.join(questions.select("question_id", "pos"), "question_id"), save_path, k)
        return save_path

    # --- evaluation ------------------------------------------------------------------------------------------

    def evaluate(self, results_path: str, dataset_path: str, k: int, on: str = "question_id") -> dict[str, str]:
        """Mean recall at k of saved results. on="pos" pairs results and questions by place instead of id."""
        k = lexical.check_k(k)
        results, questions = read_results(self.spark, results_path), read_questions(self.spark, dataset_path)
        try:
            recall.check_sizes(results.count(), questions.count())
        except ValueError:
            return {"Error": "Internal Data Mismatch"}
        if on == "pos":
            results = results.withColumn("question_id", F.col("pos").cast("string"))
            questions = questions.withColumn("question_id", F.col("pos").cast("string"))
        row = recall.mean_recall(recall.recall_per_question(questions, result_hits(results), k)).first()
        value = row.recall or 0.0
        return {"Questions": str(row.n_questions), f"Recall@{k}": f"{value:.3f} ({value * 100:.2f}%)"}
