"""BM25, exact neighbours and fusion against plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from seamline.operators import fusion, lexical, vector

DOCS = {1: "red fox jumps over red fence", 2: "green fox sleeps", 3: "blue whale", 4: "red red red", 5: "", 6: "green fox sleeps"}
ASKED = {"q1": "red fox", "q2": "whale whale fox", "q3": "the of", "q4": "unknownword"}


def plain_bm25(docs, query, k1=1.5, b=0.5):
    split = {i: t.split() for i, t in docs.items()}
    split = {i: [w for w in ws if w not in lexical.terms.__globals__["STOP_WORDS"]] for i, ws in split.items()}
    n, avg = len(split), sum(map(len, split.values())) / len(split)
    df = Counter(w for ws in split.values() for w in set(ws))
    out = {}
    for i, ws in split.items():
        tf = Counter(ws)
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (k1 * (1 - b + b * len(ws) / avg) + tf[w]) for w in query.split() if tf[w])
        if s > 0:
            out[i] = s
    return sorted(((round(s, 6), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


@pytest.fixture(scope="module")
def chunks(spark):
    data = [(i, t, "junk") for i, t in DOCS.items()] + [(1, DOCS[1], "again"), (None, "no id", "x"), (9, None, "x")]
    return spark.createDataFrame(data, "id bigint, content string, term string")


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([*ASKED.items(), ("q5", None)], "question_id string, question string")


def test_bm25(chunks, questions):
    got = lexical.bm25_search(lexical.distinct_chunks(chunks), questions, 3).collect()
    for q, text in ASKED.items():
        mine = sorted((r.rank, r.chunk_id, r.score) for r in got if r.question_id == q)
        assert mine == [(k, i, s) for k, (s, i) in enumerate(plain_bm25(DOCS, text)[:3])]
    assert not [r for r in got if r.question_id in ("q3", "q4", "q5")]


@pytest.mark.parametrize("indexed", [False, True])
def test_more_questions_than_are_sent_at_a_time(spark, monkeypatch, indexed):
    """Searched in parts with the same results; what is ranked does not grow with questions times chunks."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(30)]
    docs = {i: " ".join(rng.choice(words, int(rng.integers(1, 12)))) for i in range(600)} | {i + 600: "word1 word2" for i in range(300)}
    asked = {f"q{i}": " ".join(rng.choice(words, 4)) for i in range(12)} | {"same": "word2 word1", "again": "word1, word2"}
    chunks = lexical.distinct_chunks(spark.createDataFrame(list(docs.items()), "id bigint, content string"))
    ranked, rank = [], lexical.top_k
    monkeypatch.setattr(lexical, "MOST_QUESTIONS", 5)
    monkeypatch.setattr(lexical, "top_k", lambda scores, *a: ranked.append(scores.count()) or rank(scores, *a))
    questions = spark.createDataFrame(list(asked.items()), "question_id string, question string")
    got = lexical.bm25_search(chunks, questions, 3, postings=lexical.bm25_postings(chunks) if indexed else None).collect()
    for q, text in asked.items():
        mine = sorted((r.rank, r.chunk_id, r.score) for r in got if r.question_id == q)
        assert mine == [(k, i, s) for k, (s, i) in enumerate(plain_bm25(docs, text.replace(",", ""))[:3])]
    assert sum(ranked) < 1500  # 9,000 pairs of questions and chunks share a term


def test_ties_go_to_the_smaller_id(chunks, questions):
    got = lexical.bm25_search(lexical.distinct_chunks(chunks), questions.where("question_id = 'q2'"), 10).collect()
    order = [r.chunk_id for r in sorted(got, key=lambda r: r.rank)]
    assert order.index(2) + 1 == order.index(6)


def test_padding(chunks, questions):
    got = lexical.bm25_search(lexical.distinct_chunks(chunks), questions, 4, pad_to_k=True)
    assert {r.question_id: r.n for r in got.groupBy("question_id").agg(F.count("*").alias("n")).collect()} == {q: 4 for q in (*ASKED, "q5")}
    assert rows(got.where("question_id = 'q4'"), "rank", "chunk_id", "score") == [(0, 1, 0.0), (1, 2, 0.0), (2, 3, 0.0), (3, 4, 0.0)]


def test_k_is_checked(chunks, questions):
    with pytest.raises(TypeError):
        lexical.bm25_search(chunks, questions, "abc")
    with pytest.raises(ValueError):
        lexical.bm25_search(chunks, questions, 0)


def test_empty_tables(spark, questions):
    none = spark.createDataFrame([], "id bigint, content string")
    assert lexical.bm25_search(lexical.distinct_chunks(none), questions, 3).count() == 0
    stats = lexical.corpus_stats(lexical.distinct_chunks(none)).first()
    assert (stats.n_chunks, stats.avgdl) == (0, None)


def test_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((700, 8)).astype("f4")
    table = [(i, v.tolist(), "x") for i, v in enumerate(data)] + [(3, data[3].tolist(), "again"), (900, None, ""), (901, [0.0] * 8, ""), (902, [1.0], "")]
    vectors = vector.usable(spark.createDataFrame(table, "chunk_id bigint, embedding array<float>, score string"), 8)
    assert vectors.count() == 700
    got = vector.knn_exact(vectors.where("chunk_id % 50 = 0"), vectors, 5, 8).collect()
    scores = np.round(data.astype("f8") @ data.astype("f8").T, 6)
    for q in range(0, 700, 50):
        best = sorted(range(700), key=lambda i: (-scores[q, i], i))[:5]
        assert [r.chunk_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.rank)] == best
    empty = vectors.where("false")
    assert vector.knn_exact(empty, vectors, 5, 8).count() == 0 and vector.knn_exact(vectors, empty, 5, 8).count() == 0


def test_fusion(spark):
    schema = "question_id string, rank int, chunk_id bigint"
    first = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 3), ("b", 0, 1), ("b", 1, 2)], schema)
    second = spark.createDataFrame([("a", 0, 4), ("a", 1, 1), ("a", 2, 3), ("b", 0, 3), ("b", 1, 4)], schema)
    got = fusion.fuse(first, second, 4).collect()
    order = lambda q: [r.chunk_id for r in sorted((r for r in got if r.question_id == q), key=lambda r: r.rank)]
    assert order("a") == [1, 3, 4, 2] and order("b") == [1, 3, 2, 4]
    assert rows(fusion.fuse(first, second.where("false"), 1), "question_id", "chunk_id") == [("a", 1), ("b", 1)]


def test_hybrid_query_moves_no_postings(spark, monkeypatch, tmp_path):
    """Keyword hits of more questions than are sent at a time, fused with recorded ones; neither postings nor pairs are shuffled."""
    from seamline.plans.queries import QUERIES

    spark.createDataFrame([(i, t, f"f{i}", 0, len(t)) for i, t in DOCS.items()], "id bigint, content string, file_path string, start_index bigint, end_index bigint").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([(q, t, []) for q, t in ASKED.items()], "question_id string, question string, sources array<struct<file_path:string>>").write.parquet(str(tmp_path / "questions.parquet"))
    spark.createDataFrame([("q1", 0, 3, 1.0), ("q4", 0, 2, 1.0)], "question_id string, hit_rank int, chunk_id bigint, score double").write.parquet(str(tmp_path / "search_hits.parquet"))
    monkeypatch.setattr(lexical, "MOST_QUESTIONS", 1)
    monkeypatch.setattr(lexical, "bm25_postings", lambda *_: 1 / 0)
    got = rows(QUERIES["hybrid_rrf_topk"](spark, str(tmp_path)), "question_id", "rank", "chunk_id")
    best = {q: [i for _, i in plain_bm25(DOCS, t)] for q, t in ASKED.items()}
    order = {**best, "q1": [best["q1"][0], 3, *best["q1"][1:]], "q4": [2]}
    assert got == sorted((q, k, i) for q, ids in order.items() for k, i in enumerate(ids))


@pytest.mark.parametrize("marks", [64, 1 << 24])
def test_only_texts_of_repeated_ids_are_moved(spark, monkeypatch, marks):
    monkeypatch.setattr(lexical, "MARKS", marks)
    data = [(i * 977 - 5, f"text {i}") for i in range(300)] + [(-5, "other"), (-5, "text 0"), (972, None), (None, "x"), (None, "y"), (7, None), (8, "a"), (8, "a")]
    chunks = spark.createDataFrame(data, "id bigint, content string")
    assert rows(lexical.distinct_chunks_in_place(chunks)) == rows(lexical.distinct_chunks(chunks))
    marked = lexical.marked_rows(chunks.where("id is not null and content is not null"), "id")
    assert rows(marked.where("several"), "id", "content") == sorted([(-5, "text 0"), (-5, "other"), (-5, "text 0"), (8, "a"), (8, "a")], key=repr) or marks == 64
    assert lexical.distinct_chunks_in_place(chunks.where("false")).count() == 0


def test_pairs_grow_with_the_questions_and_not_with_the_tasks(spark, monkeypatch):
    docs = {i: f"word{i % 7} word{i % 11} word{i % 13}" for i in range(3000)}
    asked = {f"q{i}": f"word{i} word{i + 1}" for i in range(12)}
    ranked, rank = [], lexical.top_k
    monkeypatch.setattr(lexical, "top_k", lambda scores, *a: ranked.append(scores.count()) or rank(scores, *a))
    monkeypatch.setattr(lexical, "PAIRS_PER_CHUNK", 0.01, raising=False)
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id bigint, content string").repartition(40)
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # a task for each file
    try:
        got = lexical.bm25_search(chunks, spark.createDataFrame(list(asked.items()), "question_id string, question string"), 3).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(ranked) <= cores * 2 * 3 * len(asked)
    for q, text in asked.items():
        assert sorted((r.rank, r.chunk_id, r.score) for r in got if r.question_id == q) == [(k, i, s) for k, (s, i) in enumerate(plain_bm25(docs, text)[:3])]
