"""Recall and upkeep of tables on hand-made cases."""

from conftest import rows
from pyspark.sql import functions as F

from seamline.operators import cache, recall, snapshots

SPAN = "array<struct<file_path:string,first_character_index:bigint,last_character_index:bigint>>"


def questions(spark):
    return spark.createDataFrame(
        [("q1", [("f", 0, 100), ("f", 500, 600)]), ("q1", [("f", 0, 100), ("f", 500, 600)]), ("q2", []), ("q3", None), ("q4", [("g", 0, 50)])], f"question_id string, sources {SPAN}"
    )


def hits(spark):
    return spark.createDataFrame([("q1", 0, "f", 90, 2090), ("q1", 1, "f", 95, 100), ("q1", 2, "f", 500, 600), ("q4", 0, "f", 0, 50), ("q4", 1, "g", 0, 2000)], "question_id string, rank int, file_path string, start_index bigint, end_index bigint")


def test_recall(spark):
    per = {r.question_id: (r.n_gold, r.n_found, r.recall) for r in recall.recall_per_question(questions(spark), hits(spark), 2).collect()}
    # 90..2090 covers a gold of 100 characters too thinly; 95..100 covers just a twentieth.
    assert per == {"q1": (2, 1 + 0 + (1 if 100 / 2000 >= 0.05 else 0), 1.0), "q2": (0, 0, 0.0), "q3": (0, 0, 0.0), "q4": (1, 0, 0.0)}
    mean = recall.mean_recall(recall.recall_per_question(questions(spark), hits(spark), 2)).first()
    assert mean.n_questions == 4 and mean.recall == 0.25
    nobody = questions(spark).where("false")
    assert recall.mean_recall(recall.recall_per_question(nobody, hits(spark), 2)).first().recall is None


def test_recall_grows_with_k(spark):
    values = [recall.mean_recall(recall.recall_per_question(questions(spark), hits(spark), k)).first().recall for k in (1, 2, 3)]
    assert values == sorted(values)


def test_snapshot_difference(spark):
    old = spark.createDataFrame([("same", "1"), ("changed", "2"), ("gone", "3"), ("nohash", None)], "file_path string, content_md5 string")
    new = spark.createDataFrame([("same", "1", True), ("changed", "9", True), ("added", "4", True), ("nohash", None, True)], "file_path string, content_md5 string, known boolean")
    assert rows(snapshots.changed_paths(old, new)) == [("added",), ("changed",)]
    assert rows(snapshots.deleted_paths(old, new)) == [("gone",)]
    affected = snapshots.affected_paths(old, new)
    kept = spark.createDataFrame([(1, "same"), (2, "changed"), (3, "gone"), (4, None)], "chunk_id bigint, file_path string")
    assert rows(snapshots.kept_rows(kept, affected), "chunk_id") == [(1,), (4,)]
    assert rows(snapshots.removed_rows(kept, affected), "chunk_id") == [(2,), (3,)]
    assert snapshots.affected_paths(old.where("false"), new.where("false")).count() == 0


def test_latest_files(spark):
    df = spark.sql("select * from values ('a', 'old', timestamp'2024-01-01'), ('a', 'new', timestamp'2024-02-01'), ('b', null, timestamp'2024-01-01'), (null, 'x', timestamp'2024-01-01') as t(path, content, loaded_at)")
    assert rows(snapshots.latest_files(df)) == [("a", "new"), ("b", None)]


def test_ids_follow_paths(spark):
    data = [(f"p{i % 7}", i, f"c{i}", "x") for i in range(50)]
    top = spark.createDataFrame([(100,)], "top bigint")
    got = snapshots.assign_ids(spark.createDataFrame(data, "file_path string, start_index int, content string, n string"), top).collect()
    order = sorted(got, key=lambda r: (r.file_path, r.start_index))
    assert [r.chunk_id for r in order] == list(range(101, 151))
    assert {r.n for r in got} == {"x"}


def test_cache(spark):
    schema = "query string, k int, mode string, index_version string, rank int, chunk_id bigint, score double"
    table = spark.createDataFrame([("x", 2, "hybrid", "v1", 0, 7, 1.0), ("x", 2, "hybrid", "v1", 1, 8, 0.5), ("x", 3, "hybrid", "v1", 0, 9, 1.0)], schema)
    asked = spark.createDataFrame([("q1", "x"), ("q2", "y")], "question_id string, question string")
    found, missed = cache.split_by_cache(asked, table, 2, "hybrid", "v1")
    assert rows(found) == [("q1", 0, 7, 1.0), ("q1", 1, 8, 0.5)] and rows(missed) == [("q2", "y")]
    assert cache.split_by_cache(asked, table, 2, "hybrid", "v2")[0].count() == 0
    fresh = table.where("k = 2 and rank = 0").withColumn("chunk_id", F.lit(70).cast("bigint"))
    assert rows(cache.upsert(table, fresh), "k", "chunk_id") == [(2, 70), (3, 9)]
