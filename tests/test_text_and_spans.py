"""Column functions against plain Python."""

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from seamline.functions import STOP_WORDS, citation, inner_product, iou, is_blank, suffix, terms, usable_vector, word_count


def plain_iou(a, b):
    inter = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    union = (a[1] - a[0]) + (b[1] - b[0]) - inter
    return inter / union if union else 0.0


def test_iou(spark):
    cases = [(0, 10, 20, 30), (0, 10, 10, 20), (0, 10, 0, 10), (5, 5, 5, 5), (0, 100, 90, 2090), (0, 100, 0, 2000), (0, 1, 0, 20)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a bigint, b bigint, c bigint, d bigint")
    got = {r.i: r.v for r in df.select("i", iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("v")).collect()}
    for i, (a, b, c, d) in enumerate(cases):
        assert math.isclose(got[i], plain_iou((a, b), (c, d)), abs_tol=1e-12)
    assert got[6] == 0.05


def test_iou_of_nulls_is_zero(spark):
    df = spark.createDataFrame([(None, 1, 0, 1), (0, None, 0, 1)], "a bigint, b bigint, c bigint, d bigint")
    assert rows(df.select(iou(F.col("a"), F.col("b"), F.col("c"), F.col("d")))) == [(0.0,), (0.0,)]


def test_terms(spark):
    texts = ["The Cat_9 sat ON x äÖ", "", None, "a b c", "naïve Γειά 数据"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.w) for r in df.select("i", terms(F.col("t")).alias("w")).collect()}
    assert got == {0: ["cat_9", "sat", "äö"], 1: [], 2: [], 3: [], 4: ["naïve", "γειά", "数据"]}
    assert len(STOP_WORDS) == 33 or "the" in STOP_WORDS


@pytest.mark.parametrize("text", ["", " ", "\t\n\r", "\u00a0", "\u2003\u3000", "\x1c", "\x85"])
def test_blank(spark, text):
    assert not text.strip()
    df = spark.createDataFrame([(text,), (text + "x",), (None,)], "t string")
    assert [r[0] for r in df.select(is_blank(F.col("t"))).collect()] == [True, False, True]


def test_suffix_citation_and_words(spark):
    df = spark.createDataFrame([("a/b.py", 1, 5, " two  words "), ("a.d/.py", 0, 1, ""), ("x/U.PY", 0, 1, None), ("n", 0, 1, "one")], "file_path string, start_index bigint, end_index bigint, t string")
    got = df.select(suffix(F.col("file_path")), citation(), word_count(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(".py", "a/b.py [1:5]", 2), ("", "a.d/.py [0:1]", 0), (".PY", "x/U.PY [0:1]", 0), ("", "n [0:1]", 1)]


def test_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0])], "i int, v array<float>")
    assert [r.i for r in df.where(usable_vector(F.col("v"), 2)).collect()] == [0]
    assert df.where("i = 0").select(inner_product(F.col("v"), F.col("v"))).first()[0] == 5.0
