"""Containers hold everything once and nothing too much."""

from collections import defaultdict

import pytest

from seamline.llm import containers
from seamline.llm.tokens import VOCABULARY, encoder, token_counts

pytest.importorskip("tiktoken")


def test_windows_place_best_fit_and_emit_the_fullest():
    store = containers.Windows(10, 2, 0)
    assert list(store.place(("a",), 6)) == [] and list(store.place(("b",), 7)) == []
    assert list(store.place(("c",), 3)) == [(1, [("b",), ("c",)])]  # exactly full
    assert list(store.place(("d",), 5)) == []
    assert list(store.place(("e",), 6)) == [(0, [("a",)])]  # the fullest makes room
    assert [c for c, _ in store.rest()] == [3, 2]


def test_table(spark):
    texts = [f"word{i} " * (i % 31) for i in range(400)] + ["", "long " * 3000, None]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x"), (3, texts[3], "again")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, piece string").repartition(5, "doc_id")
    got = containers.fill_containers(df, capacity=256, windows=4).collect()
    fill, spans = defaultdict(int), defaultdict(list)
    for r in got:
        fill[r.container_id] += r.token_end - r.token_start
        spans[r.id].append((r.piece, r.token_start, r.token_end))
    assert max(fill.values()) <= 256
    for i, n in enumerate(token_counts([t or "" for t in texts])):
        if texts[i] is None:
            assert i not in spans
            continue
        mine = sorted(set(spans[i]))
        assert mine[0][1] == 0 and mine[-1][2] == n and all(a[2] == b[1] for a, b in zip(mine, mine[1:]))
        assert len(mine) == max(1, -(-n // 256))
    assert len(spans[3]) == 2  # a repeated row is an item of its own
    assert sum(fill.values()) / (256 * len(fill)) > 0.95
    assert containers.fill_containers(df.where("false")).count() == 0


def test_leftovers_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(containers, "FAN_IN", 2)
    df = spark.createDataFrame([(i, "tok " * (1 + i % 30)) for i in range(600)], "doc_id bigint, text string").repartition(8, "doc_id")
    got = containers.fill_containers(df, capacity=64, windows=8)
    assert got.count() == 600 and got.select("id").distinct().count() == 600
    report = containers.fill_report(got, 64).first()
    assert report.items == 600 and report.filled > 0.9


@pytest.mark.parametrize("fan_in", [2, 16])
def test_empty_texts_end(spark, monkeypatch, fan_in):
    monkeypatch.setattr(containers, "FAN_IN", fan_in)
    df = spark.range(50_000).selectExpr("id AS doc_id", "IF(id % 5000 = 7, 'one', '') AS text").repartition(6)
    got = containers.fill_containers(df, windows=2)
    assert got.select("id").distinct().count() == 50_000 == got.count()
    sizes = [r.n for r in got.groupBy("container_id").agg({"id": "count"}).toDF("c", "n").collect()]
    assert max(sizes) <= containers.CAPACITY and len(sizes) <= 26


def test_encoder_round_trip():
    e = encoder(VOCABULARY)
    for text in ("Hello wörld, 数据 😀", "", " \n\t", "x" * 10_000):
        assert e.decode(e.encode_ordinary(text)) == text
