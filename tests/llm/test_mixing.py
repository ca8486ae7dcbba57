"""Mixtures reach their shares and keep their caps."""

from collections import Counter

import pytest

from seamline.llm import mixing

pytest.importorskip("tiktoken")


def test_rates():
    for cap in (1, 2, 5):
        for mean in (0.01, 0.5, 0.99 * cap):
            assert abs(mixing.capped_mean(mixing.rate_for(mean, cap), cap) - mean) < 1e-6
        assert abs(mixing.capped_mean(mixing.rate_for(cap, cap), cap) - mixing.MOST_OF_CAP * cap) < 1e-6
    assert mixing._filled({"a": 0.5, "b": 0.5}, {"a": 10.0, "b": 1000.0}, 100.0) == {"a": 10.0, "b": 90.0}


@pytest.fixture(scope="module")
def tables(spark):
    docs = [(i, "some words here " * (1 + i % 7), "big" if i % 3 else "small" if i % 2 else "mid", "x") for i in range(3000)]
    docs += [(9001, None, "big", "x"), (None, "t", "big", "x"), (9002, "t", None, "x"), (9003, "t", "untargeted", "x"), (9004, "", "big", "x")]
    targets = [("big", 0.2, 2, 0), ("mid", 0.3, 3, 0), ("small", 0.4, 4, 0), ("absent", 0.1, 5, 0)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, source string, cdf string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int, u int")


@pytest.mark.parametrize("size", [None, "all", 5000])
def test_shares(tables, size):
    docs, targets = tables
    plan = mixing.plan_mixture(docs, targets, size=size)
    got = mixing.mixture(docs, plan).collect()
    by = {r["source"]: r for r in plan.rows}
    assert by["absent"]["reached_share"] == 0.0
    copies = Counter((r.source, r.id) for r in got)
    tokens = Counter()
    from seamline.llm.tokens import token_counts

    for r, n in zip(got, token_counts([r.text for r in got])):
        tokens[r.source] += n
    assert all(n <= by[s]["max_repeats"] for (s, _), n in copies.items())
    assert {(r.source, r.id): 0 for r in got}.keys() == copies.keys() and all(sorted(r.copy for r in got if r.id == i)[-1] == n for (_, i), n in list(copies.items())[:50])
    assert {s: tokens[s] for s in ("big", "mid", "small")} == {s: by[s]["tokens"] for s in ("big", "mid", "small")}
    if size == "all":
        assert by["small"]["tokens"] > 0.99 * 4 * by["small"]["available_tokens"] or abs(by["small"]["reached_share"] - 0.4 / 0.9) < 0.01
    if size is None:
        for s in ("big", "mid", "small"):
            assert abs(by[s]["reached_share"] - by[s]["target_share"] / 0.9) < 0.01
        assert sum(copies[k] for k in copies if k[0] == "small") > 0.99 * 4 * 500
    assert {r.source for r in got} == {"big", "mid", "small"}


def test_same_every_time_and_shuffled(tables):
    docs, targets = tables
    plan = mixing.plan_mixture(docs, targets)
    once, again = (mixing.mixture(d, plan).collect() for d in (docs, docs.repartition(7)))
    assert sorted((r.id, r.copy) for r in once) == sorted((r.id, r.copy) for r in again)
    assert [r.id for r in once] != sorted(r.id for r in once)


def test_empty(tables):
    docs, targets = tables
    plan = mixing.plan_mixture(docs.where("false"), targets)
    assert mixing.mixture(docs.where("false"), plan).count() == 0 and all(r["tokens"] == 0 for r in plan.rows)
    assert mixing.plan_mixture(docs, targets.where("false")).rows == []


def test_full_size_query(spark):
    """The rows of the mixture that p8_shares describes."""
    from seamline.llm.queries import QUERIES
    from seamline.llm.tokens import token_counts

    sf = "/root/testdata/sf0.01"
    got = QUERIES["p8_mixture"](spark, sf).collect()
    tokens = Counter()
    for r, n in zip(got, token_counts([r.text for r in got])):
        tokens[r.source] += n
    shares = {r.source: r for r in QUERIES["p8_shares"](spark, sf).collect()}
    assert tokens == {s: r.tokens for s, r in shares.items() if r.tokens}
    assert all(r.copy <= shares[r.source].max_repeats and r.reached_share == shares[r.source].reached_share for r in got)
