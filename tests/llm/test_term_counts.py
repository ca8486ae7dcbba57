"""Term and n-gram counts against a plain count."""

from collections import Counter

import pytest
import regex
from conftest import rows

from seamline.llm import term_counts

TEXTS = ["red fox red fox red", "Fox! red_1 x Żółw żółw", "", "a b c", "red fox", "数据 数据 fox", "red fox"]


def plain(texts, sigma):
    cf, df = Counter(), Counter()
    for text in texts:
        w = regex.findall(r"[\p{L}\p{N}_]{2,}", text.lower())
        grams = [" ".join(w[i : i + n]) for n in range(1, sigma + 1) for i in range(len(w) - n + 1)]
        cf.update(grams)
        df.update(set(grams))
    return {g: (cf[g], df[g]) for g in cf}


@pytest.fixture(scope="module")
def table(spark):
    data = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again", 2), (None, "no id", "", 0), (50, None, "", 0)]
    return spark.createDataFrame(data, "id bigint, content string, suffix string, cf int")


@pytest.mark.parametrize("sigma", [1, 2, 3, 5])
def test_counts(table, sigma):
    got = term_counts.ngram_counts(term_counts.distinct_records(table), sigma).collect()
    assert {r.ngram: (r.cf, r.df) for r in got if r.n} == plain(TEXTS, sigma)
    root = next(r for r in got if r.n == 0)
    assert root.df == len(TEXTS) and root.cf == sum(c for g, (c, _) in plain(TEXTS, 1).items())


def test_marks(table):
    got = {r.term: r.mark for r in term_counts.marked_terms(term_counts.distinct_records(table)).collect()}
    assert got["fox"] == "common" and got["red"] == "common" and got["żółw"] == "rare" and got["数据"] == "rare"


def test_hot_term_and_long_text(spark):
    texts = ["hot " * 50_000] + ["hot cold"] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, content string")
    got = {r.ngram: (r.cf, r.df) for r in term_counts.ngram_counts(df, 2).collect()}
    assert got["hot"] == (50_200, 201) and got["hot hot"] == (49_999, 1) and got["hot cold"] == (200, 200)


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, content string")
    assert term_counts.ngram_counts(none, 3).count() == 0 and term_counts.marked_terms(none).count() == 0


def test_stack_over_small_batches(table):
    """Prefixes stay open from one batch to the next."""
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in TEXTS]
    whole = pa.Table.from_batches(list(term_counts._local_suffixes(3)(iter(batches)))).sort_by([(f"w{k}", "descending") for k in (1, 2, 3)]).combine_chunks()
    for size in (1, 2, 5, 100):
        out = [r for b in term_counts._stack(3)(iter(whole.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {r["ngram"]: (r["cf"], r["df"]) for r in out if r["n"]} == plain(TEXTS, 3) and len(out) == len(plain(TEXTS, 3)) + 1


def test_small_flushes(table, monkeypatch):
    run = term_counts._local_suffixes(2)
    import pyarrow as pa

    monkeypatch.setattr(term_counts, "FLUSH_ROWS", 3)
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]) for t in TEXTS]
    total = Counter()
    for b in run(iter(batches)):
        for s, cf in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            total[s] += cf
    assert sum(n for s, n in total.items() if s) == sum(c for c, _ in plain(TEXTS, 1).values())
    assert rows
