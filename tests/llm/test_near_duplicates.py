"""Near duplicates and components against brute force."""

import random
from itertools import combinations

import pytest
import regex
from conftest import rows

from seamline.llm import near_duplicates as nd
from seamline.llm.components import components

WORDS = [f"w{i}" for i in range(300)]


def shingles(text, k):
    w = regex.findall(r"[\p{L}\p{N}_]+", text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(texts, k, least):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def corpus(seed=3):
    rng = random.Random(seed)
    texts, n = {}, 0
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randint(40, 120))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts[n] = " ".join(copy)
            n += 1
    for _ in range(30):  # exact copies
        texts[n] = texts[0].upper()
        n += 1
    texts[n], texts[n + 1], texts[n + 2] = "", "two words", "  "
    return texts


@pytest.mark.parametrize(("width", "least"), [(3, 0.6), (5, 0.8)])
def test_pairs(spark, width, least):
    texts = corpus()
    data = [(i, t, "clash") for i, t in texts.items()] + [(0, texts[0], "again"), (None, "x y z a b c", ""), (999, None, "")]
    df = spark.createDataFrame(data, "id bigint, content string, digest string")
    got = {tuple(r) for r in nd.near_pairs(df, least, width).collect()}
    expected = brute(texts, width, least)
    assert got <= expected and len(got) >= 0.98 * len(expected)
    groups = {r.id: r.group_id for r in nd.near_groups(df, least, width).collect()}
    parent = {i: i for i in groups}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert {i: find(i) for i in groups} == groups
    assert set(groups) == {i for i, t in texts.items() if shingles(t, width)}


def test_split_buckets_find_the_same(spark, monkeypatch):
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(80)]
    texts = {}
    for i in range(150):  # one group of different texts shares its buckets
        copy = list(base)
        copy[rng.randrange(80)] = f"own{i}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "id bigint, content string").repartition(2)
    whole = {tuple(r) for r in nd.near_pairs(df, 0.8, 3).collect()}
    monkeypatch.setattr(nd, "BUCKET_BLOCK", 40)
    split = {tuple(r) for r in nd.near_pairs(df, 0.8, 3).collect()}
    assert whole == split == brute(texts, 3, 0.8)
    assert {r.group_id for r in nd.near_groups(df, 0.8, 3).collect()} == {0}


def groups_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in parent}


@pytest.mark.parametrize(("signed", "block"), [(64, 2048), (10, 2048), (10, 16)])
def test_linked_groups_in_buckets_of_any_size(spark, monkeypatch, signed, block):
    """Several groups, some linked by one text between them, compared with brute force however buckets are dealt."""
    monkeypatch.setattr(nd, "SIGNED_ABOVE", signed)
    monkeypatch.setattr(nd, "BUCKET_BLOCK", block)
    monkeypatch.setattr(nd, "HELD_ROWS", 50)
    rng = random.Random(8)
    texts, n = {}, 0
    for g in range(4):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(40):
            copy = list(base)
            copy[rng.randrange(60)] = f"own{n}"
            texts[n] = " ".join(copy)
            n += 1
        if g % 2:  # a chain of texts from this group to the one before
            other = [f"g{g - 1}w{i}" for i in range(60)]
            for cut in range(3, 60, 3):
                texts[n] = " ".join(other[:cut] + base[cut:])
                n += 1
    df = spark.createDataFrame(list(texts.items()), "id bigint, content string").repartition(3)
    expected = brute(texts, 3, 0.8)
    assert {tuple(r) for r in nd.near_pairs(df, 0.8, 3).collect()} == expected
    assert {r.id: r.group_id for r in nd.near_groups(df, 0.8, 3).collect()} == groups_of(expected, texts)


def test_representatives(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "id bigint, content string")
    membership, pairs = nd.representative_pairs(df, 0.6, 3)
    stands = {r.id: r.rep for r in membership.collect()}
    got = {(r.a, r.b) for r in pairs.collect()}
    every = {tuple(r) for r in nd.near_pairs(df, 0.6, 3).collect()}
    assert got == {tuple(sorted((stands[a], stands[b]))) for a, b in every if stands[a] != stands[b]}
    assert set(stands) == {i for i, t in texts.items() if shingles(t, 3)}


def test_empty(spark):
    none = spark.createDataFrame([], "id bigint, content string")
    assert nd.near_pairs(none).count() == 0 and nd.near_groups(none).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short text of six words only")], "id bigint, content string")
    assert rows(nd.near_pairs(df)) == [(1, 2)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 1), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0
