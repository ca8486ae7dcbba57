"""A mixture of sources with target shares by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.tokens import VOCABULARY, token_counts
from seamline.llm.words import blocks
from seamline.session import written

SEED = 2024
GRID = 65
ROUNDS = 3
#: The part of max_repeats that the mean count of a source can reach. Counts stay Poisson, cut off at the cap: at this
#: part and a cap of 4 the rate is 10.7, and one record in 44,000 is not drawn; at a cap of 1 one in 500.
MOST_OF_CAP = 0.998


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key: the same in every run and on every machine."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / float(1 << 53)


def steps(rate: float, cap: int) -> list[float]:
    """Cumulative Poisson probabilities of 0 .. cap - 1: a record with uniform u is taken once for each step <= u."""
    out, p, total = [], math.exp(-rate), 0.0
    for k in range(cap):
        total += p
        out.append(total)
        p *= rate / (k + 1)
    return out


def capped_mean(rate: float, cap: int) -> float:
    """The mean of a Poisson count cut off at cap."""
    return sum(1.0 - s for s in steps(rate, cap))


def rate_for(mean: float, cap: int) -> float:
    """The Poisson rate whose count, cut off at cap, has the given mean, at most MOST_OF_CAP of the cap."""
    mean = min(mean, MOST_OF_CAP * cap)
    low, high = 0.0, 1.0
    while capped_mean(high, cap) < mean:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if capped_mean(middle, cap) < mean else (low, middle)
    return high


def _token_rows(vocabulary: str):
    schema = pa.schema([("source", pa.string()), ("u", pa.float64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(token_counts(texts, vocabulary), pa.int64())], schema=schema)

    return run


def _totals(grids: dict[str, list[list[float]]]):
    """Tokens that each rate of a grid would take, per source and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {s: np.zeros(len(g)) for s, g in grids.items()}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            u, n = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for s, grid in grids.items():
                mine = names == s
                if mine.any():
                    order = np.argsort(u[mine])
                    sorted_u, tail = u[mine][order], np.concatenate([np.cumsum(n[mine][order][::-1])[::-1], [0]])
                    for i, cdf in enumerate(grid):
                        sums[s][i] += tail[np.searchsorted(sorted_u, cdf, "left")].sum()
        rows = [(s, i, t) for s, totals in sums.items() for i, t in enumerate(totals.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["source", "i", "total"])

    return run


def _filled(share: dict[str, float], most: dict[str, float], size: float) -> dict[str, float]:
    """Tokens per source: proportional to the shares, none above its most."""
    goal: dict[str, float] = {}
    left = set(share)
    while left:
        room = size - sum(goal.values())
        scale = sum(share[s] for s in left)
        over = {s for s in left if room * share[s] / scale >= most[s]}
        for s in over or left:
            goal[s] = most[s] if over else room * share[s] / scale
        left -= over or left
    return goal


class Plan:
    """Rates and shares per source."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows = rows

    def frame(self, like: DataFrame) -> DataFrame:
        schema = "source string, target_share double, reached_share double, tokens bigint, available_tokens bigint, max_repeats int, rate double, cdf array<double>"
        return like.sparkSession.createDataFrame([tuple(r[k] for k in ("source", "target_share", "reached_share", "tokens", "available_tokens", "max_repeats", "rate", "cdf")) for r in self.rows], schema)


def plan_mixture(records: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY, seed: int = SEED, size: float | str | None = "all") -> Plan:
    """Poisson rates with which each source holds its target share of all tokens.

    targets (source, target_share, max_repeats) is a table of settings and is read whole; its shares are scaled to
    1 over the sources that have tokens. The mixture has as many tokens as the collection (size "all") or as `size`
    says: a source whose cap is reached stays below its share and the others fill the rest by theirs. With size None
    every share is kept, so the scarcest source, taken to its cap, bounds the mixture. Every source is Poisson: rates
    start at those whose capped mean is right and are then fitted to the tokens that the hash-seeded counts really
    take: totals of a grid of rates are summed in one pass over the counts, three times.
    """
    known = targets.select("source")
    rows = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(source_col).cast("string").alias("source"), uniform(F.col(id_col), seed).alias("u"), F.col(text_col).alias("text"))
    counted = written(rows.join(F.broadcast(known), "source", "left_semi").select("source", "u", "text").mapInArrow(_token_rows(vocabulary), "source string, u double, n_tokens bigint"))
    have = {r.source: int(r.n) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per target
    wanted = [r.asDict() for r in targets.select("source", "target_share", "max_repeats").distinct().orderBy("source").collect()]
    live = [t for t in wanted if have.get(t["source"], 0) > 0 and (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0]
    scale = sum(t["target_share"] for t in live)
    if size is None:
        size = min((MOST_OF_CAP * have[t["source"]] * t["max_repeats"] * scale / t["target_share"] for t in live), default=0.0)
        goal = {t["source"]: size * t["target_share"] / scale for t in live}
    else:
        goal = _filled({t["source"]: t["target_share"] for t in live}, {t["source"]: MOST_OF_CAP * have[t["source"]] * t["max_repeats"] for t in live}, float(sum(have.values()) if size == "all" else size))
    cap = {t["source"]: int(t["max_repeats"]) for t in live}
    rate = {s: rate_for(goal[s] / have[s], cap[s]) for s in goal}
    reached: dict[str, float] = {}
    span = {s: (rate[s] * 0.5, rate[s] * 1.5) for s in goal}
    for _ in range(ROUNDS if goal else 0):
        grid = {s: np.linspace(*span[s], GRID) for s in goal}
        cdfs = {s: [steps(float(x), cap[s]) for x in grid[s]] for s in goal}
        sums = counted.mapInArrow(_totals(cdfs), "source string, i bigint, total double").groupBy("source", "i").agg(F.sum("total").alias("total"))
        got = {(r.source, r.i): r.total for r in sums.collect()}  # GRID rows per target
        for s in goal:
            totals = np.array([got[s, i] for i in range(GRID)])
            best = int(np.argmin(np.abs(totals - goal[s])))
            rate[s], reached[s] = float(grid[s][best]), float(totals[best])
            span[s] = (float(grid[s][max(0, best - 1)]), float(grid[s][min(GRID - 1, best + 1)]))
    total = sum(reached.values())
    out = []
    for t in wanted:
        s = t["source"]
        on = s in goal
        out.append(
            {
                "source": s, "target_share": t["target_share"], "reached_share": reached[s] / total if on and total else 0.0, "tokens": int(reached[s]) if on else 0,
                "available_tokens": have.get(s, 0), "max_repeats": t["max_repeats"], "rate": rate[s] if on else 0.0, "cdf": steps(rate[s], cap[s]) if on else [],
            }
        )
    return Plan(out)


def mixture(records: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, copy, source, text, target_share, reached_share) in random order, copies numbered from 1.

    The count of a record is the inverse of the Poisson distribution of its source at the record's own uniform
    number, so it depends on nothing but id, seed and rate and never exceeds max_repeats. Records without id, text
    or a target take no part. Rows are spread over tasks by a hash of id and copy and sorted by it.
    """
    rates = plan.frame(records).select("source", "cdf", "target_share", "reached_share")
    rows = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), uniform(F.col(id_col), seed).alias("u"))
    joined = rows.join(F.broadcast(rates), "source")
    times = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    copies = joined.withColumn("times", times).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    placed = copies.withColumn("place", F.xxhash64(F.lit(seed + 1), "id", "copy"))
    return placed.repartition("place").sortWithinPartitions("place").select("id", "copy", "source", "text", "target_share", "reached_share")
