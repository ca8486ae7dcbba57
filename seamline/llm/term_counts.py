"""Counts of every term and term sequence by sorted suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.words import Words, blocks, mix
from seamline.session import written

#: Suffixes gathered in a task before they are passed on; bounds its memory.
FLUSH_ROWS = 400_000
#: Terms in a suffix where single terms are asked for: counts of terms come out of the sums of longer suffixes.
SIGMA = 2
RARE_BELOW = 3
COMMON_SHARE = 0.4


def _suffix_arrays(words: Words, sigma: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, length, new) of every truncated suffix of the texts.

    new[i, n - 1] tells whether the suffix is the first one of its text with that prefix of n terms: in the sorted
    list of the text's own suffixes, the prefix reaches beyond what is shared with the suffix before. Sums of
    these marks are document frequencies, so no set of records is ever held.
    """
    n, h, text = len(words.hashes), words.hashes, words.text_of
    terms = np.zeros((sigma, n), np.uint64)
    length = np.zeros(n, np.int64)
    for k in range(sigma):
        ok = np.zeros(n, bool)
        ok[: n - k] = text[: n - k] == text[k:]
        terms[k, : n - k] = np.where(ok[: n - k], h[k:], 0)
        length += ok
    order = np.lexsort((*terms[::-1], text))
    same = np.zeros(n, bool)
    same[1:] = text[order][1:] == text[order][:-1]
    new = np.zeros((n, sigma), np.int64)
    for k in range(sigma):
        t = terms[k][order]
        same[1:] &= (t[1:] == t[:-1]) & (t[1:] != 0)
        new[order, k] = ~same & (length[order] > k)
    key = np.zeros(n, np.uint64)
    for k in range(sigma):
        key = mix(key + terms[k] + np.uint64(k + 1))
    return key, np.arange(n), length, new


def _combine(key: np.ndarray, cf: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    k = key[order]
    edge = np.ones(len(k), bool)
    edge[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(edge)
    return k[at], order[at], np.add.reduceat(cf[order], at), np.add.reduceat(new[order], at, axis=0)


def _columns(sigma: int) -> tuple[pa.Schema, str]:
    """Suffixes as rows: their terms (empty where there are fewer), occurrences, and for each length the records in which
    the prefix of that length is new."""
    fields = [*((f"w{k}", pa.string()) for k in range(1, sigma + 1)), ("cf", pa.int64()), *((f"d{k}", pa.int64()) for k in range(1, sigma + 1))]
    return pa.schema(fields), ", ".join(f"{name} {'string' if kind == pa.string() else 'bigint'}" for name, kind in fields)


def _local_suffixes(sigma: int):
    schema, _ = _columns(sigma)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, str] = {0: ""}
        parts: list[tuple[np.ndarray, ...]] = []  # key, cf, new, hashes of the terms
        held = records = occurrences = 0

        def combined() -> tuple[np.ndarray, ...]:
            key, cf, new, terms = (np.concatenate(x) for x in zip(*parts, strict=True))
            k, at, cf, new = _combine(key, cf, new)
            return k, cf, new, terms[at]

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                _, cf, new, terms = combined()
                known, place = np.unique(terms, return_inverse=True)
                texts = pa.array([names[h] for h in known.tolist()], pa.string())
                place = place.reshape(terms.shape)
                for at in range(0, len(cf), 50_000):
                    cut = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([*(texts.take(pa.array(place[cut, k])) for k in range(sigma)), pa.array(cf[cut]), *(pa.array(np.ascontiguousarray(new[cut, k])) for k in range(sigma))], schema=schema)
            parts.clear()
            names.clear()
            names[0] = ""

        for _, texts in blocks(batches, 0):
            records += len(texts)
            words = Words(texts, least=2)
            if not len(words.hashes):
                continue
            occurrences += len(words.hashes)
            key, first, length, new = _suffix_arrays(words, sigma)
            k, at, cf, seen = _combine(key, np.ones(len(key), np.int64), new)
            terms = np.zeros((len(at), sigma), np.uint64)
            for j in range(sigma):
                there = length[at] > j
                terms[there, j] = words.hashes[at[there] + j]
            one, where = np.unique(words.hashes, return_index=True)
            for h, i in zip(one.tolist(), where.tolist(), strict=True):
                if h not in names:
                    names[h] = words.word(i)
            parts.append((k, cf, seen, terms))
            held += len(k)
            if len(parts) > 1 and held > FLUSH_ROWS:
                parts[:] = [combined()]
                held = len(parts[0][0])
                if held > FLUSH_ROWS // 2:
                    yield from flush()
                    held = 0
        yield from flush()
        # The root of all suffixes, the empty prefix: total length and number of records.
        yield pa.RecordBatch.from_arrays([*(pa.array([""]) for _ in range(sigma)), pa.array([occurrences], pa.int64()), *(pa.array([records], pa.int64()) for _ in range(sigma))], schema=schema)

    return run


def _stack(sigma: int):
    """Aggregate suffixes in reverse lexicographic order: a prefix is complete when a suffix without it arrives.

    The stack holds the open prefixes, one of each length, with their sums; the suffixes of a batch are summed up
    between the places where a prefix changes, and only what is open at its end stays on the stack.
    """
    schema = pa.schema([("ngram", pa.string()), ("n", pa.int32()), ("cf", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[list[str], int, int] | None] = [None] * (sigma + 1)  # by length: terms, cf, df

        def done(n: int, grams: pa.Array, cf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(cf), n, np.int32)), pa.array(cf), pa.array(df)], schema=schema)

        def close(n: int) -> Iterator[pa.RecordBatch]:
            if stack[n] is not None:
                terms, cf, df = stack[n]
                stack[n] = None
                if n or df:  # no records, no row
                    yield done(n, pa.array([" ".join(terms)]), np.array([cf]), np.array([df]))

        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            words = [batch.column(k) for k in range(sigma)]
            cf = batch.column(sigma).to_numpy(zero_copy_only=False)
            changed = np.zeros(rows, bool)
            for n in range(sigma + 1):
                if n:
                    w = words[n - 1]
                    changed[1:] |= pa.compute.not_equal(w.slice(1), w.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
                    inside = pa.compute.not_equal(w, "").to_numpy(zero_copy_only=False)
                else:
                    inside = pa.compute.equal(words[0], "").to_numpy(zero_copy_only=False)
                df = batch.column(sigma + max(n, 1)).to_numpy(zero_copy_only=False)
                begins = changed | (np.arange(rows) == 0)
                begins[1:] |= ~inside[:-1]
                at = np.flatnonzero(inside & begins)
                if not len(at):
                    yield from close(n)
                    continue
                # Rows of a group follow each other and are all long enough, but for shorter ones at its end.
                sums_c, sums_d = (np.add.reduceat(np.where(inside, x, 0), at) for x in (cf, df))
                first = [words[k][0].as_py() for k in range(n)]
                if stack[n] is not None and at[0] == 0 and stack[n][0] == first:
                    sums_c[0] += stack[n][1]
                    sums_d[0] += stack[n][2]
                    stack[n] = None
                yield from close(n)
                end = [words[k][int(at[-1])].as_py() for k in range(n)]
                stack[n] = (end, int(sums_c[-1]), int(sums_d[-1]))
                if len(at) > 1:
                    take = pa.array(at[:-1])
                    grams = pa.compute.binary_join_element_wise(*(words[k].take(take) for k in range(n)), " ") if n > 1 else words[0].take(take)
                    yield done(n, grams, sums_c[:-1], sums_d[:-1])
        for n in range(sigma + 1):
            yield from close(n)

    return run


def ngram_counts(records: DataFrame, sigma: int = 1, text_col: str = "content") -> DataFrame:
    """(ngram, n, cf, df) of all sequences of up to sigma terms: occurrences, and records that hold them.

    records: one row per record; a null text counts as an empty record, extra columns are ignored, an empty table
    gives no rows. The row with n = 0 is the empty sequence: cf is the number of all terms, df that of all records.
    A term is a run of two or more letters, numbers or underscores of the lower-cased text; its terms are joined
    by a space, and sequences do not cross records.

    Suffix-sorted counting: each task combines its truncated suffixes, suffixes are routed by their first terms,
    sorted in reverse lexicographic order and summed up on a stack. Routing takes the first two terms, so that a
    frequent first term spreads over tasks; the counts of single terms are summed once more at the end.
    """
    names = [f"w{k}" for k in range(1, sigma + 1)]
    local = records.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_local_suffixes(sigma), _columns(sigma)[1])
    routed = local.repartition(*names[:2]).sortWithinPartitions(*(F.desc(w) for w in names))
    counted = routed.mapInArrow(_stack(sigma), "ngram string, n int, cf bigint, df bigint")
    if sigma == 1:
        return counted
    merged = counted.where(F.col("n") <= 1).groupBy("ngram", "n").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    return counted.where(F.col("n") > 1).unionByName(merged)


def distinct_records(rows: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, content): one row per id with text; of differing copies the one kept is not defined beyond being one of them."""
    return rows.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("content")).dropDuplicates(["id"])


def marked_terms(records: DataFrame, rare_below: int = RARE_BELOW, common_share: float = COMMON_SHARE, text_col: str = "content", sigma: int = SIGMA) -> DataFrame:
    """(term, cf, df, mark): rare for fewer than rare_below records, common for more than the share of all, else null."""
    counts = written(ngram_counts(records, sigma, text_col).where(F.col("n") <= 1))
    total = counts.where(F.col("n") == 0).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("records"))  # one row
    mark = F.when(F.col("df") < rare_below, "rare").when(F.col("df") > F.lit(common_share) * F.col("records"), "common")
    return counts.where(F.col("n") == 1).crossJoin(F.broadcast(total)).select(F.col("ngram").alias("term"), "cf", "df", mark.alias("mark"))
