"""Words of many texts at once, as arrays: no Python step per word."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Characters handled together; bounds the memory of a task however long a batch is. A longer text is a block of its own.
BLOCK_CHARS = 1_500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


@functools.cache
def word_characters() -> np.ndarray:
    """For every code point: whether it is a letter, a number or the underscore."""
    table = np.fromiter((unicodedata.category(chr(i))[0] in "LN" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    table[ord("_")] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Words:
    """Words of a list of texts, lower-cased: places in the joined text, the text each belongs to, a 64-bit hash."""

    def __init__(self, texts: Sequence[str], least: int = 1) -> None:
        lowered = [t.lower() for t in texts]
        self.n_texts = len(lowered)
        self.joined = "\n".join(lowered)
        sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        self.offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
        points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), "<u4")
        inside = np.zeros(len(points) + 2, bool)
        inside[1:-1] = word_characters()[points]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        if least > 1:
            long = ends - starts >= least
            starts, ends = starts[long], ends[long]
        size = 1 << max(16, int(len(points) + 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
        self.hashes = mix((sums[ends] - sums[starts]) * down[starts])
        self.starts, self.ends = starts, ends
        self.text_of = np.searchsorted(self.offsets, starts, "right") - 1

    def word(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of `width` consecutive words of one text, repeats kept."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for i in range(width):
            total += self.hashes[i : i + n] * np.uint64(_POSITION[i % len(_POSITION)] + 2 * (i // len(_POSITION)))
        whole = self.text_of[:n] == self.text_of[width - 1 :]
        return self.text_of[:n][whole], mix(total[whole])


def shingle_sets(texts: Sequence[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the sorted distinct shingle hashes of text i are hashes[bounds[i]:bounds[i + 1]]."""
    text, h = Words(texts).shingles(width)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
        text, h = text[new], h[new]
    return np.searchsorted(text, np.arange(len(texts) + 1)), h


def blocks(batches: Iterator[pa.RecordBatch], text_column: int, chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches whose texts hold about `chars` characters, with the texts (null as empty)."""
    for batch in batches:
        column = batch.column(text_column)
        if batch.num_rows == 0:
            continue
        sizes = np.nan_to_num(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(float)).cumsum()
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0.0
            end = max(at + 1, int(np.searchsorted(sizes, before + chars, "right")))
            part = batch.slice(at, end - at)
            yield part, [t or "" for t in part.column(text_column).to_pylist()]
            at = end
