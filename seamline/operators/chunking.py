"""Recursive splitting of source files and Markdown into chunks with exact offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import is_blank, suffix

CHUNK_SIZE = 2000
OVERLAP = 200

# Separators in the order in which they are tried; a separator stays with the text after it.
SEPARATORS = {
    ".py": [r"\nclass ", r"\ndef ", r"\n\tdef ", r"\n\n", r"\n", r" "],
    ".md": [r"\n#{1,6} ", "```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", r" "],
}
_COMPILED = {kind: [re.compile(s) for s in patterns] for kind, patterns in SEPARATORS.items()}

Span = tuple[int, int]


def _merge(pieces: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Join neighbouring pieces up to size; the next run starts with whole pieces of at most `overlap` in total."""
    first = 0
    for i, (start, end) in enumerate(pieces):
        if i > first and end - pieces[first][0] > size:
            yield pieces[first][0], pieces[i - 1][1]
            while first < i and (start - pieces[first][0] > overlap or end - pieces[first][0] > size):
                first += 1
    if first < len(pieces):
        yield pieces[first][0], pieces[-1][1]


def _divide(text: str, lo: int, hi: int, patterns: list[re.Pattern], size: int, overlap: int) -> Iterator[Span]:
    for level, pattern in enumerate(patterns):
        cuts = [m.start() for m in pattern.finditer(text, lo, hi)]
        if cuts:
            rest = patterns[level + 1 :]
            break
    else:
        # No separator is left: single characters, joined greedily.
        step = max(1, size - overlap)
        at = lo
        while True:
            yield at, min(at + size, hi)
            if at + size >= hi:
                return
            at += step
    edges = [lo, *(c for c in cuts if c > lo), hi]
    run: list[Span] = []
    for piece in zip(edges, edges[1:]):
        if piece[1] - piece[0] < size:
            run.append(piece)
            continue
        yield from _merge(run, size, overlap)
        run = []
        yield from _divide(text, *piece, rest, size, overlap)
    yield from _merge(run, size, overlap)


def split_text(text: str, kind: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[Span]:
    """Spans [start, end) of the chunks of one text; white space at the ends of a chunk is left out."""
    out = []
    for start, end in _divide(text, 0, len(text), _COMPILED[kind], size, overlap):
        part = text[start:end]
        left = len(part) - len(part.lstrip())
        body = part.strip()
        if body:
            out.append((start + left, start + left + len(body)))
    return out


def chunk_documents(documents: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(file_path, place, content, start_index, end_index) of documents (file_path, content, extension).

    Blank documents and those with an extension other than .py and .md (any case) give no rows. No shuffle: a
    document is cut where its row is.
    """
    if overlap > size:
        raise ValueError("the overlap must not exceed the chunk size")
    kind = F.lower(F.coalesce(F.col("extension"), suffix(F.col("file_path"))))
    rows = documents.where(kind.isin(*SEPARATORS) & ~is_blank(F.col("content"))).select("file_path", "content", kind.alias("kind"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text, ext in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = split_text(text, ext, size, overlap)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(spans), pa.string()), pa.array(range(len(spans)), pa.int32()), pa.array([text[a:b] for a, b in spans], pa.string()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64())],
                    names=["file_path", "place", "content", "start_index", "end_index"],
                )

    return rows.mapInArrow(run, "file_path string, place int, content string, start_index bigint, end_index bigint")


def unsupported(documents: DataFrame) -> DataFrame:
    """Documents that chunk_documents leaves out for their extension."""
    kind = F.lower(F.coalesce(F.col("extension"), suffix(F.col("file_path"))))
    return documents.where(~F.coalesce(kind.isin(*SEPARATORS), F.lit(False)))


def with_chunk_ids(chunks: DataFrame, start: int = 0) -> DataFrame:
    """chunk_id from start + 1 in order of file_path and place."""
    from seamline.operators.snapshots import assign_ids

    top = chunks.sparkSession.range(1).select(F.lit(start).cast("bigint").alias("top"))
    return assign_ids(chunks, top, ordinal="place").select("chunk_id", "content", "start_index", "end_index", "file_path")
