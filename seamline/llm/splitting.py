"""Cutting long texts at natural boundaries, with an overlap between pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200

_LINE = re.compile("\n")
_HEADING = re.compile("#{1,6} ")
_DEFINITION = re.compile("def |class |async def |function |func ")
_BLANK_LINE = re.compile("[ \t\r]*\n")


def boundaries(text: str, markdown: bool) -> list[np.ndarray]:
    """Sorted cut positions by class, best first: section, paragraph, line, word.

    A section starts at a Markdown heading or at a line that opens a definition; a paragraph after a line of
    spaces, tabs and carriage returns only; a line after each line feed; a word just after a space.
    """
    starts = [0, *(m.end() for m in _LINE.finditer(text))]
    section = _HEADING if markdown else _DEFINITION
    sections = [s for s in starts if section.match(text, s)]
    paragraphs = [b for a, b in zip(starts, starts[1:]) if _BLANK_LINE.match(text, a)]
    words = [m.end() for m in re.finditer(" ", text)]
    return [np.array(x, np.int64) for x in (sections, paragraphs, starts, words)]


def pieces(text: str, markdown: bool, limit: int = LIMIT, overlap: int = OVERLAP, least: int | None = None) -> list[tuple[int, int]]:
    """[start, end) of the pieces of one text; a text within the limit is one piece, an empty one none.

    From each start the hierarchy of separators is tried from the best class down: the piece is packed up to the
    last boundary of that class between `least` (half the limit) and the limit, and to the limit itself where no
    class has one. Work is linear in the text and logarithmic per piece.
    """
    least = limit // 2 if least is None else least
    if not overlap < least <= limit:
        raise ValueError("overlap < least <= limit must hold")
    n, start, out = len(text), 0, []
    if n == 0:
        return out
    classes = boundaries(text, markdown) if n > limit else []
    while n - start > limit:
        end = start + limit
        for places in classes:
            i = int(np.searchsorted(places, start + limit, "right")) - 1
            if i >= 0 and places[i] >= start + least:
                end = int(places[i])
                break
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def split_records(records: DataFrame, id_col: str, text_col: str, path_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, start_index, end_index, piece) of every distinct record longer than the limit and not blank.

    Offsets count code points of the text as it is. Repeated ids are read once; null ids and null, blank or short
    texts give no rows; a null path counts as not Markdown. The text is cut where its row is; only ids with text
    over the limit are compared with each other to drop repeats.
    """
    rows = records.where(F.col(id_col).isNotNull() & (F.length(text_col) > limit)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path")).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, starts, ends, parts, held = [], [], [], [], 0
            for i, (text, path) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not text.strip():
                    continue
                for a, b in pieces(text, (path or "").lower().endswith(".md"), limit, overlap):
                    keep.append(i)
                    starts.append(a)
                    ends.append(b)
                    parts.append(text[a:b])
                    held += b - a
                if held > 8_000_000:
                    yield out(batch, keep, starts, ends, parts)
                    keep, starts, ends, parts, held = [], [], [], [], 0
            yield out(batch, keep, starts, ends, parts)

    def out(batch: pa.RecordBatch, keep: list, starts: list, ends: list, parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(parts, pa.string())], names=["id", "start_index", "end_index", "piece"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, start_index bigint, end_index bigint, piece string")
