"""Filling containers of one capacity with whole items by bounded-space best-fit packing."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.tokens import VOCABULARY, token_counts
from seamline.llm.words import blocks
from seamline.session import written

CAPACITY = 2048
WINDOWS = 64
#: Tasks whose open windows one task merges. Merging goes on in rounds until a single task holds what is left.
FAN_IN = 16

_SCHEMA = pa.schema([("container_id", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("token_start", pa.int64()), ("token_end", pa.int64()), ("closed", pa.bool_())])
_DDL = "container_id bigint, id bigint, piece int, token_start bigint, token_end bigint, closed boolean"


class Windows:
    """Open containers, at most a fixed number, kept in order of their free space.

    A container is complete when it is full or holds as many items as it has room for tokens, so items without tokens
    complete containers as well.
    """

    def __init__(self, capacity: int, most: int, first: int) -> None:
        self.capacity, self.most, self.next = capacity, most, first
        self.free: list[tuple[int, int]] = []  # (free space, container)
        self.items: dict[int, list[tuple]] = {}

    def place(self, item: tuple, size: int) -> Iterator[tuple[int, list[tuple]]]:
        """Put an item where it leaves the least space; yields the containers that are thereby complete."""
        at = bisect_left(self.free, (size, -1))
        if at == len(self.free):
            if len(self.free) >= self.most:
                yield self._pop(0)  # the fullest makes room
            self.items[self.next] = []
            at = len(self.free)
            self.free.append((self.capacity, self.next))
            self.next += 1
        space, container = self.free.pop(at)
        self.items[container].append(item)
        if space > size and len(self.items[container]) < self.capacity:
            insort(self.free, (space - size, container))
        else:
            yield container, self.items.pop(container)

    def _pop(self, at: int) -> tuple[int, list[tuple]]:
        _, container = self.free.pop(at)
        return container, self.items.pop(container)

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        while self.free:
            yield self._pop(0)


def _pack(capacity: int, windows: int, turn: int, last: bool, vocabulary: str | None):
    """Pack the items of a task. With a vocabulary they are texts (id, text), else items left open before."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, int]]:
        if vocabulary is None:
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            return
        for part, texts in blocks(batches, 1):
            for i, n in zip(part.column(0).to_pylist(), token_counts(texts, vocabulary), strict=True):
                for piece in range(max(1, -(-n // capacity))):
                    yield i, piece, piece * capacity, min(n, (piece + 1) * capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Ids do not collide: a number for the round, one for the task, one within the task.
        store = Windows(capacity, windows if not last else 1 << 62, (turn << 58) + (TaskContext.get().partitionId() << 34))
        out: list[tuple] = []

        def add(container: int, members: list[tuple], closed: bool) -> None:
            out.extend((container, *m, closed) for m in members)

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            out.clear()
            return batch

        stream = items(batches)
        if last:  # few are left: the largest first
            stream = iter(sorted(stream, key=lambda m: (m[2] - m[3], m)))
        for member in stream:
            for container, members in store.place(member, member[3] - member[2]):
                add(container, members, True)
            if len(out) > 20_000:
                yield emit()
        for container, members in store.rest():
            add(container, members, last)
        if out:
            yield emit()

    return run


def fill_containers(records: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, windows: int = WINDOWS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, id, piece, token_start, token_end): every text in containers of `capacity` tokens.

    A text within the capacity is one piece; a longer one is cut at multiples of the capacity and its pieces are
    placed on their own. Rows with null id or text are left out; an empty text is an item without tokens, repeated
    rows are items of their own, an empty table gives no rows.

    Each task keeps a fixed number of open containers, places best-fit, and emits the fullest when nothing fits. What
    is open at the end of a task is merged: each round packs the open containers of FAN_IN tasks in one, and the last
    one packs the largest items first, with as many containers as it takes. A container holds at most `capacity` items,
    so every round has fewer open containers than the one before, whatever the texts.
    """
    rows = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    now = written(rows.mapInArrow(_pack(capacity, windows, 0, False, vocabulary), _DDL))
    done, turn = now.where("closed"), 0
    while waiting := now.where("not closed").agg(F.count_distinct("container_id")).first()[0]:
        turn += 1
        tasks = -(-waiting // (FAN_IN * windows))
        rest = now.where("not closed").select("id", "piece", "token_start", "token_end")
        now = written(rest.coalesce(tasks).mapInArrow(_pack(capacity, windows, turn, tasks == 1, None), _DDL))
        done = done.unionByName(now.where("closed"))
    return done.drop("closed")


def fill_report(containers: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, their share of the whole space, and items."""
    return containers.agg(
        F.count_distinct("container_id").alias("containers"), F.coalesce(F.sum(F.col("token_end") - F.col("token_start")), F.lit(0)).alias("tokens"), F.count("*").alias("items")
    ).withColumn("filled", F.when(F.col("containers") > 0, F.col("tokens") / (F.col("containers") * F.lit(capacity).cast("double"))))
