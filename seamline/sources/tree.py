"""A data source for directory trees of text files.

Spark's own file sources leave out names that begin with '_' or '.', and so would lose files such as __init__.py.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = (".py", ".md")
GROUP_BYTES = 32 << 20


class _Group(InputPartition):
    def __init__(self, paths: Sequence[str]) -> None:
        self.paths = list(paths)


def list_files(root: str, extensions: Sequence[str] = EXTENSIONS) -> list[Path]:
    """Matching regular files below root, or root itself, in path order. A missing root has none."""
    at = Path(root)
    found = [at] if at.is_file() else sorted(p for p in at.rglob("*") if p.is_file()) if at.is_dir() else []
    return [p for p in found if p.suffix in extensions]


def decode(raw: bytes) -> str:
    """UTF-8 without its invalid bytes; every line end becomes a line feed, a byte order mark stays."""
    return raw.decode("utf-8", errors="ignore").replace("\r\n", "\n").replace("\r", "\n")


class _Reader(DataSourceReader):
    def __init__(self, root: str, extensions: Sequence[str], group_bytes: int) -> None:
        self.root, self.extensions, self.group_bytes = root, extensions, group_bytes

    def partitions(self) -> list[_Group]:
        groups, now, size = [], [], 0
        for path in list_files(self.root, self.extensions):
            now.append(str(path))
            size += path.stat().st_size
            if size >= self.group_bytes:
                groups.append(_Group(now))
                now, size = [], 0
        return [*groups, _Group(now)] if now or not groups else groups

    def read(self, partition: _Group) -> Iterator[tuple[str, str, str]]:
        for name in partition.paths:
            path = Path(name)
            yield name, decode(path.read_bytes()), path.suffix


class TreeSource(DataSource):
    """format("seamline_tree"): option path; option extensions as a comma-separated list."""

    @classmethod
    def name(cls) -> str:
        return "seamline_tree"

    def schema(self) -> str:
        return "file_path string, content string, extension string"

    def reader(self, schema: object) -> _Reader:
        chosen = self.options.get("extensions")
        return _Reader(self.options["path"], tuple(chosen.split(",")) if chosen else EXTENSIONS, int(self.options.get("group_bytes", GROUP_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)


def read_tree(spark: SparkSession, path: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(file_path, content, extension) of all matching files below path; no rows where there are none."""
    register(spark)
    return spark.read.format("seamline_tree").option("path", path).option("extensions", ",".join(extensions)).load()
