"""Versioned index tables in one folder; a small pointer file names the current version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from seamline.sources.files import delete, exists, read_text, replace_text


class Draft:
    """Tables of a version that is not current yet. What is never published changes nothing for readers."""

    def __init__(self, store: IndexStore) -> None:
        self.store, self.version = store, uuid.uuid4().hex
        self.places: dict[str, str] = {}

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Write a table and return it as it is stored."""
        place = f"{table}-{self.version}"
        df.write.parquet(f"{self.store.root}/{place}")
        self.places[table] = place
        return self.store.spark.read.parquet(f"{self.store.root}/{place}")

    def drop(self) -> None:
        for place in self.places.values():
            delete(self.store.spark, f"{self.store.root}/{place}")

    def publish(self, keep: tuple[str, ...] = (), **meta: object) -> str:
        """Make all tables current at once. keep names tables of the version before that go on unchanged."""
        old = self.store.meta()
        places = {name: old["tables"][name] for name in keep if name in old.get("tables", {})} | self.places
        merged = {k: v for k, v in old.items() if k not in ("tables", "version")} | {"version": self.version} | meta | {"tables": places}
        replace_text(self.store.spark, self.store.pointer, json.dumps(merged, indent=2))
        return str(merged["version"])


class IndexStore:
    """Tables of an index as Parquet: chunks, postings, vectors, file_hashes, query_cache.

    A new version is written whole beside the old one and becomes current by replacing the pointer, so readers never see
    half of an index and a failed run leaves the old one in place. The folder may be on any file system that Spark reads.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def pointer(self) -> str:
        return f"{self.root}/CURRENT.json"

    def meta(self) -> dict:
        return json.loads(read_text(self.spark, self.pointer)) if exists(self.spark, self.pointer) else {}

    def has(self, table: str) -> bool:
        return table in self.meta().get("tables", {})

    def read(self, table: str) -> DataFrame:
        tables = self.meta().get("tables", {})
        if table not in tables:
            raise FileNotFoundError(f"no table {table!r} in the index at {self.root}")
        return self.spark.read.parquet(f"{self.root}/{tables[table]}")

    def draft(self) -> Draft:
        return Draft(self)

    def publish(self, tables: dict[str, DataFrame], keep: tuple[str, ...] = (), **meta: object) -> str:
        """Write tables as a new version and make it current. keep names tables that go on unchanged."""
        draft = self.draft()
        for name, df in tables.items():
            draft.write(name, df)
        return draft.publish(keep, **meta)
