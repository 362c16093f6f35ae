"""Relations kept as Parquet: appended, evolved, rewritten (A28, A31, B1-B3, B5, B8, B15-B19). Parts first, a version last."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_id(*parts: str) -> Column:
    """B1: an id that the row's own key decides, so that a retried append writes the same."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(p).cast("string"), F.lit("\1")) for p in parts]).cast("binary"), 256)


class Store:
    """A folder of Parquet parts and versions. A version is a small file that lists parts; the newest one counts.

    Parts are written first and a version last, under a name that must be new: a failed write changes nothing, and of two
    writers one fails. Appending writes what is appended and no more.
    """

    def __init__(self, spark: SparkSession, path: str, partition_by: Sequence[str] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), list(partition_by)
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        root = self._fs_path(self.path)
        if not self._fs.exists(root):
            return []
        return sorted(n for s in self._fs.listStatus(root) if re.fullmatch(r"v\d{8}\.json", n := s.getPath().getName()))

    def _parts(self, version: str | None = None) -> list[dict]:
        """Parts of a version, the newest by default: name, and defaults of columns that came after it."""
        have = self.versions()
        if not have:
            return []
        text = self.spark.read.text(f"{self.path}/{version or have[-1]}", wholetext=True).first()
        return json.loads(text[0])["parts"]

    def _commit(self, parts: list[dict]) -> None:
        have = self.versions()
        name = f"v{int(have[-1][1:9]) + 1 if have else 1:08d}.json"
        try:
            out = self._fs.create(self._fs_path(f"{self.path}/{name}"), False)
        except Exception as e:
            raise OSError(f"{self.path}/{name} is there already: another writer was faster") from e
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()

    def _write(self, rows: DataFrame) -> dict:
        name = f"part-{uuid.uuid4().hex}"
        writer = rows.write
        (writer.partitionBy(*self.partition_by) if self.partition_by else writer).parquet(f"{self.path}/{name}")
        return {"name": name, "defaults": {}}

    def _part(self, part: dict) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{part['name']}")
        return rows.withColumns({c: F.lit(v) for c, v in part["defaults"].items() if c not in rows.columns})

    def read(self, version: str | None = None) -> DataFrame | None:
        """The newest version, or an earlier one; None if nothing was written. Columns that a part lacks are null."""
        parts = [self._part(p) for p in self._parts(version)]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def replace(self, rows: DataFrame) -> None:
        """Rows instead of all that are there."""
        self._commit([self._write(rows)])

    def append(self, rows: DataFrame, defaults: dict[str, object] | None = None) -> None:
        """Rows after those that are there, as a part of their own. New columns get a default in older
        parts, missing ones are null, and columns that the store doesn't know are kept: the schema only grows."""
        old = [p | {"defaults": (defaults or {}) | p["defaults"]} for p in self._parts()]
        self._commit([*old, self._write(rows)])

    def delete(self, gone: DataFrame, key: str = "doc_id") -> None:
        """The store without rows of these keys; only parts that have such rows are written again."""
        gone, kept, changed = gone.select(key).distinct(), [], False
        for p in self._parts():
            rows = self._part(p)
            if rows.join(gone, key, "left_semi").isEmpty():
                kept.append(p)
            else:
                kept.append(self._write(rows.join(gone, key, "left_anti")))
                changed = True
        if changed:
            self._commit(kept)

    def optimise(self, files: int, keep: int = 1) -> None:
        """The rows in one part of fewer files; all but the keep newest versions go, and parts that none of these lists."""
        old = self.read()
        if old is not None:
            self.replace(old.coalesce(files))
        for name in self.versions()[:-keep]:
            self._fs.delete(self._fs_path(f"{self.path}/{name}"), False)
        used = {p["name"] for v in self.versions() for p in self._parts(v)}
        for s in self._fs.listStatus(self._fs_path(self.path)) if old is not None else ():
            name = s.getPath().getName()
            if name.startswith("part-") and name not in used:
                self._fs.delete(s.getPath(), True)

    def back_up(self, path: str) -> None:
        """A copy of the newest version elsewhere, as one part; it reads as a store of its own."""
        rows = self.read()
        if rows is not None:
            Store(self.spark, path, self.partition_by).replace(rows)


def database(spark: SparkSession, url: str, tables: Sequence[str], **options: str) -> dict[str, DataFrame]:
    """Tables of an external database over JDBC, as views for the guard; filters and columns are pushed down."""
    return {t: spark.read.format("jdbc").options(url=url, dbtable=t, **options).load() for t in tables}


def registered(text: str) -> dict[str, str]:
    """Databases of a setting: name=url, separated by commas."""
    return dict(p.strip().split("=", 1) for p in text.split(",") if "=" in p)


def tables_of(spark: SparkSession, prefix: str = "doc_") -> list[str]:
    """Inferred tables that the session knows."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(prefix))
