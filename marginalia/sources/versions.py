"""Several tables that change together: versions in directories of their own, and a log whose last whole entry names the one that counts.

    base/data-<unique>/<table>   a version's tables, never changed
    base/log/00000003            one line: the directory of version 3 and a last word that says that the line is whole

A version counts from the moment its log entry is whole, which is the last thing a commit writes. Whatever fails before leaves the version that
was there, with all its tables; directories that no entry names are left-overs for `vacuum`. Nothing is overwritten or renamed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WHOLE = "committed"
Writer = Callable[[DataFrame, str], None]


class VersionError(RuntimeError):
    """No such version, or another writer was faster."""


class Versions:
    """The versions below a base path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def entries(self) -> dict[int, str]:
        """Directory by version, of whole entries only; one row for each version that was ever committed."""
        if not self.fs.exists(self.path(f"{self.base}/log")) or not self._numbers():
            return {}
        rows = self.spark.read.option("wholetext", True).text(f"{self.base}/log").select("value", F.col("_metadata.file_name").alias("file")).collect()
        said = {int(r["file"]): r["value"].split() for r in rows}
        return {n: words[0] for n, words in said.items() if words[1:] == [WHOLE]}

    def _numbers(self) -> list[int]:
        return [int(s.getPath().getName()) for s in self.fs.listStatus(self.path(f"{self.base}/log")) if s.getPath().getName().isdigit()]

    def current(self) -> int | None:
        return max(self.entries(), default=None)

    def location(self, table: str, version: int | None = None) -> str:
        """Where a table of a version (the current one) stands."""
        entries = self.entries()
        version = max(entries, default=None) if version is None else version
        if version not in entries:
            raise VersionError(f"{self.base} has no version {version}")
        return f"{self.base}/{entries[version]}/{table}"

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.location(table, version))

    def commit(self, tables: Mapping[str, DataFrame], writers: Mapping[str, Writer] | None = None, after: int | None = None) -> int:
        """Writes all tables (parquet, or by a writer of the table's name) as the next version, whose number comes back.

        The tables may read the current version. after: the version they were made from; if another one counts by then, nothing changes.
        """
        folder = f"data-{uuid.uuid4().hex}"
        for name, df in tables.items():
            write = (writers or {}).get(name) or (lambda d, path: d.write.parquet(path))
            write(df, f"{self.base}/{folder}/{name}")
        return self._point(folder, after)

    def rollback(self, version: int) -> int:
        """An earlier version's tables as the next version."""
        return self._point(self.location("", version).rstrip("/").rpartition("/")[2], None)

    def _point(self, folder: str, after: int | None) -> int:
        self.fs.mkdirs(self.path(f"{self.base}/log"))
        if after is not None and (now := self.current()) != after:
            raise VersionError(f"version {now} stands where {after} was read")
        number = max(self._numbers(), default=0) + 1
        try:
            out = self.fs.create(self.path(f"{self.base}/log/{number:08d}"), False)
        except Exception as e:
            raise VersionError(f"another writer has made version {number}") from e
        out.write(bytearray(f"{folder} {WHOLE}\n".encode()))
        out.close()
        return number

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes the directories that none of the last `keep` versions names; run it when no commit is under way. Their names come back."""
        entries = self.entries()
        named = {entries[v] for v in sorted(entries)[-keep:]}
        gone = [name for s in self.fs.listStatus(self.path(self.base)) if (name := s.getPath().getName()).startswith("data-") and name not in named]
        for name in gone:
            self.fs.delete(self.path(f"{self.base}/{name}"), True)
        return sorted(gone)
