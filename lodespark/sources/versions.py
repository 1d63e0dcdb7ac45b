"""Tables as versioned parquet directories: each write makes a new one, and a pointer names the current one.

A reader keeps the version it opened. A write that breaks off leaves the pointer as it was. A version may grow by parts: each is written
aside, under a name that readers skip, and renamed when it is whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Tables below ``root``, which may be any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def current(self, name: str) -> str | None:
        """The directory that the pointer names. Pointers are empty files, named by a counter; the last one counts."""
        at = self._path(name, "_current")
        if not self.fs.exists(at):
            return None
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(at))
        return names[-1].split("-", 1)[1] if names else None

    def read(self, name: str, schema: str) -> DataFrame:
        version = self.current(name)
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{name}/{version}")

    def append(self, name: str, df: DataFrame) -> None:
        """Adds a part to the current version; nothing that is there is written again."""
        version = self.current(name)
        if version is None:
            return self.write(name, df)
        part = uuid.uuid4().hex
        aside = f"{self.root}/{name}/{version}/_part-{part}"
        df.write.parquet(aside)
        if not self.fs.rename(self.jvm.org.apache.hadoop.fs.Path(aside), self._path(name, version, f"part-{part}")):
            raise RuntimeError(f"a part of {name} could not be put in place")

    def write(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{version}")
        at = self._path(name, "_current")
        n = len(self.fs.listStatus(at)) if self.fs.exists(at) else 0
        if not self.fs.createNewFile(self._path(name, "_current", f"{n:09d}-{version}")):
            raise RuntimeError(f"another writer has just changed {name}")

    def vacuum(self, name: str) -> int:
        """Removes all versions but the current one; returns how many."""
        keep, gone = self.current(name), 0
        if keep is None:
            return 0
        for s in self.fs.listStatus(self._path(name)):
            if s.getPath().getName() not in ("_current", keep):
                self.fs.delete(s.getPath(), True)
                gone += 1
        return gone
