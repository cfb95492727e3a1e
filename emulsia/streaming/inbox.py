"""A watched folder over tables: what a scan finds lies beside what the last one found, and a store keeps what was taken.

A file is stable when two scans in a row agree on its size and time, and it is given out once at that stat, also after a
restart. One that failed is held until its stat changes or it is gone. No listing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsia.sources.store import Store

SCAN = "path string, size long, mtime long"
TAKEN = f"{SCAN}, verdict string"
STAT = ["path", "size", "mtime"]


class Inbox:
    """The state of a watch, under a path that all runs of it share; one run at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.taken = Store(spark, f"{self.path}/taken", TAKEN, ["path"])
        jvm = spark.sparkContext._jvm
        self._at = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((self.path, *p)))
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def scans(self) -> list[int]:
        """The numbers of the scans that were written to their end."""
        found = self._fs.globStatus(self._at("scans", "*", "_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def _scan(self, number: int) -> DataFrame:
        return self.spark.read.schema(SCAN).parquet(f"{self.path}/scans/{number:09}")

    def cycle(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The files (path, size, mtime) as found now, and those of them to take: stable, and not taken at this stat."""
        known = self.scans()
        number = (known[-1] if known else 0) + 1
        files.select(*STAT).write.mode("overwrite").parquet(f"{self.path}/scans/{number:09}")
        now = self._scan(number)
        gone = self.taken.read().filter("verdict = 'failed'").join(now, "path", "left_anti")
        if not gone.isEmpty():
            self.taken.record(gone.withColumns({"verdict": F.lit("gone"), "size": F.lit(-1).cast("long")}))
        for old in known[:-1]:
            self._fs.delete(self._at("scans", f"{old:09}"), True)
        if not known:
            return now, now.limit(0)
        stable = now.join(self._scan(known[-1]), STAT, "left_semi")
        return now, stable.join(self.taken.read(), STAT, "left_anti")

    def settle(self, results: DataFrame) -> None:
        """Records files (path, size, mtime, verdict) as taken; `failed` ones are tried again when they change or come back."""
        self.taken.record(results)
