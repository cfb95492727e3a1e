"""A keyed table that outlives a run, as a log of commits over Parquet folders: changes cost what they change.

A record adds a folder of changed rows and one small commit; a read lays the last change of each key over the base. Keys
are hashed to buckets, and compaction rewrites only buckets that changes touched. Commits are numbered files that take
their places whole and only if these are free, so of two writers with one number the second takes the next, and nothing
that was written is lost; a compaction that another one overtook is dropped. Parquet keeps a Bloom filter for each key
column, so that lookups by key skip files. A folder without a commit is never read: a run that breaks off changes nothing.

The store needs a file system whose rename doesn't replace a file (HDFS; on local disks it links); an object store
needs one writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
COMPACT_AFTER = 16
BUCKET, ORDER = "__bucket", "__commit"


class Store:
    """Rows of a schema with unique keys, under a path; columns that older rows lack are null."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # the log

    def commits(self) -> list[dict]:
        """The commits in their order; one that isn't written to its end doesn't count yet."""
        out = []
        for f in self._fs.globStatus(self._at("commits", "*.json")) or []:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(f.getPath()), "UTF-8")
            if text.endswith("\n"):
                out.append(json.loads(text) | {"number": int(f.getPath().getName().removesuffix(".json"))})
        return sorted(out, key=lambda c: c["number"])

    def _create(self, number: int, entry: dict) -> bool:
        """Puts a whole commit in its place in one step; false if its number is taken."""
        place, draft = self._at("commits", f"{number:09}.json"), self._at("commits", f".{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray((json.dumps(entry) + "\n").encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() != "file":
                return self._fs.rename(draft, place)  # false where a file is there
            try:  # a rename on a local disk would replace it
                os.link(draft.toUri().getPath(), place.toUri().getPath())
            except FileExistsError:
                return False
            return True
        finally:
            self._fs.delete(draft, False)

    def _commit(self, entry: dict) -> int:
        number = max((c["number"] for c in self.commits()), default=0) + 1
        while not self._create(number, entry):
            number += 1
        return number

    def _state(self, commits: list[dict] | None = None) -> tuple[dict[int, str], list[dict]]:
        """The folder of each compacted bucket, and the changes since."""
        base, changes = {}, []
        for c in self.commits() if commits is None else commits:
            if c["kind"] == "base":
                base |= dict.fromkeys(c["buckets"], c["folder"])
                changes = [d for d in changes if d["number"] > c["through"]]
            else:
                changes.append(c)
        return base, changes

    # rows

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        """rows as a folder of the store, a directory a bucket."""
        folder = f"rows-{uuid.uuid4().hex}"
        bloom = {f"parquet.bloom.filter.enabled#{k}": "true" for k in self.keys}
        dealt = rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET)  # a file a bucket, however many tasks made the rows
        dealt.write.options(**bloom).partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        return folder

    def _folder(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(f"{self.path}/{name}")

    def _changed(self, changes: list[dict]) -> DataFrame:
        """The last change of each key."""
        rows = reduce(DataFrame.unionByName, [self._folder(c["folder"]).withColumn(ORDER, F.lit(c["number"])) for c in changes])
        rest = [c for c in rows.columns if c not in (*self.keys, ORDER)]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), ORDER).alias("__last"))
        return last.select(*self.keys, *[F.col(f"__last.{c}").alias(c) for c in rest])

    def _merged(self, base: dict[int, str], changes: list[dict]) -> DataFrame:
        folders: dict[str, list[int]] = {}
        for bucket, folder in base.items():
            folders.setdefault(folder, []).append(bucket)
        parts = [self._folder(f).filter(F.col(BUCKET).isin(b)) for f, b in folders.items()]
        if changes:
            last = self._changed(changes)
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__c_{k}")) for k in self.keys])
            parts = [p.join(last.select(*[F.col(k).alias(f"__c_{k}") for k in self.keys]), same, "left_anti") for p in parts] + [last]
        return reduce(lambda a, b: a.unionByName(b), parts) if parts else self.spark.createDataFrame([], f"{self.schema}, {BUCKET} int")

    def read(self) -> DataFrame:
        """The rows as of now."""
        names = self.spark.createDataFrame([], self.schema).columns
        return self._merged(*self._state()).select(*names)

    def record(self, changes: DataFrame) -> int:
        """Puts each changed row in the place of that with its keys; of several with the same keys one stays. The number of the commit."""
        names = self.spark.createDataFrame([], self.schema).columns
        folder = self._write(changes.dropDuplicates(self.keys).select(*names))
        number = self._commit({"kind": "changes", "folder": folder})
        if len(self._state()[1]) >= COMPACT_AFTER:
            self.compact()
        return number

    def compact(self) -> bool:
        """Rewrites the buckets that were changed; false where there is nothing to do, or another compaction came first."""
        commits = self.commits()
        base, changes = self._state(commits)
        if not changes:
            return False
        seen, through = commits[-1]["number"], changes[-1]["number"]
        touched = reduce(DataFrame.unionByName, [self._folder(c["folder"]).select(BUCKET) for c in changes]).distinct()
        buckets = sorted(r[0] for r in touched.collect())  # at most as many as there are buckets
        kept = {b: f for b, f in base.items() if b in buckets}
        folder = self._write(self._merged(kept, changes).drop(BUCKET))
        entry = {"kind": "base", "folder": folder, "buckets": buckets, "through": through}
        number = seen + 1
        while True:
            if any(c["kind"] == "base" and c["number"] > seen for c in self.commits()):
                self._fs.delete(self._at(folder), True)
                return False
            if self._create(number, entry):
                return True
            number += 1

    def close(self) -> None:
        """Removes folders that commits name but no read needs any more."""
        base, changes = self._state()
        used = {*base.values(), *(c["folder"] for c in changes)}
        for folder in {c["folder"] for c in self.commits()} - used:
            self._fs.delete(self._at(folder), True)
