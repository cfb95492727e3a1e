"""The ledger of finished work: fingerprints, lookups by content or by stat, upserts, and the detection memo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emulsia.sources.store import Store

#: Statuses that are recorded; others are tried again.
RECORDED = ("ok", "skipped-larger", "kept-original")


def fingerprint(settings: Column) -> Column:
    """First 16 digits of SHA-256 over the compact JSON of a struct with sorted names; nulls are present."""
    return F.substring(F.sha2(F.to_json(settings, {"ignoreNullFields": "false"}), 256), 1, 16)


def hits(files: DataFrame, ledger: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files whose path, content hash and fingerprint are in the ledger and whose output exists."""
    return files.join(ledger.select("path", "content_hash", "fingerprint", "output_path"), ["path", "content_hash", "fingerprint"]).join(outputs.select("output_path"), "output_path", "left_semi")


def with_hits(files: DataFrame, ledger: DataFrame, outputs: DataFrame) -> DataFrame:
    """files with `hit`: in the ledger by path, content hash and fingerprint, with an output that exists. Files are read
    once; of the ledger only keys of existing outputs move."""
    keys = ["path", "content_hash", "fingerprint"]
    known = ledger.select(*keys, "output_path").join(outputs.select("output_path"), "output_path", "left_semi").select(*keys).distinct()
    return files.join(known.withColumn("__hit", F.lit(True)), keys, "left").withColumn("hit", F.col("__hit").isNotNull()).drop("__hit")


def misses(files: DataFrame, ledger: DataFrame, outputs: DataFrame) -> DataFrame:
    """Files that aren't hits."""
    flagged = with_hits(files, ledger, outputs)
    return flagged.filter(~F.col("hit")).drop("hit")


def refreshed(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """The ledger with the stat of each file that hits by content but not by stat, so that the next scan needn't hash it.

    A file without a row changes nothing; other columns of a row stay.
    """
    seen = files.groupBy("path", "content_hash", "fingerprint").agg(F.max(F.struct("mtime", "size")).alias("__s"))
    joined = ledger.join(seen, ["path", "content_hash", "fingerprint"], "left")
    stat = {c: F.coalesce(F.col(f"__s.{c}"), F.col(c)) for c in ("size", "mtime")}
    return joined.withColumns(stat).select(*ledger.columns)


def stat_hits(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Hits by size, mtime and fingerprint; a null stat never matches."""
    return files.join(ledger.select("path", "size", "mtime", "fingerprint"), ["path", "size", "mtime", "fingerprint"], "left_semi")


def upsert(ledger: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The ledger with the last change of each key in place of its row.

    The last one is an aggregate (combined before the shuffle), and an anti-join keeps the rows without a change.
    """
    rest = [c for c in changes.columns if c != key and c not in order]
    last = changes.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("last")).select(key, *[F.col(f"last.{c}").alias(c) for c in (*order, *rest)])
    return ledger.join(changes.select(key).distinct(), key, "left_anti").unionByName(last.select(*ledger.columns))


def fill_cache(wanted: DataFrame, cache: DataFrame, detect) -> DataFrame:
    """(content_hash, fingerprint, boxes) for each distinct wanted pair: cached, or else detected once.

    Pairs are told apart by their keys alone; content is joined only to those that the cache lacks.
    """
    keys = ["content_hash", "fingerprint"]
    pairs = wanted.select(*keys).distinct()
    known = pairs.join(cache, keys).select(*keys, "boxes", F.lit(True).alias("cached"))
    missing = pairs.join(cache.select(*keys), keys, "left_anti")
    first = wanted.join(missing, keys, "left_semi").groupBy(*keys).agg(F.min("content").alias("content"))
    return known.unionByName(first.select(*keys, detect(F.col("content")).alias("boxes"), F.lit(False).alias("cached")))


def live_pairs(clips: DataFrame, photos: DataFrame) -> DataFrame:
    """Clips with a photo of the same folder and stem."""
    return clips.join(photos.select("folder", "stem"), ["folder", "stem"], "left_semi")


def first_of(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return candidates.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


#: Schemas of the two tables that outlive a run.
PROCESSED = "path string, content_hash string, fingerprint string, output_path string, size long, mtime long, mode string, status string"
DETECTED = "content_hash string, fingerprint string, boxes string"


def processed(spark: SparkSession, path: str) -> Store:
    """The ledger under a path."""
    return Store(spark, path, PROCESSED, ["path"])


def detected(spark: SparkSession, path: str) -> Store:
    """The memo of detections under a path."""
    return Store(spark, path, DETECTED, ["content_hash", "fingerprint"])
