"""Scans of a media folder and its stand-in, and content keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of photos and clips.
PHOTO = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "heic", "heif")
VIDEO = ("mp4", "mov", "m4v", "mkv", "avi", "webm", "mts", "m2ts", "ts", "3gp", "mpg", "mpeg", "wmv", "flv")


def scan_folder(spark: SparkSession, root: str, suffixes: tuple[str, ...] = PHOTO + VIDEO, content: bool = False) -> DataFrame:
    """Files directly in root with one of the suffixes, all lower or all upper case: path, length, modificationTime.

    The listing itself is filtered; only with `content` are bytes read.
    """
    either = ",".join(f"{x}" for s in suffixes for x in (s, s.upper()))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", f"*.{{{either}}}").load(root)
    return files.select("path", "length", "modificationTime", *(["content"] if content else []))


def documents_as_files(documents: DataFrame) -> DataFrame:
    """path, content, size and mtime of each document."""
    return documents.select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size"), F.pmod("doc_id", F.lit(97)).cast("long").alias("mtime"))


def with_content_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.col("content"), 256))


def output_name(path, suffix: str):
    """The path with a known image suffix replaced, or the suffix appended; dots in stems survive."""
    known = r"(?i)\.(" + "|".join((*PHOTO, "avif", "jxl")) + r")$"
    right = F.lower(path).endswith(f".{suffix}")
    return F.when(right, path).otherwise(F.concat(F.regexp_replace(path, known, ""), F.lit(f".{suffix}")))


def ledger_key(path, root: str):
    """The key of a path in the ledger: absolute, without `.`, `..` and doubled slashes, also if no such file is there."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/"), lambda p: (p != "") & (p != "."))
    step = lambda kept, p: F.when(p == "..", F.slice(kept, F.lit(1), F.greatest(F.lit(0), F.size(kept) - 1))).otherwise(F.concat(kept, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
