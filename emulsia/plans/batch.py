"""One batch over an inbox: scan, skip what the ledger has, run the rest, record, report."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsia.operators import reports
from emulsia.sources import ledger

RESULT = "path string, content_hash string, fingerprint string, mode string, status string, original_size long, compressed_size long, output_path string, error string"
Encode = Callable[[str, bytes], tuple[str, int, str]]


def run_misses(misses: DataFrame, encode: Encode, mode: str) -> DataFrame:
    """misses (path, content_hash, fingerprint, content) to results; a file that fails is a row with the error."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            out = []
            for path, key, print_, data in zip(*(b.column(c).to_pylist() for c in ("path", "content_hash", "fingerprint", "content"))):
                try:
                    status, size, target = encode(path, data)
                    out.append((path, key, print_, mode, status, len(data), size, target, None))
                except Exception as e:  # one file must not end the batch
                    out.append((path, key, print_, mode, "failed", len(data or b""), None, None, f"{type(e).__name__}: {e}"))
            names = ["path", "content_hash", "fingerprint", "mode", "status", "original_size", "compressed_size", "output_path", "error"]
            types = [pa.string()] * 5 + [pa.int64()] * 2 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    return misses.select("path", "content_hash", "fingerprint", "content").mapInArrow(batches, RESULT)


def run_batch(files: DataFrame, known: DataFrame, outputs: DataFrame, encode: Encode, store: Callable[[DataFrame], DataFrame], mode: str = "faithful", dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, ledger, totals) of a batch.

    files: path, content, content_hash, fingerprint. known: path, content_hash, fingerprint, output_path,
    original_size, compressed_size. Encoding runs on misses only; `store` writes its rows once, as three tables read them.
    """
    hit = ledger.hits(files, known, outputs).select("path")
    cached = known.join(hit, "path", "left_semi").select("path", "content_hash", "fingerprint", F.lit(mode).alias("mode"), F.lit("skipped-unchanged").alias("status"), "original_size", "compressed_size", "output_path", F.lit(None).cast("string").alias("error"))
    done = store(run_misses(files.join(hit, "path", "left_anti"), encode, mode))
    results = cached.unionByName(done).withColumn("row_status", reports.row_status(F.col("status"), F.col("mode"), F.lit(dry_run)))
    changes = done.filter(F.col("status").isin(*ledger.RECORDED)).select("path", "content_hash", "fingerprint", "output_path", "original_size", "compressed_size")
    updated = known if dry_run else ledger.upsert(known.select(*changes.columns), changes, "path", ["content_hash"])
    return results, updated, reports.totals(results, ["mode"])
