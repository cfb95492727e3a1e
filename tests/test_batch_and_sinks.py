from __future__ import annotations

import csv
import glob

import pytest
from pyspark.sql import functions as F

from emulsia.operators import reports
from emulsia.plans import batch
from emulsia.sources import sinks


def encode(path, data):
    if data == b"bad":
        raise ValueError("cannot decode")
    return ("ok", len(data) // 2, f"out/{path}") if len(data) > 3 else ("skipped-larger", len(data), f"out/{path}")


def test_batch_runs_misses_only_and_records_successes(spark, tmp_path):
    files = spark.createDataFrame([("a", b"aaaaaaaa", "h1", "f"), ("b", b"bbbbbb", "h2", "f"), ("c", b"bad", "h3", "f"), ("d", b"dd", "h4", "f")], "path string, content binary, content_hash string, fingerprint string")
    known = spark.createDataFrame([("a", "h1", "f", "out/a", 8, 4), ("b", "old", "f", "out/b", 6, 3), ("z", "h9", "f", "out/z", 9, 9)], "path string, content_hash string, fingerprint string, output_path string, original_size long, compressed_size long")
    outputs = spark.createDataFrame([("out/a",), ("out/b",)], "output_path string")
    seen = []

    def store(df):
        path = str(tmp_path / f"done{len(seen)}")
        seen.append(path)
        df.write.parquet(path)
        return spark.read.parquet(path)

    results, updated, totals = batch.run_batch(files, known, outputs, encode, store)
    assert {r["path"]: r["row_status"] for r in results.collect()} == {"a": "cached", "b": "written", "c": "failed", "d": "kept-original"}
    assert {r["path"]: r["content_hash"] for r in updated.collect()} == {"a": "h1", "b": "h2", "d": "h4", "z": "h9"}
    t = totals.first()
    assert (t["ok"], t["unchanged"], t["failed"], t["total_in"], t["total_out"]) == (2, 1, 1, 8, 5)
    again, _, totals = batch.run_batch(files, updated, updated.select("output_path"), encode, store)
    assert totals.first()["unchanged"] == 3 and {r["path"] for r in again.filter("status = 'failed'").collect()} == {"c"}
    _, same, _ = batch.run_batch(files, known, outputs, encode, store, dry_run=True)
    assert same.count() == 3


def test_report_is_blank_where_not_measured(spark, tmp_path):
    rows = spark.createDataFrame([("b.jpg", "faithful", 10, 1.23456, None), ("a.jpg", "video", None, None, 94.567)], "file string, mode string, original_bytes long, ratio double, vmaf_p1 double")
    sinks.write_report(rows, str(tmp_path / "r"))
    (path,) = glob.glob(str(tmp_path / "r" / "*.csv"))
    with open(path, newline="") as f:
        table = list(csv.DictReader(f))
    assert [r["file"] for r in table] == ["a.jpg", "b.jpg"] and list(table[0]) == list(sinks.REPORT)
    assert table[0]["ratio"] == "" and table[0]["vmaf_p1"] == "94.57" and table[1]["ratio"] == "1.2346" and table[1]["codec"] == ""


def test_baseline_version_is_checked(spark, tmp_path):
    rows = spark.createDataFrame([("a", "faithful", "ok", 1.5, None, None, None, 10, 5, None)], sinks.BENCH)
    sinks.save_baseline(rows, str(tmp_path / "b"))
    assert sinks.load_baseline(spark, str(tmp_path / "b")).collect() == rows.collect()
    (tmp_path / "old.json").write_text('{"version": 9, "file": "a"}\n')
    with pytest.raises(Exception, match="another version"):
        sinks.load_baseline(spark, str(tmp_path / "old.json")).collect()


def test_write_files(spark, tmp_path):
    data = spark.createDataFrame([("a.avif", b"1"), ("no/folder.avif", b"2")], "name string, content binary")
    rows = {r["name"]: (r["bytes"], r["error"]) for r in sinks.write_files(data, str(tmp_path / "out")).collect()}
    assert rows["a.avif"] == (1, None) and rows["no/folder.avif"][1] is not None
    assert (tmp_path / "out" / "a.avif").read_bytes() == b"1" and not list((tmp_path / "out").glob("*.part"))


def test_texts(spark):
    row = spark.range(1).select(
        reports.duration_text(F.lit(59)).alias("a"), reports.duration_text(F.lit(3725)).alias("b"), reports.table_text(F.lit("BOTH"), F.lit(1.5), F.lit(-0.25)).alias("c"),
        reports.table_text(F.lit("NEW"), F.lit(1.5), F.lit(None).cast("double")).alias("d"), reports.table_text(F.lit("BOTH"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("e"),
    ).first()
    assert tuple(row) == ("0:59", "1:02:05", "1.500 (-0.250)", "1.500 NEW", "")
    page = sinks.comparison_page("<t>", {"before": "data:image/png;base64,AA=="}, [("ssim", "0.98", "")])
    assert "&lt;t&gt;" in page and "<td>0.98</td>" in page
