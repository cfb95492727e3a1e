from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from emulsia.functions import pixels as P
from emulsia.functions import search as S
from emulsia.sources import archive, ledger
from emulsia.streaming import watch


def test_hit_matrix(spark):
    files = spark.createDataFrame([("a", "h1", "f"), ("b", "h2", "f"), ("c", "h3", "f"), ("d", "h4", "f")], "path string, content_hash string, fingerprint string")
    known = spark.createDataFrame([("a", "h1", "f", "a.o"), ("b", "old", "f", "b.o"), ("c", "h3", "old", "c.o"), ("d", "h4", "f", "gone.o")], "path string, content_hash string, fingerprint string, output_path string")
    outputs = spark.createDataFrame([("a.o",), ("b.o",), ("c.o",)], "output_path string")
    assert [r["path"] for r in ledger.hits(files, known, outputs).collect()] == ["a"]
    assert sorted(r["path"] for r in ledger.misses(files, known, outputs).collect()) == ["b", "c", "d"]


def test_null_stats_never_hit(spark):
    files = spark.createDataFrame([("a", None, 1, "f"), ("b", 2, 2, "f")], "path string, size long, mtime long, fingerprint string")
    assert [r["path"] for r in ledger.stat_hits(files, files).collect()] == ["b"]


def test_upsert_keeps_the_last_change(spark):
    base = spark.createDataFrame([(1, 10, "old"), (2, 10, "kept")], "k int, at int, v string")
    changes = spark.createDataFrame([(1, 11, "x"), (1, 12, "new"), (3, 1, "added")], "k int, at int, v string")
    rows = {r["k"]: r["v"] for r in ledger.upsert(base, changes, "k", ["at"]).collect()}
    assert rows == {1: "new", 2: "kept", 3: "added"}


def test_fingerprint_is_that_of_compact_json(spark):
    got = spark.range(1).select(ledger.fingerprint(F.struct(F.lit("avif").alias("codec"), F.lit(None).cast("int").alias("effort"), F.lit(70).alias("quality")))).first()[0]
    text = json.dumps({"codec": "avif", "effort": None, "quality": 70}, separators=(",", ":"), sort_keys=True)
    assert got == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_scan_lists_both_cases_and_no_folders_below(spark, tmp_path):
    for name in ("a.jpg", "b.JPG", "c.txt", "d.Jpg"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.jpg").write_bytes(b"x")
    found = archive.scan_folder(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.collect()) == ["a.jpg", "b.JPG"]
    assert found.columns == ["path", "length", "modificationTime"]


def test_all_passing_probes_end_below_the_range(spark):
    row = spark.range(1).select(S.lowest_quality(lambda q: q > 0).alias("all"), S.lowest_quality(lambda q: q > 1000).alias("none"), S.highest_crf(lambda c: c > 1000).alias("floor"), S.highest_crf(lambda c: c <= 31).alias("crf")).first()
    assert (row["all"], row["none"], row["floor"], row["crf"]) == (39, 95, 20, 31)


def test_p1_is_an_order_statistic(spark):
    values = [float(v) for v in range(300, 0, -1)]
    row = spark.createDataFrame([(values,), (values[:150],)], "v array<double>").select(P.pooled(F.col("v")).alias("p")).collect()
    assert [r["p"]["p1"] for r in row] == [3.0, 151.0]


def test_equal_blocks_have_infinite_psnr_and_ssim_one(spark):
    block = [float(i % 9) / 9 for i in range(64)]
    row = spark.createDataFrame([(block, block)], "a array<double>, b array<double>").select(P.psnr(F.col("a"), F.col("b")).alias("p"), P.ssim_8x8("a", "b").alias("s")).first()
    assert row["p"] == float("inf") and abs(row["s"] - 1) < 1e-12


def test_ssim_equals_plain_windows():
    rng = np.random.default_rng(3)
    a, b = rng.random((8, 8)), rng.random((8, 8))
    values = []
    for y in range(2):
        for x in range(2):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            cov = np.cov(p, q, ddof=1)
            values.append((2 * p.mean() * q.mean() + 1e-4) * (2 * cov[0, 1] + 9e-4) / ((p.mean() ** 2 + q.mean() ** 2 + 1e-4) * (cov[0, 0] + cov[1, 1] + 9e-4)))
    assert abs(P.windowed_ssim(a, b) - np.mean(values)) < 1e-12


SCANS = [("a", 1, 5, 1, False), ("a", 2, 5, 1, False), ("a", 3, 6, 2, False), ("a", 4, 6, 2, False), ("b", 1, 7, 1, True), ("b", 2, 7, 1, True), ("b", 3, 7, 1, True), ("b", 4, 8, 2, True), ("b", 5, 8, 2, True)]


def test_blocked_files_are_held_until_they_change(spark):
    scans = spark.createDataFrame(SCANS, "path string, scan long, size long, mtime long, fails boolean")
    rows = {(r["path"], r["scan"]): (r["tried"], r["held"]) for r in watch.blocked_runs(scans).collect()}
    assert rows["a", 2] == (True, False) and rows["a", 3] == (False, False) and rows["a", 4] == (True, False)
    assert rows["b", 2] == (True, False) and rows["b", 3] == (False, True) and rows["b", 4] == (False, False) and rows["b", 5] == (True, False)


class State:
    exists, value = False, None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.exists, self.value = True, v

    def remove(self):
        self.exists, self.value = False, None


def test_replay_of_the_stream_step_agrees_with_the_batch_form():
    state, out = State(), []
    for row in [r for r in SCANS if r[0] == "b"]:
        frame = pd.DataFrame([{"scan": row[1], "size_": row[2], "mtime": row[3]}])
        out += next(watch.step(("b",), iter([frame]), state, lambda p: True))["verdict"].tolist()
    assert out == ["awaiting", "failed", "held", "awaiting", "failed"]
    list(watch.step(("b",), iter([pd.DataFrame([{"scan": 9, "size_": -1, "mtime": 0}])]), state, lambda p: True))
    assert not state.exists


def test_watch_stream_runs(spark, tmp_path):
    source = str(tmp_path / "snapshots")
    spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in SCANS], "path string, scan long, size_ long, mtime long").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("path string, scan long, size_ long, mtime long").parquet(source)
    q = watch.watch_stream(stream, lambda p: p == "b").writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {(r["path"], r["scan"]): r["verdict"] for r in spark.table("verdicts").collect()}
    assert rows["a", 2] == "done" and rows["b", 3] == "held"


def test_hand_detectors_are_optional():
    from emulsia import detectors

    assert detectors.create_hand_detector(None) is None and detectors.create_hand_detector("mediapipe") is None
