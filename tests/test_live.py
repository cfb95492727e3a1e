"""Counts of a job from the pass that writes it, and how far it is while it runs."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from emulsia.operators import live

STATUS = "CASE id % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'skipped-larger' ELSE 'ok' END"


def results(spark, n=200, parts=8):
    return spark.range(0, n, numPartitions=parts).select(F.col("id"), F.expr(STATUS).alias("status"), (F.col("id") * 10).alias("original_size"), F.col("id").alias("compressed_size"))


def test_counts_equal_those_of_a_second_look_and_none_is_needed(spark, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    df = results(spark).mapInArrow(once, "id long, status string, original_size long, compressed_size long")
    *_, last = live.run(df, lambda rows: rows.write.parquet(str(tmp_path / "r")))
    back = spark.read.parquet(str(tmp_path / "r"))
    done = back.filter(F.col("status").isin(*live.DONE))
    assert last.ended and passes.value == 200 and last.counts == {
        "rows": 200, "done": done.count(), "failed": 20, "skipped": 20, "original_bytes": done.agg(F.sum("original_size")).first()[0], "compressed_bytes": done.agg(F.sum("compressed_size")).first()[0],
    }
    assert last.tasks_done == last.tasks >= 8


def test_progress_while_it_runs(spark, tmp_path):
    def slow(batches):
        for b in batches:
            time.sleep(0.6)
            yield b

    df = results(spark, 40, 12).mapInArrow(slow, "id long, status string, original_size long, compressed_size long")
    seen = list(live.run(df, lambda rows: rows.write.parquet(str(tmp_path / "r")), every=0.3))
    parts = [p.tasks_done for p in seen]
    assert parts == sorted(parts) and any(0 < p.tasks_done < p.tasks for p in seen[:-1]) and not any(p.ended for p in seen[:-1])


def test_no_rows_errors_and_leaving_early(spark, tmp_path):
    *_, last = live.run(results(spark, 0, 1), lambda rows: rows.write.parquet(str(tmp_path / "none")))
    assert set(last.counts.values()) == {0}
    with pytest.raises(Exception, match="no luck"):
        list(live.run(results(spark).withColumn("x", F.raise_error(F.lit("no luck"))), lambda rows: rows.write.parquet(str(tmp_path / "bad"))))

    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    began = time.monotonic()
    for p in live.run(results(spark, 40, 40).mapInArrow(slow, "id long, status string, original_size long, compressed_size long"), lambda rows: rows.write.parquet(str(tmp_path / "slow")), every=0.5):
        assert not p.ended
        break
    assert time.monotonic() - began < 60
