"""The watched inbox: two-scan stability, blocked files, and a streaming form over snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stability(scans: DataFrame) -> DataFrame:
    """scans (path, scan, size, mtime) with `stable`: size and mtime equal those of the scan just before."""
    w = Window.partitionBy("path").orderBy("scan")
    same = (F.lag("scan").over(w) == F.col("scan") - 1) & (F.lag("size").over(w) == F.col("size")) & (F.lag("mtime").over(w) == F.col("mtime"))
    return scans.withColumn("stable", F.coalesce(same, F.lit(False)))


def blocked_runs(scans: DataFrame) -> DataFrame:
    """stability(...) with `held` and `retried`, for scans that say whether processing would fail.

    A stable file that fails is blocked at its stat and held while path, size and mtime stay; a gap in the scans (the
    file vanished) or another stat ends that. So a run of equal stats is tried at its first stable scan, and held after
    it if that failed.
    """
    w = Window.partitionBy("path").orderBy("scan")
    runs = stability(scans).withColumn("run", F.sum(F.when(F.col("stable"), 0).otherwise(1)).over(w))
    in_run = Window.partitionBy("path", "run").orderBy("scan").rowsBetween(Window.unboundedPreceding, -1)
    failed_before = F.coalesce(F.max(F.when(F.col("stable") & F.col("fails"), 1)).over(in_run), F.lit(0)) == 1
    return runs.withColumns({"held": F.col("stable") & failed_before, "tried": F.col("stable") & ~failed_before}).drop("run")


STATE = "size long, mtime long, blocked_size long, blocked_mtime long"
VERDICT = "path string, scan long, verdict string"


def step(key: tuple, batches: Iterator[pd.DataFrame], state, fails: Callable[[str], bool]) -> Iterator[pd.DataFrame]:
    """One key of a snapshot stream: verdict awaiting, held, failed or done for each scan of the path."""
    rows = pd.concat(list(batches)).sort_values("scan")
    size, mtime, bad_size, bad_mtime = state.get if state.exists else (-1, -1, -1, -1)
    out = []
    for r in rows.itertuples():
        if r.size_ < 0:
            size, mtime, bad_size, bad_mtime = -1, -1, -1, -1
            continue
        if (size, mtime) != (r.size_, r.mtime):
            verdict = "awaiting"
        elif (bad_size, bad_mtime) == (r.size_, r.mtime):
            verdict = "held"
        elif fails(key[0]):
            verdict, bad_size, bad_mtime = "failed", r.size_, r.mtime
        else:
            verdict = "done"
        size, mtime = r.size_, r.mtime
        out.append((key[0], r.scan, verdict))
    if size < 0:
        state.remove()
    else:
        state.update((size, mtime, bad_size, bad_mtime))
    yield pd.DataFrame(out, columns=["path", "scan", "verdict"])


def watch_stream(snapshots: DataFrame, fails: Callable[[str], bool]) -> DataFrame:
    """A stream of snapshots (path, scan, size_, mtime; size_ -1: vanished) to verdicts, with keyed state."""
    run = lambda key, batches, state: step(key, batches, state, fails)
    return snapshots.groupBy("path").applyInPandasWithState(run, VERDICT, STATE, "append", "NoTimeout")
