"""What a running job says about itself: tasks done while it runs, and its counts when it ends, from the same pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: The statuses of a row that count as done, and as failed.
DONE, FAILED = ("ok", "skipped-larger", "kept-original", "skipped-unchanged"), ("failed", "timeout")


@dataclass
class Progress:
    """Tasks done of those known so far and, in the last one only, the counts of the rows."""

    tasks_done: int
    tasks: int
    counts: dict[str, int] = field(default_factory=dict)
    ended: bool = False


def counted(results: DataFrame) -> tuple[DataFrame, Observation]:
    """Results (status, original_size, compressed_size) that count themselves in the pass that writes them."""
    seen = Observation(f"results-{uuid.uuid4().hex}")
    status = F.col("status")
    number = lambda when: F.count(F.when(when, 1))
    size = lambda c: F.coalesce(F.sum(F.when(status.isin(*DONE), F.col(c))), F.lit(0)).cast("long")
    return results.observe(
        seen, F.count("*").alias("rows"), number(status.isin(*DONE)).alias("done"), number(status.isin(*FAILED)).alias("failed"), number(status == "skipped").alias("skipped"),
        size("original_size").alias("original_bytes"), size("compressed_size").alias("compressed_bytes"),
    ), seen


def run(results: DataFrame, write: Callable[[DataFrame], object], every: float = 1.0) -> Iterator[Progress]:
    """Writes the results once and tells how far it is; the last word has the counts of what was written.

    An error of the job is raised here. Leaving the loop early cancels the job.
    """
    context = results.sparkSession.sparkContext
    group, wrong = f"emulsia-{uuid.uuid4().hex}", []
    rows, seen = counted(results)

    def job() -> None:
        try:
            context.setJobGroup(group, "results", interruptOnCancel=True)
            write(rows)
        except BaseException as e:  # noqa: BLE001 - raised again where the caller is
            wrong.append(e)

    def tasks() -> tuple[int, int]:
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(j) or ((), (), ""))[1]]
        known = [s for s in stages if s]
        return sum(s.numCompletedTasks for s in known), sum(s.numTasks for s in known)

    thread = InheritableThread(target=job)
    thread.start()
    try:
        while thread.is_alive():
            thread.join(every)
            if thread.is_alive():
                yield Progress(*tasks())
    finally:
        if thread.is_alive():
            context.cancelJobGroup(group)
            thread.join()
    if wrong:
        raise wrong[0]
    yield Progress(*tasks(), dict(seen.get), True)
