"""Bounded searches over candidates, as folds that run inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges and numbers of probes.
QUALITY = (40, 95, 6)
CRF = (20, 55, 6)
GATE_STEP, GATE_FLOOR, GATE_RETRIES = 4, 18, 2


def lowest_quality(passes: Callable[[Column], Column]) -> Column:
    """Six halvings for the least quality that passes; the end isn't checked, so all-passing probes end one below the range."""
    low, high, probes = QUALITY
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(None).cast("int").alias("best"))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        ok = passes(mid)
        return F.struct(F.when(ok, a["lo"]).otherwise(mid + 1).alias("lo"), F.when(ok, mid - 1).otherwise(a["hi"]).alias("hi"), F.when(ok, mid).otherwise(a["best"]).alias("best"))

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(probes)), start, step)["best"], F.lit(high))


def highest_crf(passes: Callable[[Column], Column]) -> Column:
    """Halvings for the greatest factor that passes, while the range isn't empty; the floor if none does."""
    low, high, probes = CRF
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(None).cast("int").alias("best"))

    def step(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        ok, live = passes(mid), a["lo"] <= a["hi"]
        return F.struct(F.when(live & ok, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(live & ~ok, mid - 1).otherwise(a["hi"]).alias("hi"), F.when(live & ok, mid).otherwise(a["best"]).alias("best"))

    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(probes)), start, step)["best"], F.lit(low))


def gated_crf(first: Column, passes: Callable[[Column], Column]) -> Column:
    """(crf, retries, passed): a failed gate retries at a smaller factor, at most twice and not below the floor."""
    start = F.struct(first.alias("crf"), F.lit(0).alias("retries"), passes(first).alias("passed"))

    def step(a: Column, _: Column) -> Column:
        lower = F.greatest(F.lit(GATE_FLOOR), a["crf"] - GATE_STEP).cast("int")
        again = ~a["passed"] & (a["crf"] > GATE_FLOOR)
        return F.struct(F.when(again, lower).otherwise(a["crf"]).alias("crf"), (a["retries"] + again.cast("int")).alias("retries"), F.when(again, passes(lower)).otherwise(a["passed"]).alias("passed"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(GATE_RETRIES)), start, step)


def cheapest(candidates: Column) -> Column:
    """The candidate (bytes, preference, ...) with the fewest bytes, then the least preference."""
    return F.array_min(candidates)


def best_scale(candidates: Column, target: Column, floor: Column) -> Column:
    """Of the scales above floor, the least within the target distance, else the one with the least distance, else floor.

    candidates: array<struct<scale,distance>>.
    """
    candidates = F.filter(candidates, lambda c: c["scale"] > floor)
    within = F.array_min(F.transform(F.filter(candidates, lambda c: c["distance"] <= target), lambda c: c["scale"]))
    closest = F.array_min(F.transform(candidates, lambda c: F.struct(c["distance"].alias("distance"), c["scale"].alias("scale"))))["scale"]
    return F.coalesce(within, closest, floor)


def sample_spans(duration: Column) -> Column:
    """One span of a clip of up to 18 s or of unknown length, else three of 3 s about 15, 50 and 85 %."""
    short = F.array(F.struct(F.lit(0.0).alias("start"), F.greatest(duration, F.lit(3.0)).alias("length")))
    long = F.transform(F.array(F.lit(0.15), F.lit(0.5), F.lit(0.85)), lambda p: F.struct(F.round(F.greatest(F.lit(0.0), duration * p - 1.5), 3).alias("start"), F.lit(3.0).alias("length")))
    return F.when(duration <= 18.0, short).otherwise(long)
