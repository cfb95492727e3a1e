"""Order statistics of large groups: no task ranks a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = 256


def ranked_values(rows: DataFrame, group: str, value: str, wanted: DataFrame) -> DataFrame:
    """(group, nth, value): the nth smallest value of each group, from 1; wanted has (group, nth).

    Approximate quantiles cut each group into ranges, the ranges are counted exactly, and only the ranges that hold a
    wanted rank are ranked. Values that tie at a cut share a range and are grouped, so a range's distinct values are
    few whatever their number.
    """
    own, cuts, at, n, before, rank = "__own", "__cuts", "__at", "__n", "__before", "__rank"
    shares = [i / CUTS for i in range(1, CUTS)]
    bounds = rows.groupBy(group).agg(F.array_distinct(F.percentile_approx(value, shares, 20 * CUTS)).alias(cuts)).withColumnRenamed(group, own)
    # a row's range is the number of cuts below its value, found in an array of CUTS numbers
    placed = rows.select(group, value).join(bounds, F.col(group).eqNullSafe(F.col(own))).withColumn(at, F.size(F.filter(cuts, lambda c: c < F.col(value))))
    counts = placed.groupBy(group, at, value).agg(F.count("*").alias(n))
    ranges = counts.groupBy(group, at).agg(F.sum(n).alias("__size"))
    ranges = ranges.withColumn(before, F.coalesce(F.sum("__size").over(Window.partitionBy(group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    named = wanted.select(F.col(group).alias(own), "nth")
    hit = ranges.join(named, F.col(group).eqNullSafe(F.col(own)) & (F.col("nth") > F.col(before)) & (F.col("nth") <= F.col(before) + F.col("__size")))
    hit = hit.select(F.col(group).alias(own), F.col(at).alias("__hit"), "nth", before)
    near = counts.join(hit.select(own, "__hit").distinct(), F.col(group).eqNullSafe(F.col(own)) & (F.col(at) == F.col("__hit")), "left_semi")
    up_to = Window.partitionBy(group, at).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn(rank, F.sum(n).over(up_to))
    joined = near.join(hit, F.col(group).eqNullSafe(F.col(own)) & (F.col(at) == F.col("__hit")))
    found = joined.filter((F.col("nth") - F.col(before) <= F.col(rank)) & (F.col("nth") - F.col(before) > F.col(rank) - F.col(n)))
    return found.select(group, "nth", value)
