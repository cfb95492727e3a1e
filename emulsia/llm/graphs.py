"""Connected components of a graph in a table, by alternating large and small stars.

Defined results: an edge without one of its ends, or from a vertex to itself, links nothing; repeated edges count once;
columns besides u and v aren't read; no edges give no rows. Vertices without an edge aren't in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _round(edges: DataFrame) -> DataFrame:
    """One large star and one small star: each vertex hands its neighbours to its least neighbour.

    A vertex's neighbours are never gathered: the least one is an aggregate, and a join (which adaptive execution
    splits for a hub) hands it to them.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    large = common.join_same(both, least.select("u", F.least("u", "m").alias("m")), ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = common.join_same(large, least, ["u"])
    return small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every vertex on an edge (u, v) of longs; root is the least vertex of its component.

    Each round is written to the shared folder; there are about as many rounds as the logarithm of the longest path.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = common.stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = mark(edges)
    while seen[0]:
        edges = common.stored(_round(edges), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges.select("u", F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
