"""What an expression uses more than once is computed once a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emulsia.functions.binding import bound
from emulsia.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, text, times", [("clip_probe", "from_json(", 1), ("hand_regions", "aggregate(", 3), ("box_merge_fixpoint", "aggregate(", 2)])
def test_a_query_computes_it_once(spark, name, text, times):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(text) == times


def test_a_bound_value_may_be_null(spark):
    got = spark.createDataFrame([(None,), (2,)], "x int").coalesce(1).select(bound(F.col("x"), lambda x: F.coalesce(x * x, F.lit(-1))).alias("y"))
    assert [r["y"] for r in got.collect()] == [-1, 4]
