"""Hard negatives against a plain search over all rows."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from emulsia.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, id string, anchor string, score int, of int"


def plain(rows, every=10, low=30, high=90, positives=5, k=10):
    clean = []
    for i, label, v, *_ in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            bound = 2 ** ((62 - max(1, len(v) - 1).bit_length()) // 2)
            clean.append((i, label, [max(-bound, min(bound, math.floor(256 * x))) for x in v]))
    first = lambda found: sorted(found, key=lambda f: (-f[1], f[0] is None, f[0]))
    out = Counter()
    anchors = {(i, label, tuple(v)) for i, label, v in clean if i is not None and i % every == 0}
    for i, label, v in anchors:
        scored = [(j, sum(a * b for a, b in zip(v, w)), m == label) for j, m, w in clean if j != i]
        for pos, p, _ in first([s for s in scored if s[2]])[:positives]:
            near = first([s for s in scored if not s[2] and low * p <= 100 * s[1] <= high * p])[:k]
            for rank, (neg, n, _) in enumerate(near, 1):
                out[(i, pos, rank, neg, p, n)] += 1
    return out


def mined(df, every=10, **options):
    return Counter(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()))


def made(rng, n, dim=6, labels=4, spread=1.0):
    return [(i, rng.randrange(labels), [rng.gauss(0.2, spread) for _ in range(dim)], "x", "y", 1, 2) for i in range(n)]


def test_all_kinds_of_rows(spark):
    import numpy as np

    rng = random.Random(1)
    rows = made(rng, 300)
    hot = [0.5, 0.25, 0.5, 0.5, 0.0, 0.5]
    rows += [(1000 + i, i % 3, hot, None, None, None, None) for i in range(120)]  # one very common vector
    rows += [(None, 1, hot, "x", "y", 1, 2), (None, None, hot, None, None, None, None), (2001, 1, None, None, None, None, None)]
    rows += [(2010, 1, [0.1, float("nan")], "", "", 0, 0), (2020, 2, [float("inf")] * 6, "", "", 0, 0), (2030, 2, [None, 1.0], "", "", 0, 0)]
    rows += [(2040, 1, [], "", "", 0, 0), (2050, 2, [0.7, 0.9], "", "", 0, 0), (2060, 1, [0.4] * 9, "", "", 0, 0)]  # other lengths
    rows += [rows[0], rows[0], rows[7], (20, 3, [0.3] * 6, "", "", 0, 0), (-40, 0, [0.4] * 6, "", "", 0, 0), (-7, 1, hot, "", "", 0, 0)]
    rows = [(i, label, None if v is None else [None if x is None else float(np.float32(x)) for x in v], *more) for i, label, v, *more in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mined(df)
    assert got and got == plain(rows)
    assert mined(df.limit(0)) == Counter()
    assert mined(df.filter("vec_id % 10 <> 0")) == Counter()


@pytest.mark.parametrize("spread", [1.0, 3e4, 1e30])
def test_small_blocks_and_large_scores(spark, monkeypatch, spread):
    for name, value in (("ROWS", 16), ("ANCHORS", 3), ("CELL", 2), ("CHUNK", 4), ("DIGIT", 3)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(2)
    rows = [(i * 10**15 - 10**17, label, v, *more) for i, label, v, *more in made(rng, 200, spread=spread)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(4)
    assert mined(df, every=10**16) == plain(rows, every=10**16)


def test_ties_beyond_the_wanted_rank_go_to_the_least_ids(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0])] + [(i, 1, [0.5, 0.0]) for i in range(5000, 2, -1)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(7)
    got = mined(df, every=10**6)
    assert [n for _, _, _, n, _, _ in sorted(got)] == list(range(3, 13))


def test_other_parameters_and_scores_of_zero(spark):
    rng = random.Random(3)
    rows = made(rng, 150) + [(900 + i, i % 4, [0.0] * 6, "", "", 0, 0) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    assert mined(df, every=30, low=0, high=50, positives=3, negatives=4) == plain(rows, every=30, low=0, high=50, positives=3, k=4)


def test_report_moves_the_labels_of_every_seventh(spark):
    rng = random.Random(4)
    rows = made(rng, 400, labels=10)
    want = plain([(i, (label + 1) % 10 if i % 7 == 0 else label, v) for i, label, v, *_ in rows], every=100)
    got = Counter(map(tuple, negatives.report(spark.createDataFrame(rows, SCHEMA.replace("float", "double"))).collect()))
    assert got == want and defaultdict(int, got)
