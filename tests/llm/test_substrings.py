"""Substring dedup where hashes, ids and sizes are awkward."""

from __future__ import annotations

import random

import pytest

from emulsia.llm import substrings

from .test_operators import multiset, plain_dedup


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def dedup(spark, rows):
    table = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    return multiset(substrings.report(table), "doc_id", "n_words", "n_removed", "kept_sha256")


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_in_polynomial_hashes(spark, n):
    one = thue_morse(n)
    other = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"x {one} {tail}")]
    got = dedup(spark, rows)
    assert got == plain_dedup(rows)
    assert {k[0]: k[2] for k in got} == {1: 0, 2: 0, 3: 13}


def test_skewed_ids_hot_ids_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 4_000)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    text = lambda: " ".join([f"{rng.randrange(9999)}" for _ in range(rng.randint(5, 60))] + (passage[rng.randrange(20) :] if rng.random() < 0.5 else []))
    ids = [*range(60), *range(10**15, 10**15 + 60), *[7] * 60, *[None] * 60, -(10**12), 2**60, 2**60 + 1]
    rows = [(i, text()) for i in ids]
    rng.shuffle(rows)
    assert dedup(spark, rows) == plain_dedup(rows)


def test_chunks_hold_about_their_bytes(spark):
    rows = [(i, float(i), 100 if i % 50 else 9_000) for i in range(2_000)] + [(5, 5.0, 1_000)] * 90
    sizes = spark.createDataFrame(rows, "doc_id long, id double, n long")
    bounds, spread = substrings.chunk_edges(sizes, 10_000)
    edges = [float("-inf"), *bounds, float("inf")]
    load = [sum(n for i, _, n in rows if a <= i < b) for a, b in zip(edges, edges[1:])]
    assert sum(load) == sum(r[2] for r in rows) and bounds == sorted(set(bounds))
    for k, n in enumerate(load):
        assert n <= 10_000 or (k in spread and spread[k] >= n / 10_000)
    assert len(load) < 3 * sum(load) / 10_000
