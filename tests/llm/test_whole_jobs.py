"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
from emulsia.llm import packing, similar


def test_packing_splits_only_groups_too_heavy_for_a_shard(spark):
    pairs = [(i, f"pair {i // 2} " * (1 + i // 2 % 9)) for i in range(400)]
    middle = [(1000 + i, "a group of twelve ") for i in range(12)]
    heavy = [(2000 + i, "a group of many ") for i in range(200)]
    rows = pairs + middle + heavy
    at, load = defaultdict(set), Counter()
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        at[dict(rows)[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += 1
    assert all(len(at[t]) == 1 for _, t in pairs + middle)
    assert len(at[heavy[0][1]]) > 1 and max(load.values()) < 1.25 * len(rows) / 8


def test_near_dedup_stage_takes_all_near_copies(spark, empty):
    rng = random.Random(7)
    made = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, near = [], []
    for _ in range(40):
        base = made(120)
        texts.append(base)
        for at in (30, 60, 90):
            near.append([*base[:at], *made(1), *base[at + 1 :]])
    for _ in range(40):
        base = made(120)
        texts += [base, [x if i % 12 else f"z{rng.randrange(10**6)}" for i, x in enumerate(base)]]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, *near])]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(texts)))
    assert stage(spark, empty, "").count() == 0


def test_near_dedup_in_small_blocks_loses_no_link(spark, monkeypatch):
    """Copies of copies, each at 0.8 or more to the one before it, that share bands with many unlike texts."""
    monkeypatch.setattr(similar, "BLOCK", 3)
    rng = random.Random(11)
    made = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = made(90)
    texts = [passage + made(60) for _ in range(40)]  # unlike each other, but for the passage
    for k in range(8):
        last = texts[k]
        for _ in range(4):
            at = rng.randrange(20, 130)
            last = [*last[:at], *made(1), *last[at + 1 :]]
            texts.append(last)
    rng.shuffle(texts)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = stage(spark, spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root)) and len(set(root)) == 40
