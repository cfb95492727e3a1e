"""The near-dedup stage goes through SimHash fingerprints and BK-trees."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from emulsia.llm import common, similar, trees


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, size=(6, 8), dtype=np.uint64)
    points = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, size=base.shape, dtype=np.uint64)) * (rng.random(base.shape) < 0.6) for _ in range(40)], base[:2]])
    d = trees.distances(points[:, None], points[None])
    for radius in (0, 4, 9):
        tree, found = trees.Tree(points, radius), set()
        for who, point in tree.search(points):
            found |= {(w, int(m)) for w, p in zip(who.tolist(), point.tolist()) for m in tree.members[p]}
        assert found == set(zip(*(x.tolist() for x in np.nonzero(d <= radius))))
        assert (trees.befriended(points, radius) == ((d <= radius).sum(axis=1) > 1)).all()
    assert not list(trees.Tree(points[:0], 4).search(points))


def test_fingerprints_of_near_copies_meet_in_a_tree():
    rng = random.Random(5)
    made = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (8, 30, 400):
        for _ in range(20):
            base = made(n)
            texts += [" ".join(base), " ".join([*base, *made((n - 4) // 4)])]  # 0.8 on five-word shingles
    sets = [similar.shingles(t, 5) for t in texts]
    sums = np.stack([similar.counts(s) for s in sets])
    assert (sums % 2 == np.array([[len(s) % 2] for s in sets])).all() and (abs(sums) <= np.array([[len(s)] for s in sets])).all()
    prints, keys = np.packbits(sums > 0, axis=1).view(np.uint64), similar.keys(sums, similar.WINNERS)
    for i in range(0, len(texts), 2):
        assert similar.jaccard(sets[i], sets[i + 1]) >= 0.8 and (keys[i] == keys[i + 1]).any()
        assert trees.befriended(prints[i : i + 2, :2], similar.NEAR).all() and trees.befriended(prints[i : i + 2], similar.WIDE).all()
        other = (i + 2) % len(texts)
        assert not trees.befriended(prints[[i, other]], similar.WIDE).any()


def test_a_text_asks_one_head_and_texts_move_once(spark, tmp_path, monkeypatch):
    """Near copies of one text share shards with many heads: that makes neither more questions nor more moves of the texts."""
    rng = random.Random(9)
    made = lambda n: [f"u{rng.randrange(10**6)}" for _ in range(n)]
    base = made(150)
    near = [[*base[:at], *made(1), *base[at + 1 :]] for at in (rng.randrange(150) for _ in range(120))]
    rows = [(i, " ".join(t)) for i, t in enumerate([base, *near, *(made(150) for _ in range(40))])]
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    docs, counted, reads, plain = spark.read.parquet(path), {}, [], common.stored

    def stored(df, name):
        reads.extend([name] if any(path in f for f in df.inputFiles()) else [])
        out = plain(df, name)
        counted[name] = counted.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(common, "stored", stored)
    found = similar.roots(docs, F.col("text"), 5, 0.8).collect()
    assert len(found) == 121 and len({r["root"] for r in found}) == 1
    assert 0 < counted["candidates"] <= 121 and len(reads) == 2


def test_a_pair_is_met_in_one_shard(spark, monkeypatch):
    """Texts that are alike, but not enough, share several shards; their sets move to one of them."""
    rng = random.Random(13)
    made = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(30):
        base = made(200)
        texts += [base, [w if i % 33 else x for i, (w, x) in enumerate(zip(base, made(200)))]]
    counted, plain = {}, common.stored

    def stored(df, name):
        out = plain(df, name)
        counted[name] = counted.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(common, "stored", stored)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert not similar.roots(docs, F.col("text"), 5, 0.8).collect()
    assert 0 < counted["shard-met"] <= 60


def prints_of(n, rng, copies=0):
    base = rng.integers(-(1 << 62), 1 << 62, size=(n, 2), dtype=np.int64)
    near = base[rng.integers(0, n, size=copies)] ^ (np.int64(1) << rng.integers(0, 60, size=(copies, 2)))
    return np.concatenate([base, near])


def test_crowded_shards_are_searched_in_blocks_and_lose_no_neighbour(spark, monkeypatch):
    """Shards of unrelated texts, of near copies, and of both, with equal fingerprints, of many times a block."""
    rng = np.random.default_rng(21)
    for block in (4, 16):
        monkeypatch.setattr(similar, "BLOCK", block)
        rows, want = [], set()
        for key, (n, copies, equal) in enumerate([(90, 0, 0), (3, 80, 0), (70, 25, 9), (2, 0, 0), (1, 0, 3), (1, 1, 0), (5, 2, 1)]):
            p = prints_of(n, rng, copies)
            p = np.concatenate([p, p[:1].repeat(equal, axis=0)])
            d = trees.distances(p.view(np.uint64)[:, None], p.view(np.uint64)[None])
            ok = (d <= similar.NEAR).sum(axis=1) > 1
            rows += [(key, int(a), int(b)) for a, b in p]
            want |= {(key, int(a), int(b)) for a, b in p[ok]}
        random.Random(block).shuffle(rows)
        df = spark.createDataFrame(rows, "key long, a long, b long").repartition(3)
        with common.arrow_rows(spark, 7):
            got = [tuple(r) for r in similar._sharded(df).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_work_on_a_crowded_shard_of_unrelated_texts_is_bounded_per_task(monkeypatch):
    """A run of ten blocks compares each fingerprint with its block only."""
    import pyarrow as pa

    rng, compared = np.random.default_rng(4), []
    plain = trees.distances
    monkeypatch.setattr(trees, "distances", lambda a, b: compared.append(np.broadcast_shapes(a.shape, b.shape)[:-1]) or plain(a, b))
    counted = {}
    for n in (2_000, 4_000, 8_000):
        compared.clear()
        p = prints_of(n, rng)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        batches = [pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int64)), pa.array(x[:, 0]), pa.array(x[:, 1])], names=["key", "a", "b"]) for x in np.array_split(p, 13)]
        out = list(similar._befriended(256)(iter(batches)))
        assert sum(b.num_rows for b in out) == n
        counted[n] = sum(int(np.prod(s)) for s in compared)
    assert counted[8_000] < 2.2 * counted[4_000] < 4.9 * counted[2_000]  # in proportion to the rows, not to their square


def test_many_open_members_are_cut_like_the_members(spark, monkeypatch):
    """Texts alike by half that share shards, and pairs among them that are alike enough: small cells find the same groups."""
    rng = random.Random(17)
    made = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    passage = made(110)
    texts = [passage + made(40) for _ in range(30)]
    texts += [[*t[:-3], *made(3)] for t in texts[:12]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = None
    for block in (4096, 5, 2):
        monkeypatch.setattr(similar, "BLOCK", block)
        found = {r["point"]: r["root"] for r in similar.roots(docs, F.col("text"), 5, 0.8).collect()}
        want = found if want is None else want
        assert found == want and len(found) == 24 and len(set(found.values())) == 12


def test_both_schemes_of_keys_find_pairs_near_the_bound():
    """Pairs at 0.80 to 0.85, of three sizes: those that share no shard are under one in a hundred under either number of winners."""
    rng = random.Random(23)
    made = lambda n: [f"k{rng.randrange(10**6)}" for _ in range(n)]
    pairs = []
    while len(pairs) < 240:
        base = made((40, 120, 400)[len(pairs) % 3])
        changed = [*base[: len(base) - len(base) // 10], *made(len(base) // 10)]
        a, b = (similar.shingles(" ".join(t), 5) for t in (base, changed))
        if 0.8 <= similar.jaccard(a, b) <= 0.85:
            pairs.append((a, b))
        elif len(base) == 40:
            a, b = (similar.shingles(" ".join(t), 5) for t in (base, [*base[:-4], *made(4)]))
            pairs.append((a, b)) if similar.jaccard(a, b) >= 0.78 else None
    left, right = (np.stack([similar.counts(p[k]) for p in pairs]) for k in (0, 1))
    for winners in similar.KEYS:
        shared = (similar.keys(left, winners) == similar.keys(right, winners)).sum(axis=1)
        assert (shared == 0).mean() <= 0.01 and np.median(shared) >= 5, (winners, np.bincount(shared)[:4])
