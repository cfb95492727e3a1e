"""Columns named like the operators' own, groups kept whole, and draws that decide the output shard."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from emulsia.llm import common, mixing, packing, simhash

OWN = "__rank __range __run __sum_0 __base_0 __g0 __d __n __p __item __piece __key __part __copy __digest __id __who __count __at __hits __size __nth".split()


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "rho", "tau"]) + str(rng.randrange(300)) for _ in range(rng.randint(20, 60)))
    rows = [(i, text(), "en", f"s{i % 3}", 1, *[f"{n}-{i}" for n in OWN]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in OWN))


def test_stages_keep_columns_named_like_their_own(spark, clashing):
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, clashing, "/root/testdata/sf0.001")
        assert got.columns[: len(clashing.columns)] == clashing.columns
        rows = got.collect()
        assert len(rows) > 20, name
        for r in rows:
            assert all(r[n] == f"{n}-{r['doc_id']}" for n in OWN), name


def test_prefix_sums_against_plain_sums(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), rng.randint(1, 9), "kept") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, n long, __rank string")
    got = common.prefix_sums(df, ["g"], ["id"], {"s": "n"}, per_bucket=7)
    assert got.columns == ["id", "g", "n", "__rank", "s"]
    by = defaultdict(list)
    for r in got.collect():
        assert r["__rank"] == "kept"
        by[r["g"]].append((r["s"], r["n"]))
    for parts in by.values():
        total = 0
        for s, n in sorted(parts):
            assert s == total
            total += n
    assert sum(map(len, by.values())) == len(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_groups_of_equal_texts_stay_whole(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    at, size, rows = defaultdict(set), Counter(), Counter()
    for r in packing.pack(docs).collect():
        at[text[r["doc_id"]]].add(r["shard"])
        size[r["shard"]] += r["size"]
        rows[r["shard"]] += 1
    assert all(len(s) == 1 for s in at.values())
    if sf == "sf0.01":
        for load in (size, rows):
            assert max(load.values()) < 1.02 * sum(load.values()) / 8 and min(load.values()) > 0.98 * sum(load.values()) / 8


def test_groups_placed_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELLS", 4)
    monkeypatch.setattr(packing, "PART_ROWS", 500)
    rng = random.Random(8)
    rows = [(i, f"text {i // 2} " * rng.randint(1, 9)) for i in range(4000)] + [(10_000 + i, "a large group") for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    at, load, text = defaultdict(set), Counter(), dict(rows)
    for r in packing.pack(table).collect():
        at[text[r["doc_id"]]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in at.values()) and max(load.values()) < 1.02 * sum(load.values()) / 8
    got = packing.shard_rows(table.unionAll(table)).collect()
    assert len(got) == 2 * len(rows)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_drawn_counts_deal_the_slots(spark):
    rng = random.Random(9)
    rows = [(i, f"s{i % 3}", rng.randint(100, 900)) for i in range(400)]
    slim = spark.createDataFrame(rows, "key long, source string, size long")
    sources, slots, _ = mixing.plan(slim, len(rows), shard_words=20_000)
    wanted = {r["source"]: r["wanted"] for r in sources.collect()}
    got = slots.collect()
    shards = -(-sum(wanted.values()) // 20_000)
    taken, count = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["words"]
        count[r["source"], r["out_shard"]] += 1
    assert taken == wanted and len({r["out_shard"] for r in got}) == shards
    for s in wanted:
        mine = sorted((r["slot"], r["out_shard"]) for r in got if r["source"] == s)
        assert [o for _, o in mine] == sorted(o for _, o in mine)
        n = len(mine)
        # a multinomial draw: no count is the same for all shards, none is six deviations off
        assert all(abs(count[s, k] - n / shards) < 6 * (n / shards) ** 0.5 for k in range(shards)) and len({count[s, k] for k in range(shards)}) > 1


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_one_id_in_two_groups_stays_in_each(spark, similarity):
    rng = random.Random(10)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(5, a, 1), (5, b, 2), (7, a, 3), (8, b, 4), (9, c, 5), (9, c, 6), (None, d, 7), (None, a, 8), (None, d, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__d` int")
    got = simhash.keep_first(docs, shingle=5, similarity=similarity)
    assert got.columns == docs.columns
    assert sorted(Counter((r["doc_id"], r["text"]) for r in got.collect()).items(), key=repr) == sorted({(5, a): 1, (5, b): 1, (9, c): 1, (None, d): 2}.items(), key=repr)
