"""The stages of the pipeline, and the queries with SQL, on the smallest tables."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from emulsia.llm import common, queries  # noqa: E402

from .test_operators import plain_repeats, plain_targets, split  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, found = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    key = lambda rows, names: sorted(tuple(repr(r[names.index(c)]) for c in order) for r in rows)
    assert key(df.collect(), df.columns) == key(found.fetchall(), found.columns)


def plain_kept(text):
    w, t = split(text), text or ""
    lines = [x for x in t.split("\n") if split(x)]
    n, chars = len(w), sum(map(len, w))
    bad = n < 20 or 100 * plain_repeats(w) > 30 * n or 100 * len(re.findall(r"[#*$%&|<>]", t)) > 20 * n or 2 * (len(lines) - len(set(lines))) > len(lines)
    return not (bad or 2 * t.count("!") > n or chars > 16 * n or 5 * len(re.findall("[0-9]", t)) > 2 * chars)


def plain_first(rows):
    """Ids of the first rows of the groups linked at 0.8 on five-word shingles."""
    sets = []
    for r in rows:
        w = [x for x in split(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if not (a or sets[j]) or both >= 0.8 * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if k in (x, y) else k for k in root]
    least = {}
    for r, k in zip(rows, root):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    return set(least.values())


def plain_hit(text, windows):
    w = plain_words(text)
    return any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_stages(spark):
    """Each stage against a plain version of its own on the rows that reach it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda rows: sorted(r["doc_id"] for r in rows)

    def after(name, df):
        out = common.stored(stages[name](spark, df, SF), "t")
        assert out.columns[:5] == docs.columns
        return out, out.collect()

    kept, rows = after("quality_rules", docs)
    assert ids(rows) == ids(r for r in docs.collect() if plain_kept(r["text"]))
    first, left = after("simhash_near_dedup", kept)
    assert ids(left) == sorted(plain_first(rows)) and len(left) < len(rows)
    clean, rows = after("decontamination", first)
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = plain_words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    assert ids(rows) == ids(r for r in left if not plain_hit(r["text"], windows)) and len(rows) < len(left)

    mixed, taken = after("mixing", clean)
    sizes, got, of = Counter(), Counter(), {r["doc_id"]: r for r in rows}
    for r in rows:
        sizes[r["source"]] += len(split(r["text"]))
    times = Counter()
    for r in taken:
        whole = of[r["doc_id"]]
        assert r["source"] == whole["source"] and not Counter(split(r["text"])) - Counter(split(whole["text"]))
        got[r["source"]] += len(split(r["text"]))
        times[r["doc_id"]] += len(split(r["text"]))
    assert all(abs(got[s] - t) <= 1 for s, t in plain_targets(sizes).items())
    assert all(n <= 2 * len(split(of[i]["text"])) for i, n in times.items())

    _, last = after("sharding", mixed)
    assert Counter((r["doc_id"], r["text"]) for r in last) == Counter((r["doc_id"], r["text"]) for r in taken)
    size, at = Counter(), {}
    for r in last:
        size[r["shard"]] += len(r["text"].encode()) + 1
        assert at.setdefault(r["text"], r["shard"]) == r["shard"]
    for s in range(8):
        assert sorted(r["slot"] for r in last if r["shard"] == s) == list(range(sum(r["shard"] == s for r in last)))
    longest = max(len(r["text"].encode()) for r in last)
    assert max(size.values()) - min(size.values()) <= longest


def test_run(spark):
    done = corpus_pipeline.run(spark, SF)
    assert done.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"] and done.count() > 0


def test_stages_take_awkward_rows(spark, docs, empty):
    kept = {r["doc_id"] for r in docs.collect() if plain_kept(r["text"])}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        assert got.columns[: len(docs.columns)] == docs.columns and rows
        if name == "quality_rules":
            assert {r["doc_id"] for r in rows} == kept
        if name in ("quality_rules", "simhash_near_dedup", "decontamination"):
            assert len(rows) <= docs.count()
        if name == "sharding":
            assert len(rows) == docs.count()
        none = stage(spark, empty, SF)
        assert none.count() == 0 and none.columns == got.columns
