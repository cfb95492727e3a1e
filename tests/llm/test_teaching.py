"""Co-training against plain counts: what is taught, how it weighs, and that either view can teach the other."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from emulsia.llm import cotraining as c

SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, length long").repartition(3)


def made(n, seed, informative):
    """Documents whose words (or, if not, whose sources) tell good from bad; rows and labels."""
    rng = random.Random(seed)
    rows, good = [], {}
    for i in range(n):
        y = rng.random() < 0.5
        words = ["calm", "even", "kind"] if y else ["vile", "rude", "junk"]
        text = " ".join(rng.choice(words if informative else ["calm", "vile", "even"]) for _ in range(20))
        rows.append((i, text + f" w{rng.randrange(50)}", "en", f"s{int(y)}-{rng.randrange(120)}", 100))
        good[i] = y
    return rows, good


def test_taught_counts_against_plain_ones(spark):
    rows, good = made(400, 1, True)
    labels = spark.createDataFrame([(i, int(good[i]), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    model = c.fit(docs, labels, rounds=0)
    got = c.teacher(docs.filter("doc_id >= 100"))(model)
    plain = {v: [Counter(), Counter()] for v in c.SIZES}
    for _, text, lang, source, length in rows[100:]:
        f = {"text": c.text_features(text), "meta": c.meta_features(lang, source, length)}
        one = {v: c.Sparse.of([x]) for v, x in f.items()}
        p, q, _ = (s[0] for s in model.scores(one["text"], one["meta"]))
        for pupil, sure in (("meta", p), ("text", q)):
            for label in (0, 1):
                if (sure if label else 1 - sure) >= c.SURE:
                    plain[pupil][label].update([*f[pupil][0], -1])
    assert got["meta"].documents.sum() > 200
    for v in c.SIZES:
        for k in (0, 1):
            assert got[v].documents[k] == plain[v][k].pop(-1, 0)
            assert {i: n for i, n in enumerate(got[v].features[k]) if n} == plain[v][k]


def test_the_sure_view_teaches_the_other(spark):
    rows, good = made(2500, 2, True)
    labels = spark.createDataFrame([(i, int(good[i]), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)

    def right(model):
        some = [r for r in rows if r[0] >= 100]
        _, meta, _ = model.scores(c.Sparse.of([c.text_features(r[1]) for r in some]), c.Sparse.of([c.meta_features(*r[2:]) for r in some]))
        return np.mean([(p > 0.5) == good[r[0]] for p, r in zip(meta, some)])

    alone, taught = right(c.fit(docs, labels, rounds=0)), right(c.fit(docs, labels))

    assert taught > 0.9 > alone + 0.1, (alone, taught)


def test_combination_is_calibrated_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = c.score(docs, labels.filter("doc_id % 4 <> 0")).join(labels.filter("doc_id % 4 = 0"), "doc_id").collect()
    good = np.array([r["quality"] == 1 and not r["toxic"] for r in scored])
    p = np.array([r["score"] for r in scored])
    assert p[good].mean() > 0.85 and p[[r["quality"] == 0 for r in scored]].mean() < 0.1
    assert abs(p.mean() - good.mean()) < 0.1
    assert len({r["score"] for r in scored}) > 10
    kept = [r["score"] for r in scored if r["keep"]]
    assert min(kept) > max((r["score"] for r in scored if not r["keep"]), default=0) and c.KEEP[0] <= min(kept)


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_toxic_documents_go(spark, sf):
    docs, labels = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    rows = c.score(docs, labels.filter("doc_id % 3 <> 0")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    kept = lambda f: np.mean([r["keep"] for r in rows if f(r)])
    clean, junk, toxic = kept(lambda r: r["quality"] == 1 and not r["toxic"]), kept(lambda r: r["quality"] == 0), kept(lambda r: r["toxic"])
    print("clean", clean, "junk", junk, "toxic", toxic)
    assert clean > 0.98 and junk < 0.03 and toxic < 0.15
