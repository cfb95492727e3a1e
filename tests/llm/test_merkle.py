"""Merkle manifest and proofs against a plain version."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest

from emulsia.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return H(*map(field, (r[0], r[3], r[2], r[4], text)))


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def plain(rows):
    first = lambda x: (x is not None, x)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((first(r[0]), leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in order}
    top = levels_of([trees[g][-1][0] for g in order])
    out = Counter()
    for g in order:
        for at, (_, own, r) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            siblings, folded = [], own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                folded = leaf(r, lowered(r[1]))
            for levels, i in ((trees[g], at), (top, order.index(g))):
                for nodes in levels[:-1]:
                    run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
                    siblings += run[: i % 8] + run[i % 8 + 1 :]
                    folded = H(*run[: i % 8], folded, *run[i % 8 + 1 :])
                    i //= 8
            out[(r[0], own, trees[g][-1][0], top[-1][0], H(*siblings), folded, folded == top[-1][0])] += 1
    return out


def report(spark, rows, schema=SCHEMA):
    return Counter(map(tuple, merkle.report(spark.createDataFrame(rows, schema).repartition(3)).collect()))


def made(n, langs=("en",)):
    return [(i * 7 % 1009, f"Text {i} Of Many" if i % 5 else f"low {i}", langs[i % len(langs)], f"s{i % 3}", i) for i in range(n)]


def test_all_kinds_of_rows(spark, docs, rows, empty):
    assert Counter(map(tuple, merkle.report(docs).collect())) == plain(rows)
    assert merkle.report(empty).count() == 0


@pytest.mark.parametrize("n", [1, 9, 73])
def test_one_group(spark, n):
    assert report(spark, made(n)) == plain(made(n))


@pytest.mark.parametrize("small", [0, 1 << 16])
def test_many_groups_with_and_without_a_broadcast(spark, monkeypatch, small):
    monkeypatch.setattr(merkle, "SMALL", small)
    langs = [None, "", "é", "z", "Z", "日本", *[f"l{i}" for i in range(70)]]
    rows = made(300, langs) + made(200, ("en",))
    assert report(spark, rows) == plain(rows)


def test_rows_that_are_all_alike(spark):
    rows = [(None, None, None, None, None)] * 100 + [(5, "A", "en", "s", 1)] * 20
    assert report(spark, rows) == plain(rows)


def test_a_changed_row_is_told_and_the_others_hold(spark):
    rows = made(100, ("de", "en", None))
    got = report(spark, rows)
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 0 and lowered(r[1]) != r[1]}
    assert changed and {x[0] for x in got if not x[6]} == changed


def test_general_fields_and_size(spark):
    rows = made(50, ("a", "b"))
    m = merkle.build(spark.createDataFrame(rows, SCHEMA), fields=("doc_id", "text"), group="source", size=3)
    leaves = merkle.proofs(m).collect()
    assert len(leaves) == 50 and m.groups == 3
    want = {r[0]: H(field(r[0]), field(r[1])) for r in rows}
    assert all(r["leaf"].hex() == want[r["key"]] for r in leaves)
    roots = {r[0] for r in merkle.proofs(m).select(merkle.folded(m, merkle.F.col("leaf"))).collect()}
    assert len(roots) == 1
