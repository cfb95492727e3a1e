"""Near-duplicates by SimHash and BK-trees.

Fingerprints of equal texts are one vertex. A fingerprint is sent to the shards whose key it has: a key is two of its
four 16-bit blocks, so two fingerprints that differ in two bits or fewer share a key (the bits touch two blocks at
most), and the shards lose no link. Each shard is a BK-tree: the children of a node are keyed by their integer Hamming
distance to it, and a search follows the edges within the radius of the distance to the node. A shard's tree stays
with the task that searches it, since sending all trees everywhere would take every fingerprint through the driver.
A shard over SHARD_ROWS fingerprints is cut by a third of the bits that its key leaves open (one of the three thirds must
agree), and again while it is over, so no tree is larger: 32 open bits become 22, 15 and 10, and 10 bits tell 1024
fingerprints apart. Within a shard, links are joined before they are written, so a tight group gives a star and not all
its pairs.

Defined results: a null text has no words and the fingerprint zero; a null id never names a group, and a group without
any id has the component null; a very long text is hashed whole; repeated rows are rows of their own; columns of docs
may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graphs, similar

SHINGLE = 3
SEED = 42
RADIUS = 2
SHARD_ROWS = 2048
_PIECE = 1 << 16


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half of the XXH64 hashes of the shingles, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    lower = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    a, b = starts[:n].tolist(), ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _PIECE):
        hashes = np.fromiter((digest(lower[x:y], SEED) for x, y in zip(a[i : i + _PIECE], b[i : i + _PIECE])), dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in b.schema.names if c != "text"], pa.array(prints.view(np.int64))], names=[*[c for c in b.schema.names if c != "text"], "print"])


class BKTree:
    """Distinct fingerprints; `add` returns the numbers of the earlier ones within the radius."""

    def __init__(self, radius: int = RADIUS):
        self.radius, self.points, self.children = radius, [], []

    def add(self, point: int) -> list[int]:
        near, points, children = [], self.points, self.children
        if points:
            stack, radius = [0], self.radius
            while stack:
                node = stack.pop()
                d = (point ^ points[node]).bit_count()
                if d <= radius:
                    near.append(node)
                for edge, child in children[node].items():
                    if d - radius <= edge <= d + radius:
                        stack.append(child)
            node = 0
            while (nxt := children[node].get(d := (point ^ points[node]).bit_count())) is not None:
                node = nxt
            children[node][d] = len(points)
        points.append(point)
        children.append({})
        return near


def _shard_links(prints: list[int]) -> list[tuple[int, int]]:
    """For a shard, (point, least point of its part) for every linked point but the least."""
    tree, parent = BKTree(), list(range(len(prints)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, p in enumerate(prints):
        for j in tree.add(p):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(p, prints[root(i)]) for i, p in enumerate(prints) if root(i) != i]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: links of each run of equal shards; a run may span batches."""
    held: int | None = None
    run: list[int] = []
    out: list[tuple[int, int]] = []
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([signed(p) for p, _ in out], pa.int64()), pa.array([signed(r) for _, r in out], pa.int64())], names=["u", "v"])
        out.clear()
        return made

    for b in batches:
        shard = np.asarray(b.column("shard"))
        prints = np.asarray(b.column("print")).view(np.uint64)
        if not len(shard):
            continue
        bounds = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for x, y in zip(bounds, bounds[1:]):
            key = int(shard[x])
            if key != held:
                if len(run) > 1:
                    out += _shard_links(run)
                held, run = key, []
            if y - x > 1 or y == len(shard) or run:
                run += prints[x:y].tolist()
            if len(out) >= 1 << 16:
                yield batch()
    if len(run) > 1:
        out += _shard_links(run)
    if out:
        yield batch()


def _block(i: int) -> Column:
    return F.shiftrightunsigned("print", 16 * i).bitwiseAND(0xFFFF)


def _cuts(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(print, shard, rest) with each shard cut by the three thirds of the width open bits in rest."""
    size = -(-width // 3)
    out = []
    for low in range(0, width, size):
        n = min(size, width - low)
        part = F.shiftrightunsigned("rest", low).bitwiseAND((1 << n) - 1)
        rest = F.shiftleft(F.shiftrightunsigned("rest", low + n), low).bitwiseOR(F.col("rest").bitwiseAND((1 << low) - 1))
        out.append(F.struct(F.xxhash64("shard", F.lit(low), part).alias("shard"), rest.alias("rest")))
    return rows.select("print", F.explode(F.array(*out)).alias("cut")).select("print", "cut.*"), width - width // 3


def links(prints: DataFrame) -> DataFrame:
    """From a table of distinct fingerprints (print), links (u, v) that connect all within the radius."""
    keys = []
    for n, (i, j) in enumerate((i, j) for i in range(4) for j in range(i)):
        low, high = (k for k in range(4) if k not in (i, j))
        shard = F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(_block(i), 16) + _block(j)
        keys.append(F.struct(shard.alias("shard"), (F.shiftleft(_block(high), 16) + _block(low)).alias("rest")))
    rows, width, done = prints.select("print", F.explode(F.array(*keys)).alias("key")).select("print", "key.*"), 32, []
    while True:
        hot = common.stored(rows.groupBy("shard").count().filter(F.col("count") > SHARD_ROWS).select("shard"), "hot-shards")
        if hot.isEmpty() or width <= 2:
            break
        done.append(rows.join(hot, "shard", "left_anti").select("print", "shard"))
        rows, width = _cuts(rows.join(hot, "shard", "left_semi"), width)
        rows = common.stored(rows, "cut-shards")
    rows = rows.select("print", "shard")
    for more in done:
        rows = rows.unionByName(more)
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_links, "u long, v long")


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """Per row of docs: doc_id, print (the fingerprint as a long), component_id and root (the least print of the component);
    `also` names more columns to keep."""
    lean = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *[c.alias(n) for n, c in (also or {}).items()])
    kept = [f for f in lean.schema.fields if f.name != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "print long"])
    slim = common.stored(lean.mapInArrow(_fingerprints, schema), "prints")
    points = common.stored(slim.groupBy("print").agg(F.min("doc_id").alias("first")), "points")
    roots = graphs.components(links(points.select("print"))).withColumnsRenamed({"u": "print"})
    joined = common.join_same(points, roots, ["print"], "left").withColumn("root", F.coalesce("root", "print"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = common.join_same(joined.select("print", "root"), least, ["root"])
    return common.join_same(slim, named, ["print"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits) and component_id (the least id of its group)."""
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def alike(docs: DataFrame, text: str, key: str, shingle: int, similarity: float, digest: Column) -> DataFrame:
    """Per row of docs: doc_id, digest and root (of the texts linked at the similarity)."""
    slim = docs.select(F.col(key).alias("doc_id"), digest.alias("digest"), similar.point_of(F.col(text)).alias("point"))
    roots = similar.roots(docs, F.col(text), shingle, similarity)
    return common.join_same(slim, roots, ["point"], "left").select("doc_id", "digest", F.coalesce("root", "point").alias("root"))


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """The row of each group with the group's least id, once, with the columns of docs.

    Groups are those of the fingerprints or, with a similarity, of the exact Jaccard similarity of shingles. Of a group's
    texts under its least id, that with the least digest stays; an id that is used in several groups may stay in each.
    Rows without an id stay unless their group has one with an id.
    """
    digest, own, of = common.fresh(docs, "__digest", "__id", "__d")
    hashed = F.xxhash64(F.sha2(common.text_of(text), 256))
    groups = grouped(docs, text, key, {"digest": hashed}) if similarity is None else alike(docs, text, key, shingle, similarity, hashed)
    groups = common.stored(groups.groupBy("doc_id", "digest", "root").count(), "near-groups")
    first = groups.filter("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "digest", "count")).alias("first")).select("root", "first.*")
    first = common.stored(first, "first")
    keyed = docs.withColumn(digest, hashed)

    def those(rows: DataFrame) -> DataFrame:
        want = rows.select(F.col("doc_id").alias(own), F.col("digest").alias(of))
        return keyed.join(want, (F.col(key) == F.col(own)) & (F.col(digest) == F.col(of)), "left_semi")

    repeated = first.filter("count > 1")
    if repeated.isEmpty():
        out = those(first)
    else:
        out = those(first.filter("count = 1")).unionByName(those(repeated).dropDuplicates([key, digest]))
    nameless = groups.filter("doc_id IS NULL").join(first.select("root"), "root", "left_anti")
    if not nameless.isEmpty():
        want = nameless.select(F.col("digest").alias(of)).distinct()
        out = out.unionByName(keyed.filter(F.col(key).isNull()).join(want, F.col(digest) == F.col(of), "left_semi"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
