"""Groups of texts by SimHash and BK-trees, each link checked by the exact Jaccard similarity of the word shingles.

A vertex is a distinct text. Its fingerprint has BITS bits, each set if it is set in over half of the hashes of the
distinct shingles. Sets at 0.8 differ in 15 % of the bits (19 % in sets of four and five shingles), others in up to half.
No blocks that stay equal at that radius part a table, so the shards come from the bits that are decided most: the
counts behind the fingerprint are turned by a fixed matrix of signs, and a block of WIDTH turned counts gives the place
and the sign of its largest one. A key is WINNERS of them (one more beyond 2 ** 24 texts, so that shards stay small), a text
has a key in each of `KEYS` tables, and texts that share a key share a shard. A pair at 0.8 shares some 14 keys and
none once in some 300,000 times, a pair at 0.9 shares some 32.

A shard is a BK-tree, searched at the radius NEAR on 128 bits: members without a neighbour leave. At that radius a tree
parts near copies from others, but prunes next to nothing among unrelated texts, so what bounds the work is the size of
what is searched at once: BLOCK members, and BLOCK of those that ask. Pairs of a shard aren't written. The others move once, with their texts, to be a table of sets. A shard's head is the member that meets most others
over all shards (of near copies, their original), and each text is first compared with one head, the one of its shards'
heads that meets most others of those whose fingerprint and size allow the similarity: a question a text, however many
shards and heads a group of near copies has. Members of another component than the head's are open; any pair that isn't
joined yet has one. Open members search the BK-tree of all members of the shard, in blocks of BLOCK, at the radius
WIDE on all bits, within a task that has their sets; what they find is compared on the sets, and links between what is
already joined in the block aren't written. A pair is met in the largest of the shards that it shares, not in each: every
shard that both are in has one of them open, since only one can be of its head's component. Sets move there only for
members that the tree has shown to be near to one of another component, with hashes cut to 32 bits; a link is then checked on whole hashes like those to the heads.

Defined results: a null or blank text has no shingles, and all such texts are alike; a text under `shingle` words is one
shingle; a very long text is one set of hashes; letters A to Z are folded as in the fingerprints; an empty table has no
links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, graphs, trees

BITS = 512
WIDTH = 64
WINNERS = 3
KEYS = {3: 160, 4: 376}
PASSES = 4  # parts of the tables that are dealt to shards one after the other, so that less lies on disk at a time
NEAR = 46  # of 128 bits: a pair at 0.8 is further apart once in a million times, other texts are in 999 of 1,000
WIDE = 140  # of all bits
BLOCK = 4096
SEED = 42
BATCH = 256  # texts or pairs in an Arrow batch: a pair brings both sets of hashes
_PIECE = 1 << 12
_STEPS = (np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of n words."""
    words = text.encode().lower().split() if text else []
    runs = (b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else ()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), dtype=np.uint64))


def counts(hashes: np.ndarray) -> np.ndarray:
    """For each bit, the hashes that set it less those that don't."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _PIECE):
        z = hashes[i : i + _PIECE, None] + _STEPS
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return 2 * ones - len(hashes)


@lru_cache(maxsize=1)
def _turns(winners: int) -> np.ndarray:
    signs = np.random.default_rng(SEED).integers(0, 2, size=(BITS, KEYS[winners] * winners * WIDTH), dtype=np.int8)
    return (2 * signs - 1).astype(np.float32)


def keys(sums: np.ndarray, winners: int) -> np.ndarray:
    """For each row of counts, the key in each table: the places and signs of the largest turned counts of its blocks.

    Sums of whole numbers, so they are the same in any order of adding.
    """
    turned = (sums.astype(np.float32) @ _turns(winners)).reshape(len(sums), -1, WIDTH)
    place = np.abs(turned).argmax(axis=2)
    won = 2 * place + (np.take_along_axis(turned, place[:, :, None], axis=2)[:, :, 0] > 0)
    won = won.reshape(len(sums), -1, winners)
    return (won * (2 * WIDTH) ** np.arange(winners)).sum(axis=2).astype(np.int32)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(shingle: int, winners: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(point, text) to (point, sign, size, a, b, keys); sign is the fingerprint, a and b are its first 128 bits, and size is
    the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                sets = [shingles(t.as_py(), shingle) for t in b.column("text")]
                sums = np.stack([counts(s) for s in sets])
                signs = np.packbits(sums > 0, axis=1)
                first = np.ascontiguousarray(signs[:, :16]).view(np.int64)
                found = [row.tolist() for row in keys(sums, winners)]
                columns = [b.column("point"), pa.array([x.tobytes() for x in signs], pa.binary()), pa.array(map(len, sets), pa.int32()), *(pa.array(first[:, k]) for k in (0, 1)), pa.array(found, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["point", "sign", "size", "a", "b", "keys"])

    return run


def _collapsed(rows: np.ndarray) -> np.ndarray:
    """Sorted rows (key, a, b, n) with equal ones as one, their n added up."""
    first = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))) if len(rows) else np.zeros(0, dtype=np.int64)
    return np.column_stack([rows[first, :3], np.add.reduceat(rows[:, 3], first)]) if len(rows) else rows


def _befriended(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, a, b) sorted by all three to distinct ones with `sure`: those with a neighbour in the BK-tree of their key.

    A run may span batches. One of over `block` fingerprints is searched in blocks of as many, so that no task holds or
    compares a whole crowded shard; its fingerprints without a neighbour in their block are given too, as not sure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = np.empty((0, 4), dtype=np.int64), None

        def decided(rows: np.ndarray) -> pa.RecordBatch:
            bounds = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]))
            sizes = np.diff(bounds)
            prints = np.ascontiguousarray(rows[:, 1:3]).view(np.uint64)
            ok, cut = rows[:, 3] > 1, np.zeros(len(rows), dtype=bool)
            two = bounds[np.flatnonzero(sizes == 2)]
            near = trees.distances(prints[two], prints[two + 1]) <= NEAR
            ok[two] |= near
            ok[two + 1] |= near
            for x, y in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist()):
                for i in range(x, y, block):
                    j = min(i + block, y)
                    ok[i:j] |= trees.befriended(prints[i:j], NEAR)
                cut[x:y] = y - x > block
            if crowded is not None:
                cut |= rows[:, 0] == crowded
            kept = ok | cut
            return pa.RecordBatch.from_arrays([*(pa.array(rows[kept, k]) for k in range(3)), pa.array(ok[kept])], names=["key", "a", "b", "sure"])

        for b in batches:
            if not b.num_rows:
                continue
            new = np.column_stack([*(b.column(c).to_numpy() for c in ("key", "a", "b")), np.ones(b.num_rows, dtype=np.int64)])
            rows = _collapsed(np.concatenate([held, new]))
            open_ = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if open_:
                yield decided(rows[:open_])
                crowded = crowded if crowded == rows[-1, 0] else None
            held = rows[open_:]
            while len(held) > block:  # the last fingerprint may go on, so a block never ends with it
                crowded = held[0, 0]
                yield decided(held[:block])
                held = held[block:]
        if len(held):
            yield decided(held)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, member, a, b, sign) sorted by key and block to those (key, a, b) that ask and have another member of the block near."""
    for run in _runs(batches, ["member", "a", "b", "sign"]):
        if run is None:
            continue
        them, us = np.flatnonzero(run["member"]), np.flatnonzero(~run["member"])
        tree, hit = trees.Tree(run["sign"][them], NEAR), np.zeros(len(us), dtype=bool)
        for who, point in tree.search(run["sign"][us], hit):
            other = (tree.points[point] != run["sign"][us][who]).any(axis=1)
            hit[who[other]] = True
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(run[c][us[hit]]) for c in ("key", "a", "b")], names=["key", "a", "b"])


def _sharded(rows: DataFrame) -> DataFrame:
    """(key, a, b) to the distinct ones that have a neighbour in their shard.

    In a crowded shard those that found none in their own block ask all its blocks: a cell is a block of members and a
    block of those that ask, so both sides of a task are bounded.
    """
    found = common.stored(rows.repartition("key").sortWithinPartitions("key", "a", "b").mapInArrow(_befriended(BLOCK), "key long, a long, b long, sure boolean"), "shards")
    sure = found.filter("sure").drop("sure")
    lone = found.filter("NOT sure").drop("sure")
    if lone.isEmpty():
        return sure
    asking = lone.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("asks"))
    sizes = common.join_same(found, asking, ["key"]).groupBy("key", "asks").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = common.stored(sizes, "shard-sizes")
    word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    cell = lambda member, ask: (member * F.col("asks") + ask).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n))
    members = common.join_same(found.drop("sure"), sizes, ["key"]).withColumn("other", each("asks")).select("key", cell(of("blocks", "a", "b"), F.col("other")).alias("block"), F.lit(True).alias("member"), "a", "b")
    asks = common.join_same(lone, sizes, ["key"]).withColumn("other", each("blocks")).select("key", cell(F.col("other"), of("asks", "b", "a")).alias("block"), F.lit(False).alias("member"), "a", "b")
    cells = members.unionByName(asks).withColumn("sign", F.concat(word("a"), word("b")))
    more = cells.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_answered, "key long, a long, b long")
    return sure.unionByName(common.stored(more.distinct(), "shards"))


def _hashed(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(point, text) to (point, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(t.as_py(), shingle).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("point"), pa.array(made, pa.binary())], names=["point", "hashes"])

    return run


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(point, hashes) to (point, cut) with the top halves of the hashes."""
    for b in batches:
        made = [_cut(np.frombuffer(h.as_buffer(), np.uint64)).tobytes() for h in b.column("hashes")]
        yield pa.RecordBatch.from_arrays([b.column("point"), pa.array(made, pa.binary())], names=["point", "cut"])


def _cut(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct top halves of sorted hashes."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))


def _by_table(earlier: pa.ListArray, tables: int) -> np.ndarray:
    """Lists of shards as rows with the key in each table, or -1."""
    shards, sizes = earlier.flatten().to_numpy(), np.diff(earlier.offsets.to_numpy())
    out = np.full((len(earlier), tables), -1, dtype=np.int32)
    out[np.repeat(np.arange(len(earlier)), sizes), shards >> 32] = shards & 0xFFFFFFFF
    return out


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], tables: int = 0) -> Iterator[dict]:
    """The rows sorted by key and block as a dict of columns for each run; None after each batch."""
    held, parts = None, []
    whole = lambda: {k: [x for p in parts for x in p[k]] if k == "cut" else np.concatenate([p[k] for p in parts]) for k in parts[0]}
    for b in batches:
        if not b.num_rows:
            continue
        key = np.column_stack([b.column("key").to_numpy(), b.column("block").to_numpy()])
        columns = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "block", *names) if k not in ("sign", "cut", "earlier")}
        columns["sign"] = np.frombuffer(b"".join(b.column("sign").to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1)
        if "earlier" in names:
            columns["earlier"] = _by_table(b.column("earlier"), tables)
        if "cut" in names:
            columns["cut"] = [np.frombuffer(c, np.uint32) for c in b.column("cut").to_pylist()]
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for x, y in zip(bounds, bounds[1:]):
            if held is not None and tuple(key[x]) != held:
                yield whole()
                parts.clear()
            held = tuple(key[x])
            parts.append({k: v[x:y] for k, v in columns.items()})
        yield None
    if parts:
        yield whole()


def _hits(run: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a run that ask, and members near to them by the run's BK-tree."""
    them, us = np.flatnonzero(run["member"]), np.flatnonzero(run["asks"])
    tree = trees.Tree(run["sign"][them], WIDE)
    for who, point in tree.search(run["sign"][us]):
        found = [tree.members[t] for t in point.tolist()]
        yield np.repeat(us[who], [len(m) for m in found]), them[np.concatenate(found)]


def _met(tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, block, member, asks, point, root, sign, earlier) to those, without sign and earlier, that meet one of another
    component in the run and in none of the earlier shards: a pair is met in the first shard that it shares, the largest one."""
    names = ["key", "block", "member", "asks", "point", "root"]

    def met(run: dict) -> np.ndarray:
        ok = np.zeros(len(run["asks"]), dtype=bool)
        for p, q in _hits(run):
            new = (run["root"][p] != run["root"][q]) & ~(ok[p] & ok[q])
            p, q = p[new], q[new]
            for i in range(0, len(p), BLOCK):
                x, y = p[i : i + BLOCK], q[i : i + BLOCK]
                mine = run["earlier"][x]
                first = ~((mine == run["earlier"][y]) & (mine >= 0)).any(axis=1)
                ok[x[first]] = ok[y[first]] = True
        return ok

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(np.concatenate([k[c] for k in kept])) for c in names], names=names)
            kept.clear()
            return made

        for run in _runs(batches, [*names, "sign", "earlier"], tables):
            if run is None:
                if kept:
                    yield batch()
            elif run["asks"].any():
                ok = met(run)
                if ok.any():
                    kept.append({c: run[c][ok] for c in names})
        if kept:
            yield batch()

    return go


def _likely(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, block, member, asks, point, root, sign, cut) sorted by key and block, to links (u, v) of each run: those of
    a row that asks with a member of the block, as far as they join two components."""
    sure = similarity + 0.005

    def links(run: dict) -> Iterator[tuple[int, int]]:
        joined = {}

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        sizes = np.fromiter(map(len, run["cut"]), dtype=np.int64, count=len(run["cut"]))
        tops = run["root"].copy()
        for p, q in _hits(run):
            some = (tops[p] != tops[q]) & (np.minimum(sizes[p], sizes[q]) >= (similarity - 0.005) * np.maximum(sizes[p], sizes[q]))
            had = len(joined)
            for x, y in zip(p[some].tolist(), q[some].tolist()):
                r, t = top(int(tops[x])), top(int(tops[y]))
                if r == t:
                    continue
                alike = jaccard(run["cut"][x], run["cut"][y])
                if alike >= similarity - 0.005:
                    yield tuple(sorted((int(run["point"][x]), int(run["point"][y])), reverse=True))
                if alike >= sure:
                    joined[r] = t
            if len(joined) > had:
                tops = np.fromiter(map(top, tops.tolist()), dtype=np.int64, count=len(tops))

    def batch(found: set) -> pa.RecordBatch:
        rows = sorted(found)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for run in _runs(batches, ["member", "asks", "point", "root", "sign", "cut"]):
            if run is not None and run["asks"].any():
                found.update(links(run))
            if run is None and len(found) >= 1 << 16:
                yield batch(found)
                found.clear()
        yield batch(found)

    return go


def _checker(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (tuple(np.frombuffer(x.as_buffer(), np.uint64) for x in pair) for pair in zip(b.column("a"), b.column("b")))
            near = [jaccard(x, y) >= similarity for x, y in sets]
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return run


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of points whose sets (point, hashes) are similar."""
    left = sets.withColumnsRenamed({"point": "u", "hashes": "a"})
    right = sets.withColumnsRenamed({"point": "v", "hashes": "b"})
    both = common.join_same(common.join_same(pairs, left, ["u"]), right, ["v"]).select("u", "v", "a", "b")
    with common.arrow_rows(pairs.sparkSession, BATCH):
        return common.stored(both.mapInArrow(_checker(similarity), "u long, v long"), "similar")


def roots(docs: DataFrame, text: Column, shingle: int, similarity: float) -> DataFrame:
    """(point, root) of each text that is linked to another; a point is point_of(text)."""
    texts = docs.select(point_of(text).alias("point"), text.alias("text"))
    winners = WINNERS + (texts.count() > 1 << 24)
    keyed = texts.mapInArrow(_signed(shingle, winners), "point long, sign binary, size int, a long, b long, keys array<int>")
    with common.arrow_rows(docs.sparkSession, BATCH):
        keyed = common.stored(keyed.groupBy("point").agg(*[F.first(c).alias(c) for c in ("sign", "size", "a", "b", "keys")]), "shard-keys")
    size = -(-KEYS[winners] // PASSES)
    shards = None
    for low in range(0, KEYS[winners], size):
        rows = keyed.select("a", "b", F.posexplode(F.slice("keys", low + 1, size)).alias("table", "key"))
        rows = rows.select((F.shiftleft((F.col("table") + low).cast("long"), 32) + F.col("key")).alias("key"), "a", "b")
        part = _sharded(rows)
        shards = part if shards is None else shards.unionByName(part)
    rows = common.join_same(shards, keyed.select("point", "size", "a", "b"), ["a", "b"])
    counted = rows.groupBy("key").agg(F.count("*").alias("n"))
    shared = common.stored(common.join_same(rows, counted, ["key"]), "shared-shards")
    degree = shared.groupBy("point").agg(F.sum("n").alias("degree"))
    members = common.stored(common.join_same(shared, degree, ["point"]), "shard-members")
    heads = members.groupBy("key").agg(F.max(F.struct("degree", "point", "size", "a", "b")).alias("head"))
    heads = heads.select("key", F.col("head.point").alias("head"), *[F.col(f"head.{c}").alias(f"head_{c}") for c in ("degree", "size", "a", "b")])
    headed = common.join_same(members.select("key", "point", "n", "size", "a", "b"), heads, ["key"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("head_a"))) + F.bit_count(F.col("b").bitwiseXOR(F.col("head_b"))) <= NEAR
    fits = F.least("size", "head_size") >= F.greatest("size", "head_size") * similarity - 1e-6
    headed = common.stored(headed.select("key", "point", "n", "head", "head_degree", ((F.col("point") != F.col("head")) & near & fits).alias("asks")), "shard-heads")

    with common.arrow_rows(docs.sparkSession, BATCH):
        some = texts.join(degree.select("point"), "point", "left_semi").groupBy("point").agg(F.first("text").alias("text"))
        sets = common.stored(some.mapInArrow(_hashed(shingle), "point long, hashes binary"), "shard-sets")
    asked = headed.filter("asks").groupBy("point").agg(F.max(F.struct("head_degree", "head")).alias("best")).select("point", "best.head")
    asked = common.stored(asked.select(F.greatest("point", "head").alias("u"), F.least("point", "head").alias("v")).distinct(), "candidates")
    links = _checked(asked, sets, similarity)

    found = graphs.components(links).withColumnsRenamed({"u": "point"})
    placed = common.join_same(headed.select("key", "point", "n", "head"), found, ["point"], "left").withColumn("root", F.coalesce("root", "point"))
    top = placed.filter("point = head").select("key", F.col("root").alias("top"))
    placed = common.stored(common.join_same(placed, top, ["key"]).withColumn("open", F.col("root") != F.col("top")), "shard-roots")
    parted = placed.filter("open").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    some = common.join_same(placed, parted, ["key"]).select("key", "point", "root", "open", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "parts")
    some = common.stored(some, "shard-open")
    # a cell is a block of members and a part of the open ones: neither side of a run is unbounded
    home, part = (F.pmod(F.xxhash64("point", *salt), F.col(c)).cast("int") for c, salt in (("blocks", []), ("parts", ["point"])))
    each = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = each.select("key", (home * F.col("parts") + F.col("part")).alias("block"), F.lit(True).alias("member"), (F.col("open") & (F.col("part") == part)).alias("asks"), "point", "root", "n")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != home)
    asking = some.filter("open AND blocks > 1").withColumn("other", F.explode(others)).select("key", (F.col("other") * F.col("parts") + part).alias("block"), F.lit(False).alias("member"), F.lit(True).alias("asks"), "point", "root", "n")
    dealt = lambda rows: rows.repartition("key", "block").sortWithinPartitions("key", "block")
    known = common.join_same(some.groupBy("point").agg(F.collect_list(F.struct("n", "key")).alias("shards")), keyed.select("point", "sign"), ["point"])
    runs = common.join_same(own.unionByName(asking), common.stored(known, "shard-signs"), ["point"])
    before = F.filter("shards", lambda x: (x["n"] > F.col("n")) | ((x["n"] == F.col("n")) & (x["key"] < F.col("key"))))
    runs = dealt(runs.withColumn("earlier", F.transform(before, lambda x: x["key"])).drop("shards", "n"))
    met = common.stored(runs.mapInArrow(_met(KEYS[winners]), "key long, block int, member boolean, asks boolean, point long, root long"), "shard-met")
    with common.arrow_rows(docs.sparkSession, BATCH):
        cuts = sets.join(met.select("point").distinct(), "point", "left_semi").mapInArrow(_halved, "point long, cut binary")
        cuts = common.stored(common.join_same(cuts, keyed.select("point", "sign"), ["point"]), "shard-cuts")
        runs = dealt(common.join_same(met, cuts, ["point"]))
        likely = common.stored(runs.mapInArrow(_likely(similarity), "u long, v long").distinct(), "likely")
    ends = likely.select(F.explode(F.array("u", "v")).alias("point")).distinct()
    more = _checked(likely, common.stored(sets.join(ends, "point", "left_semi"), "likely-sets"), similarity)
    if more.isEmpty():
        return found
    return graphs.components(links.unionByName(more)).withColumnsRenamed({"u": "point"})


def point_of(text: Column) -> Column:
    return F.xxhash64(F.sha2(common.text_of(text), 256))
