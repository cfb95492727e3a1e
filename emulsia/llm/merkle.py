"""Merkle manifest of a table, with a proof for each row that is looked up by coordinates.

A row is a leaf: the SHA-256 of its fields, each as `-` if null and else as byte count, colon and value. Leaves of a
group ascend by key; each run of SIZE consecutive nodes becomes the SHA-256 of their hex digests, until one node is left,
the subroot of the group; the subroots, in the order of the groups, become the root in the same way. A node is found by
its coordinates: its tree (the number of its group, or TOP for that of the subroots), its level and its index.

A leaf knows its index and the size of its group, so the coordinates of the siblings that its proof needs follow by
arithmetic: leaves explode them, join the written node table, collect and order the digests, concatenate and fold. A node
of a high level is a sibling of a great part of all leaves; levels of at most SMALL nodes in all are broadcast, and a node
of a lower level is asked for by at most 1/8192 of the rows (8 of SMALL). Indices come from a range partition, the
counts of its partitions and the places within them, so no task ranks a group.

Defined results: nulls are fields, groups and keys like any other and come first; a null or empty text is a leaf; a text
of any length is hashed whole; rows of equal keys are ordered by their leaf, and repeated rows are leaves each, with the
siblings that their places give; columns that aren't fields are ignored, whatever their names; an empty table has no rows
and no root.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE = 8
TOP = -1
SMALL = 1 << 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Manifest(NamedTuple):
    """Written tables: leaves (key, group, leaf, other, tree, at, n) and nodes (tree, step, at, digest)."""

    leaves: DataFrame
    nodes: DataFrame  # step is the level, and in the tree of the subroots `height` and the level
    groups: int
    height: int  # levels below the subroots, of the largest group
    high: int  # steps from this one on have at most SMALL nodes each
    size: int  # nodes in a run


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def levels(n: int, size: int) -> int:
    """Levels that n nodes are above the single one."""
    return 0 if n <= 1 else 1 + levels(-(-n // size), size)


def numbered(df: DataFrame, group: list[str], order: list[str], names: tuple[str, str] = ("at", "n"), label: str = "merkle-places") -> DataFrame:
    """df, written, with a row's 0-based place among the rows of its group and the number of these; nulls first.

    df should be a written table: its ranges are sampled first. The order within equal rows is that of their storage.
    """
    at, n = names
    row, part, first, size = common.fresh(df, "__row", "__part", "__first", "__size")
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    dealt = df.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*keys, row).sortWithinPartitions(*keys, row)
    dealt = common.stored(dealt.withColumn(row, F.monotonically_increasing_id()), label).withColumn(part, F.shiftright(row, 33))
    counts = dealt.groupBy(*group, part).agg(F.count("*").alias(size), F.min(row).alias(first))
    # one row a group and partition: a window sees as many rows as a group has partitions
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, part, F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(at), F.sum(size).over(Window.partitionBy(*group)).alias(n), first)
    joined = common.join_same(dealt, counts, [*group, part], nulls=tuple(group))
    return joined.withColumn(at, F.col(at) + F.col(row) - F.col(first)).drop(row, part, first)


def parents(nodes: DataFrame, size: int) -> DataFrame:
    """The next level: the runs of nodes (tree, at, n, digest)."""
    runs = nodes.groupBy("tree", F.floor(F.col("at") / size).alias("at")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"))
    joined = F.array_join(F.transform("run", lambda x: hex_of(x["digest"])), "")
    return runs.select("tree", "at", F.ceil(F.col("n") / size).alias("n"), F.unhex(F.sha2(joined, 256)).alias("digest"))


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "lang", other: Column | None = None, size: int = SIZE) -> Manifest:
    """The manifest of docs; `other` is a second leaf that is carried beside the first, as that of a changed row."""
    spark = docs.sparkSession
    leaf = leaf_of(*[F.col(f) for f in fields])
    rows = common.stored(docs.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("leaf"), (leaf if other is None else other).alias("other")), "merkle-rows")
    rows = numbered(rows, ["group"], ["key", "leaf"])
    groups = common.stored(rows.filter("at = 0").select("group", "n"), "merkle-groups")
    total, largest = groups.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    trees = numbered(groups.select("group"), [], ["group"], ("tree", "__of")).drop("__of")
    leaves = common.stored(common.join_same(rows, trees, ["group"], nulls=("group",)), "merkle-leaves")

    height = levels(largest, size)
    level, done, steps = leaves.select("tree", "at", "n", F.col("leaf").alias("digest")), [], []
    for step in range(height + 1):
        steps.append(level.withColumn("step", F.lit(step)))
        done.append(level.filter("n = 1"))
        if step < height:
            level = common.stored(parents(level.filter("n > 1"), size), "merkle-level")
    subroots = done[0]
    for more in done[1:]:
        subroots = subroots.unionByName(more)
    level = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(total).cast("long").alias("n"), "digest")
    for step in range(height, height + levels(total, size) + 1):
        level = common.stored(level, "merkle-level")
        steps.append(level.withColumn("step", F.lit(step)))
        level = parents(level, size)
    # the subroots are nodes of their own trees, and again, one step on, of the top tree
    own = [s.filter("n > 1") for s in steps[: height + 1]]
    nodes = own[0]
    for more in [*own[1:], *steps[height + 1 :]]:
        nodes = nodes.unionByName(more)
    nodes = common.stored(nodes.select("tree", "step", "at", "digest"), "merkle-nodes")
    counts = {r["step"]: r["c"] for r in nodes.groupBy("step").agg(F.count("*").alias("c")).collect()}  # a row a level
    high = next((s for s in range(height + levels(total, size) + 1) if all(c <= SMALL for t, c in counts.items() if t >= s)), 0)
    return Manifest(leaves, nodes, total, height, high, size)


def _walk(m: Manifest) -> tuple[int, Callable]:
    """The number of steps from a leaf to the root at most, and a row's (tree, index, nodes) at a step, as columns."""
    top, size = levels(m.groups, m.size), m.size

    def at(step: Column) -> tuple[Column, Column, Column]:
        inside = step < m.height
        power = F.pow(F.lit(float(size)), F.when(inside, step).otherwise(step - m.height)).cast("long")
        index = F.floor(F.when(inside, F.col("at")).otherwise(F.col("tree")) / power)
        nodes = F.ceil(F.when(inside, F.col("n")).otherwise(F.lit(m.groups)) / power)
        return F.when(inside, F.col("tree")).otherwise(F.lit(TOP)), index, nodes

    return m.height + top, at


def proofs(m: Manifest) -> DataFrame:
    """The leaves with `siblings`: the hex digests of their proofs, level by level up to the root, left to right."""
    (steps, walk), size = _walk(m), m.size
    if not steps:
        return m.leaves.withColumn("siblings", F.array().cast("array<string>"))

    def asked(step: Column) -> Column:
        tree, index, nodes = walk(step)
        first = F.floor(index / size) * size
        run = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.struct(tree.alias("tree"), step.alias("step"), (first + j).alias("at")))
        return F.filter(run, lambda x: (x["at"] != index) & (x["at"] < nodes))

    def wanted(a: int, b: int) -> DataFrame:
        all_ = F.flatten(F.transform(F.sequence(F.lit(a), F.lit(b - 1)), asked))
        return m.leaves.select(F.col("tree").alias("of"), F.col("at").alias("leaf_at"), F.explode(all_).alias("x")).select("of", "leaf_at", "x.*")

    found = []
    if m.high:
        found.append(wanted(0, m.high).join(m.nodes.filter(F.col("step") < m.high), ["tree", "step", "at"]))
    if m.high < steps:
        # at most SMALL nodes a level, and an eighth of that on each level above
        found.append(wanted(m.high, steps).join(F.broadcast(m.nodes.filter(F.col("step") >= m.high)), ["tree", "step", "at"]))
    rows = found[0].unionByName(found[1]) if len(found) == 2 else found[0]
    each = rows.groupBy("of", "leaf_at").agg(F.sort_array(F.collect_list(F.struct("step", "at", "digest"))).alias("s"))
    each = each.select("of", "leaf_at", F.transform("s", lambda x: hex_of(x["digest"])).alias("siblings"))
    joined = m.leaves.join(each, (F.col("tree") == F.col("of")) & (F.col("at") == F.col("leaf_at")), "left").drop("of", "leaf_at")
    return joined.withColumn("siblings", F.coalesce("siblings", F.array().cast("array<string>")))


def folded(m: Manifest, leaf: Column) -> Column:
    """The hex digest of the root to which a leaf and the row's siblings fold."""
    (steps, walk), size = _walk(m), m.size
    if not steps:
        return hex_of(leaf)

    def climb(state: Column, step: Column) -> Column:
        _, index, nodes = walk(step)
        left = F.pmod(index, F.lit(size)).cast("int")
        right = (F.least(F.lit(size), nodes - F.floor(index / size) * size) - 1 - left).cast("int")
        part = lambda begin, count: F.array_join(F.slice("siblings", begin, count), "")
        digest = F.sha2(F.concat(part(state["next"], left), state["digest"], part(state["next"] + left, right)), 256)
        up = F.struct(digest.alias("digest"), (state["next"] + left + right).alias("next"))
        return F.when(nodes > 1, up).otherwise(state)

    start = F.struct(hex_of(leaf).alias("digest"), F.lit(1).alias("next"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), start, climb, lambda state: state["digest"])


def roots(m: Manifest) -> DataFrame:
    """group, subroot and root: a row for each group."""
    steps = m.height + levels(m.groups, m.size)
    root = m.nodes.filter((F.col("tree") == TOP) & (F.col("step") == steps)).select(F.col("digest").alias("root"))
    top = m.nodes.filter((F.col("tree") == TOP) & (F.col("step") == m.height))
    groups = m.leaves.filter("at = 0").select("group", "tree")
    subroots = groups.join(top.select(F.col("at").alias("tree"), F.col("digest").alias("subroot")), "tree")
    return subroots.select("group", hex_of(F.col("subroot")).alias("subroot"), F.lit(root.select(hex_of(F.col("root"))).first()[0] if m.groups else None).cast("string").alias("root"))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; a third of the rows is tampered with."""
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    other = leaf_of(*[changed if f == "text" else F.col(f) for f in FIELDS])
    m = build(docs, other=other)
    rows = common.join_same(proofs(m), F.broadcast(roots(m)) if m.groups <= SMALL else roots(m), ["group"], nulls=("group",))
    rows = rows.withColumn("folded_root", folded(m, F.col("other")))
    return rows.select(
        F.col("key").alias("doc_id"), hex_of(F.col("leaf")).alias("leaf"), "subroot", "root",
        F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
