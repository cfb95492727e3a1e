"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

An item is a group of equal texts. It is placed where the dot product of its (bytes, tokens, rows) with the residual
capacity of the shard is highest, the largest first. Groups over 1 / (shards * CELLS) of the table, at most three times
shards * CELLS of them by construction, are placed first, on the driver. All others are placed in parts of the table of
about PART_ROWS rows, dealt by digest: each part places its groups one by one into its proportion of the capacity that
the large ones left. Only a group over SPLIT of a shard's fair share can't be whole: it is cut into pieces of at most
1 / (shards * CELLS) of the table by a hash of the ids. Rows of large groups find their shard by a broadcast of the large
ones' table, other rows by a join on the digest, which no group's rows can crowd.

Defined results: a null text has no bytes and no tokens and is in the group of empty texts; a null id is an id like any
other; equal rows share a group; a very long text is an item of its own, whatever its size; columns of docs may have any
names (`shard` and `slot` get an underscore where docs has them); an empty table gives an empty table. Rows that are
equal in every column used get different slots.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .quality_rules import split_words

CELLS = 256
PART_ROWS = 1 << 15
#: The part of a shard's fair share up to which a group stays whole.
SPLIT = 1.0
#: How far tokens and rows may pass a shard's fair share before bytes do: the law is `bytes`.
SLACK = np.array([0.0, 0.04, 0.04])


def place(items: np.ndarray, shards: int, capacity: np.ndarray | None = None) -> np.ndarray:
    """The shard of each row of items, an array of (bytes, tokens, rows), by dot product with residual capacity.

    Both are in units of a shard's fair share; capacity (1 by default) has a row a shard. The item goes to the best
    shard among those that it doesn't fill in any dimension; if it fits nowhere, to where the highest fill stays lowest.
    """
    share = items.sum(axis=0) / shards
    weights = items / np.where(share > 0, share, 1)
    left = np.ones((shards, items.shape[1])) if capacity is None else capacity.copy()
    out = np.zeros(len(items), dtype=np.int32)
    for i in np.argsort(-weights.max(axis=1), kind="stable"):
        after = left - weights[i]
        fits = (after >= -SLACK).all(axis=1)
        if not fits.any():
            fits = after[:, 0] >= 0
        best = np.argmax(np.where(fits, left @ weights[i], -np.inf)) if fits.any() else np.argmax(after[:, 0])
        out[i] = best
        left[best] = after[best]
    return out


def measured(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    """docs with size, tokens and a digest of the text under the given names."""
    t = common.text_of(text)
    size, tokens, digest = names
    return docs.withColumns({size: F.octet_length(t).cast("long") + 1, tokens: F.size(split_words(t)).cast("long"), digest: F.xxhash64(F.sha2(t, 256))})


def _piece(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("piece"), key), n).cast("int")


@dataclass(frozen=True)
class Plan:
    """pieces: (digest, pieces, piece, shard) of the large groups; small: (digest, shard) of the others."""

    spark: SparkSession
    pieces: list[tuple[int, int, int, int]]
    small: DataFrame

    def apply(self, df: DataFrame, digest: str, key: str, out: str) -> DataFrame:
        """df with the shard of each row."""
        d, n, p, shard = common.fresh(df, "__d", "__n", "__p", out)
        table = self.spark.createDataFrame(self.pieces, f"`{d}` long, `{n}` int, `{p}` int, `{shard}` int")
        # at most three pieces and three groups for each cell
        mine = (F.col(digest) == F.col(d)) & (_piece(key, F.col(n)) == F.col(p))
        large = df.join(F.broadcast(table), mine).drop(d, n, p)
        known = F.broadcast(table.select(d).distinct())
        rest = df.join(known, F.col(digest) == F.col(d), "left_anti")
        found = self.small.select(F.col("digest").alias(d), F.col("shard").alias(shard))
        return large.unionByName(rest.join(found, F.col(digest) == F.col(d)).drop(d))


def _part_placer(shards: int, left: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("digest")
        items = np.column_stack([table.column(c).to_numpy() for c in "btr"])
        return pa.table({"digest": table.column("digest"), "shard": pa.array(place(items, shards, left), pa.int32())})

    return run


def make_plan(slim: DataFrame, shards: int, size: str, tokens: str, digest: str, key: str, rows: int) -> Plan:
    """Loads of the groups and their placement; slim is a stored table of rows."""
    cells = shards * CELLS
    sums = [F.sum(F.col(size).cast("double")).alias("b"), F.sum(F.col(tokens).cast("double")).alias("t"), F.count("*").cast("double").alias("r")]
    total = slim.agg(*sums).first()
    load = F.greatest(F.lit(0.0), F.lit(0.0), *[F.col(c) / F.lit(total[c]) for c in "btr" if total[c]])
    groups = common.stored(slim.groupBy(F.col(digest).alias("digest")).agg(*sums).withColumn("load", load), "shard-groups")
    # the loads of all groups add up to 3 at most, so fewer than 3 * cells groups are large
    large = sorted(groups.filter(F.col("load") * cells > 1).collect(), key=lambda r: r["digest"])
    items = [(r["digest"], 1, 0, [r["b"], r["t"], r["r"]]) for r in large if r["load"] * shards <= SPLIT]
    cut = {r["digest"]: int(np.ceil(r["load"] * cells)) for r in large if r["load"] * shards > SPLIT}
    if cut:
        d, n, p = common.fresh(slim, "__d", "__n", "__p")
        known = slim.sparkSession.createDataFrame(list(cut.items()), f"`{d}` long, `{n}` int")
        pieces = slim.join(F.broadcast(known), F.col(digest) == F.col(d)).withColumn(p, _piece(key, F.col(n))).groupBy(d, p).agg(*sums).collect()
        items += sorted((r[d], cut[r[d]], r[p], [r["b"], r["t"], r["r"]]) for r in pieces)
    share = np.array([total[c] or 0.0 for c in "btr"]) / shards
    loads = np.array([x[3] for x in items], dtype=float).reshape(-1, 3) / np.where(share > 0, share, 1)
    # `place` works in shares of what it gets: the large ones fill only their part of a shard
    part = loads.sum(axis=0) / shards
    at = place(loads, shards, np.ones((shards, 3)) / np.where(part > 0, part, 1))
    fill = np.zeros((shards, 3))
    np.add.at(fill, at, loads)
    left = np.maximum(1 - fill, 0)
    left = left / np.where(left.sum(axis=0) > 0, left.mean(axis=0), 1)
    parts = max(1, -(-rows // PART_ROWS))
    rest = groups.filter(F.col("load") * cells <= 1).withColumn("part", F.pmod("digest", F.lit(parts)))
    small = common.stored(rest.groupBy("part").applyInArrow(_part_placer(shards, left), "digest long, shard int"), "shard-small")
    return Plan(slim.sparkSession, [(d, n, p, int(s)) for (d, n, p, _), s in zip(items, at)], small)


def pack(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard (null: the law is `bytes`)."""
    slim = measured(docs.select(F.col(key).alias("__key"), F.col(text).alias("text")), "text", ["size", "tokens", "digest"])
    slim = common.stored(slim.withColumn("text_crc32", F.crc32(common.text_of("text").cast("binary"))).drop("text"), "shard-sizes")
    rows = slim.count()
    placed = make_plan(slim, shards, "size", "tokens", "digest", "__key", rows).apply(slim, "digest", "__key", "shard")
    slots = common.prefix_sums(placed.withColumn("one", F.lit(1).cast("long")), ["shard"], ["__key", "size", "text_crc32"], {"slot": "one"}, rows=rows)
    return slots.select(F.col("__key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_rows(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs with shard and slot; a text moves once, to the rows that have its id and digest."""
    size, tokens, digest, who, shard, slot, n, at = common.fresh(docs, "__size", "__tokens", "__digest", "__who", "shard", "slot", "__count", "__at")
    full = measured(docs, text, [size, tokens, digest]).withColumn(who, F.xxhash64(F.lit("who"), F.col(key)))
    slim = common.stored(full.select(size, tokens, digest, who), "shard-sizes")
    rows = slim.count()
    placed = make_plan(slim, shards, size, tokens, digest, who, rows).apply(slim, digest, who, shard)
    # rows with one id and one text share a shard: they take a run of slots
    runs = placed.groupBy(digest, who, shard).agg(F.count("*").alias(n))
    runs = common.stored(common.prefix_sums(runs, [shard], [digest, who], {at: n}, rows=rows), "shard-slots")
    joined = full.drop(size, tokens).join(runs.drop(n).hint("merge"), [digest, who])
    nth = F.row_number().over(Window.partitionBy(digest, who).orderBy(who)) - 1
    return joined.withColumn(slot, F.col(at) + nth).select(*docs.columns, shard, slot)
