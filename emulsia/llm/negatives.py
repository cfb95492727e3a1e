"""Hard negatives of anchors and their positives, by distributed radix selection over integer scores.

Vectors are quantised (floor(SCALE * x)) and packed, without a shuffle, into row blocks; anchors are packed into anchor
blocks of a bounded size. A row block meets each anchor block by an equi-join on the block's number, so Spark broadcasts
the anchors while its size check allows and shuffles both beyond; a task multiplies two blocks at a time.

1. Positives: the first rows of the anchor's label; a task sends its first `positives` of an anchor.
2. A pair of anchor and positive is a window of scores, low to high. All windows are searched at once, digit by digit of
   the distance from the upper end: a task counts the scores of its rows by the digit behind the prefix found so far, up
   to the bucket in which its own counts reach the wanted rank (the kth row can't lie beyond), the counts are summed, and
   the bucket of the kth row gives the next digit. Where it holds no more rows than are wanted, the window is settled.
3. Rows that tie at the kth score are parted in the same way by the digits of their ids, so that no number of equal
   vectors makes more rows than wanted.
4. Only rows within a window's bound are gathered, and ranked.

Scores are exact: products are summed in floats while they fit their mantissa, else in 64-bit integers. Quantised
components saturate at a bound that keeps scores within a long (2^27 for up to 256 components).

Defined results: rows with a null label, a null vector or a component that is null, NaN or infinite take no part; a null
id is greater than any other and is no anchor; vectors of unequal lengths are compared as if filled up with zeros, and an
empty vector scores 0 with all; rows with an anchor's own id are neither its positives nor its negatives; equal anchor
rows count once; other repeated rows are rows each; an anchor without positives, and an empty table, give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
ROWS = 8192  # in a row block
ANCHORS = 4096  # in an anchor block
CELL = 64  # row blocks that meet a copy of an anchor block where both are shuffled
CHUNK = 256  # anchors or windows that are searched at a time
DIGIT = 8  # bits
POSITIVES = 5
NEGATIVES = 10
LAST = np.iinfo(np.int64).max  # stands for a null id
PACKED = "block long, n int, dim int, ids binary, labels binary, vectors binary"
WINDOW = ("anchor", "place", "high", "width", "wanted", "prefix", "tie", "last")


def _quantised(vectors: pa.Array) -> np.ndarray:
    """Rows of integers, shorter vectors filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    dim = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    bound = 2.0 ** ((62 - max(1, dim - 1).bit_length()) // 2)
    flat = np.clip(np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -bound, bound)
    out[np.arange(dim) < sizes[:, None]] = flat.astype(np.int64)
    return out


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in (batch.slice(i, rows) for i in range(0, batch.num_rows, rows)):
            vectors = _quantised(part.column("vector"))
            ids = part.column("id").to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")  # of tied rows, the first in a block have the least ids
            width = next((t for t in (np.int16, np.int32) if np.abs(vectors).max(initial=0) <= np.iinfo(t).max), np.int64)
            raw = (a[order].tobytes() for a in (ids, part.column("label").to_numpy(zero_copy_only=False), vectors.astype(width)))
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "n", "dim", "ids", "labels", "vectors"), (block, part.num_rows, vectors.shape[1], *raw)))], schema=PACKED_ARROW)
            block += 1


PACKED_ARROW = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])


class Block:
    """A packed block, unpacked."""

    def __init__(self, n: int, dim: int, ids: bytes, labels: bytes, vectors: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, f"i{len(vectors) // (n * dim) if n * dim else 2}").reshape(n, dim)
        self.peak = int(np.abs(self.vectors.astype(np.int64)).max(initial=0))
        self.order = self.ids.view(np.uint64) ^ np.uint64(1 << 63)  # unsigned, in the order of the ids

    def scores(self, rows, other: Block) -> np.ndarray:
        dim = min(self.vectors.shape[1], other.vectors.shape[1])
        bound = self.peak * other.peak * max(1, dim)
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        return (self.vectors[rows, :dim].astype(kind) @ other.vectors[:, :dim].astype(kind).T).astype(np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, Block]]:
    """Joined rows: the row, its anchors and its rows."""
    for batch in batches:
        for r in batch.to_pylist():
            yield r, Block(r["a_n"], r["a_dim"], r["a_ids"], r["a_labels"], r["a_vectors"]), Block(r["n"], r["dim"], r["ids"], r["labels"], r["vectors"])


def _out(of: int, **columns: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_pydict({"of": pa.array(np.full(n, of, np.int64))} | {c: pa.array(v.astype(np.int64)) for c, v in columns.items()})


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each row block, an anchor's first k rows of its label, by score and then id."""
    for r, a, b in _met(batches):
        for start in range(0, len(a.ids), CHUNK):
            rows = slice(start, start + CHUNK)
            same = (a.labels[rows, None] == b.labels) & (a.ids[rows, None] != b.ids)
            s = np.where(same, a.scores(rows, b), np.iinfo(np.int64).min)
            at = s.shape[1] - min(k, s.shape[1])
            kth = np.partition(s, at, axis=1)[:, at, None]
            above = same & (s > kth)
            ties = same & (s == kth)
            ties &= np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)
            i, j = np.nonzero(above | ties)
            yield _out(r["of"], anchor=i + start, anchor_id=a.ids[i + start], id=b.ids[j], score=s[i, j])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, Block, np.ndarray, np.ndarray]]:
    """For a row block and some windows: how far each row's score is behind the upper end, and whether it is within."""
    for r, a, b in _met(batches):
        all_ = {c: np.array([w[c] for w in r["windows"]], dtype=np.int64) for c in WINDOW}
        for start in range(0, len(all_["anchor"]), CHUNK):
            w = {c: v[start : start + CHUNK] for c, v in all_.items()}
            who, row = np.unique(w["anchor"], return_inverse=True)
            behind = w["high"][:, None] - a.scores(who, b)[row]
            mine = (a.labels[w["anchor"], None] != b.labels) & (a.ids[w["anchor"], None] != b.ids)
            yield r["of"], w, b, behind, mine & (behind >= 0) & (behind <= w["width"][:, None])


def _shifted(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(bits) if bits < 64 else np.zeros_like(keys)


def _count(batches: Iterator[pa.RecordBatch], shift: int, of_ids: bool) -> Iterator[pa.RecordBatch]:
    """Rows of each window by the digit at `shift` of how far they are behind or, among rows that tie, of their ids."""
    for of, w, b, behind, mine in _windows(batches):
        key = behind.view(np.uint64)
        if of_ids:
            mine &= behind == w["tie"][:, None]
            key = np.broadcast_to(b.order, behind.shape)
        i, j = np.nonzero(mine & (_shifted(key, shift + DIGIT) == w["prefix"].view(np.uint64)[:, None]))
        digit = (_shifted(key[i, j], shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
        counts = np.bincount((i << DIGIT) + digit, minlength=len(mine) << DIGIT).reshape(-1, 1 << DIGIT)
        # the kth row of all can't lie behind the bucket that holds the kth of this block
        i, digit = np.nonzero((counts > 0) & (np.cumsum(counts, axis=1) - counts < w["wanted"][:, None]))
        yield _out(of, anchor=w["anchor"][i], place=w["place"][i], digit=digit, found=counts[i, digit])


def _gather(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The rows within the bounds: less far behind than `tie`, or as far and with an id up to `last`."""
    for of, w, b, behind, mine in _windows(batches):
        near = mine & (behind < w["tie"][:, None])
        ties = mine & (behind == w["tie"][:, None]) & (b.order <= w["last"].view(np.uint64)[:, None])
        ties &= np.cumsum(ties, axis=1) <= k  # more are only there where rows are equal in score and id
        i, j = np.nonzero(near | ties)
        yield _out(of, anchor=w["anchor"][i], place=w["place"][i], id=b.ids[j], score=w["high"][i] - behind[i, j])


class Mine:
    """The packed tables of one search, and the passes over them."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        self.spark, self.ids = rows.sparkSession, rows.select("id")
        self.rows = common.stored(rows.mapInArrow(lambda b: _pack(b, ROWS), PACKED), "negatives-rows")
        anchors = common.stored(anchors.dropDuplicates(), "negatives-chosen")
        blocks = -(-anchors.count() // ANCHORS)
        packed = anchors.coalesce(max(1, blocks)).mapInArrow(lambda b: _pack(b, ANCHORS), PACKED)
        self.anchors = common.stored(packed.select(F.col("block").alias("of"), *[F.col(c).alias(f"a_{c}") for c in ("n", "dim", "ids", "labels", "vectors")]), "negatives-anchors")
        self.cells = max(1, -(-self.rows.count() // CELL))

    def run(self, asked: DataFrame, scan, schema: str, name: str) -> DataFrame:
        """scan over each pair of a row block and a row of `asked` (of, the anchors and what is asked of them), written.

        A pair meets on the number of the anchor block and a cell of row blocks, so the join is by equality and can be
        shuffled; Spark broadcasts `asked` where it is small.
        """
        numbers = [r["of"] for r in asked.select("of").distinct().collect()]  # one number for ANCHORS anchors
        if not numbers:
            return self.spark.createDataFrame([], schema)
        cells = asked.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(self.cells - 1))))
        rows = self.rows.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(self.cells)).cast("int")).withColumn("of", F.explode(F.lit(numbers)))
        with common.arrow_rows(self.spark, 1):
            return common.stored(rows.join(cells, ["of", "cell"]).mapInArrow(scan, schema), name)

    def positives(self, k: int) -> DataFrame:
        """of, anchor (its place in the block), anchor_id, place (0 to k - 1), id and score of the first k rows of the anchor's label."""
        found = self.run(self.anchors, lambda b: _best(b, k), "of long, anchor long, anchor_id long, id long, score long", "negatives-positives")
        place = F.row_number().over(Window.partitionBy("of", "anchor").orderBy(F.desc("score"), "id")) - 1
        return common.stored(found.withColumn("place", place.cast("long")).filter(F.col("place") < k), "negatives-pairs")

    def asked(self, windows: DataFrame) -> DataFrame:
        """The anchor blocks with their windows: at most ANCHORS times the number of positives in a row."""
        packed = windows.groupBy("of").agg(F.sort_array(F.collect_list(F.struct(*WINDOW))).alias("windows"))
        return self.anchors.join(packed, "of")

    def narrowed(self, windows: DataFrame, shift: int, of_ids: bool) -> DataFrame:
        """The windows after a digit: with `settled`, or with a longer prefix and less wanted."""
        schema = "of long, anchor long, place long, digit long, found long"
        counts = self.run(self.asked(windows), lambda b: _count(b, shift, of_ids), schema, "negatives-counts")
        keys = ["of", "anchor", "place"]
        counts = counts.groupBy(*keys, "digit").agg(F.sum("found").alias("found"))
        counts = counts.withColumn("upto", F.sum("found").over(Window.partitionBy(*keys).orderBy("digit")))
        joined = counts.join(windows.select(*keys, "wanted"), keys).filter("upto >= wanted")
        kth = joined.groupBy(*keys).agg(F.min(F.struct("digit", "found", "upto")).alias("kth"))
        after = windows.join(kth, keys, "left")
        digit, taken = F.col("kth.digit"), F.col("kth.upto") <= F.col("wanted")
        prefix = F.shiftleft("prefix", DIGIT).bitwiseOR(digit)
        end = F.shiftleft(prefix, shift).bitwiseOR(F.lit((1 << shift) - 1))
        fewer = F.col("kth").isNull()  # than wanted: all are taken
        exact = F.lit(shift == 0)
        tie = F.col("tie") if of_ids else F.when(fewer, F.col("width")).otherwise(end)
        last = F.when(fewer, F.lit(-1)).otherwise(end) if of_ids else F.lit(-1)  # -1: all bits, the greatest id
        changed = after.withColumn("settled", fewer | taken | (exact & F.lit(of_ids))).withColumn("tie2", tie).withColumn("last2", last.cast("long"))
        changed = changed.withColumn("prefix2", F.coalesce(prefix, F.lit(0))).withColumn("wanted2", F.when(fewer, F.col("wanted")).otherwise(F.col("wanted") - F.col("kth.upto") + F.col("kth.found")))
        rows = changed.select(*keys, "high", "width", F.col("wanted2").alias("wanted"), F.col("prefix2").alias("prefix"), F.col("tie2").alias("tie"), F.col("last2").alias("last"), "settled")
        return common.stored(rows, "negatives-windows")

    def bounds(self, windows: DataFrame) -> DataFrame:
        """The windows with how far behind their kth row is (tie) and, if rows tie there, the last id that is taken."""
        width, settled = windows.agg(F.max("width")).first()[0], []
        if width is None:
            return windows
        for shift in reversed(range(0, max(1, int(width).bit_length()), DIGIT)):
            windows = self.narrowed(windows, shift, of_ids=False)
            settled.append(windows.filter("settled").drop("settled"))
            windows = windows.filter("NOT settled").drop("settled")
        if not windows.isEmpty():
            low, high = (x + (1 << 63) for x in self.ids.agg(F.min("id"), F.max("id")).first())  # unsigned, as Block.order
            bits = -(-(low ^ high).bit_length() // DIGIT) * DIGIT
            start = low >> bits
            windows = windows.withColumn("prefix", F.lit(start - (1 << 64) if start >> 63 else start).cast("long"))
            for shift in reversed(range(0, max(DIGIT, bits), DIGIT)):
                windows = self.narrowed(windows, shift, of_ids=True)
                settled.append(windows.filter("settled").drop("settled"))
                windows = windows.filter("NOT settled").drop("settled")
        out = settled[0]
        for more in settled[1:]:
            out = out.unionByName(more)
        return out


def hard_negatives(rows: DataFrame, anchors: Column, id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", low: int = 30, high: int = 90, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the first negatives of each anchor and positive.

    `anchors` tells which rows are anchors; a negative's score is between low and high percent of the positive's.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    value = F.col(vector).cast("array<double>")
    clean = rows.select(F.col(id).alias("__id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), value.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("__anchor"))
    clean = clean.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))
    clean = clean.select(F.coalesce(F.col("__id").cast("long"), F.lit(LAST)).alias("id"), "label", "vector", (F.col("__anchor") & F.col("__id").isNotNull()).alias("__anchor"))
    search = Mine(clean.drop("__anchor"), clean.filter("__anchor").drop("__anchor"))

    found = search.positives(positives)
    whole, rest = F.expr("score div 100"), F.pmod("score", F.lit(100))  # so that percents stay within a long
    ends = found.filter("score >= 0").select("*", (whole * low + F.ceil(rest * low / 100)).alias("low"), (whole * high + F.floor(rest * high / 100)).alias("high"))
    fresh = ends.filter("low <= high").select("of", "anchor", "place", "high", (F.col("high") - F.col("low")).alias("width"), F.lit(negatives).cast("long").alias("wanted"), *[F.lit(0).cast("long").alias(c) for c in ("prefix", "tie", "last")])
    bounds = search.bounds(common.stored(fresh, "negatives-windows"))
    near = search.run(search.asked(bounds), lambda b: _gather(b, negatives), "of long, anchor long, place long, id long, score long", "negatives-found")

    keys = ["of", "anchor", "place"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    near = near.select(*keys, rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).filter(F.col("rank") <= negatives)
    pairs = found.select(*keys, "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = near.join(pairs, keys)
    named = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return joined.select("anchor_id", named("positive_id"), "rank", named("negative_id"), "positive_score", "negative_score")


def report(rows: DataFrame) -> DataFrame:
    """The query's search: every 100th id is an anchor, and every 7th has its label moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label=label)
