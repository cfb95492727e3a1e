"""Substring dedup: windows of 13 words that start in an earlier document go, found behind a count-min prefilter.

Documents are cut into chunks, ranges of ids in order, so that a window which some smaller chunk has also starts in a
document with a smaller id, and only a window shared within a chunk needs ids. Ranges are cut by bytes; a single id, or
the rows without one, that outweighs a chunk is spread over several chunks of one rank, none of which is smaller than
another. Four steps, each keyed by chunk or by hash range:

1. Sketch. Each chunk hashes its distinct windows into ROWS rows of a count-min sketch with 2**bits cells. bits grows
   with the text, to 8 or more cells a window, so a sketch of a chunk is mostly zeros and is kept as its sorted cells.
2. Merge. The chunks' sketches are added up by ranges of cells. A cell that two chunks have is handed back to both. A
   window's estimate is the least count of its cells: it may be too high, never too low, so no repeat is lost.
3. Exact groups. Chunks send the windows whose cells all came back, each as the SHA-256 of its words cut to 96 bits and
   32 bits of another hash, and those are grouped: each chunk but the first that has a window is told so.
4. Removal. A chunk removes windows it was told of and, by the same digests, those of a smaller id within it.

Words are hashed by XXH64 and windows by their words' hashes only to choose candidates; what is removed rests on digests
of the words themselves. The texts move once, to their chunk; the three reads of a chunk reuse that exchange.

Defined results: a null text has no words; a document of fewer than 13 words keeps them all; a very long text is in one
chunk, which may then be larger than others; ids are numbers, a null id is larger than every id and no null id is larger
than another; repeated rows keep what the other has; columns besides the id and the text aren't read; an empty table
gives an empty table. Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
ROWS = 2
CHUNK_BYTES = 8 << 20  # of text, up to GROW_FROM of it; chunks grow with the root of the text beyond, to MOST times this
GROW_FROM = 1 << 30
MOST = 4
MERGE_CELLS = 4 << 20  # cells that one range of a sketch's row brings together
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TAG = np.uint64(0xFFFFFFFF00000000)
_HEAD = struct.Struct("<IBQ")


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    """A polynomial of each of the n runs of WINDOW word hashes, from runs of 1, 2, 4 and 8."""
    assert WINDOW == 13
    if not n:
        return np.zeros(0, dtype=np.uint64)
    power = [np.uint64(pow(int(_BASE), k, 1 << 64)) for k in range(9)]
    with np.errstate(over="ignore"):
        twos = words[:-1] * power[1] + words[1:]
        fours = twos[:-2] * power[2] + twos[2:]
        eights = fours[:-4] * power[4] + fours[4:]
        return (eights[:n] * power[4] + fours[8 : 8 + n]) * power[1] + words[12 : 12 + n]


class Chunk:
    """The documents of a chunk in order of id, their words joined by blanks in one byte string.

    window: the first word of each window; hashes: a 64-bit hash of it; doc: its document's number.
    """

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        self.ids = [ids[i] for i in self.order]
        texts, hashed = table.column("text"), xxhash.xxh64_intdigest
        joined, sizes, words, counts = [], [], [], []
        for i in self.order:
            found = (texts[i].as_py() or "").encode().split()
            joined.append(b" ".join(found))
            sizes.append(np.fromiter(map(len, found), dtype=np.int32, count=len(found)))
            words.append(np.fromiter(map(hashed, found), dtype=np.uint64, count=len(found)))
            counts.append(len(found))
        none = np.zeros(0, dtype=np.int64)
        self.texts, self.n_words = joined, np.array(counts, dtype=np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(self.n_words)))  # word numbers of the documents
        self.sizes = np.concatenate([none, *sizes])
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), self.n_words)
        n = max(0, len(doc) - WINDOW + 1)
        self.window = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :]) if n else none
        self.doc = doc[self.window]
        self.hashes = _mixed(_runs(np.concatenate([none.astype(np.uint64), *words]), n)[self.window])

    def pairs(self, which: np.ndarray) -> np.ndarray:
        """Of these windows (ascending), the top of the hash with 96 bits of the SHA-256 of the words."""
        out = np.empty(len(which), dtype=_PAIR)
        digests, sha = [], hashlib.sha256
        docs, firsts = self.doc[which], self.window[which]
        edges = [0, *(np.flatnonzero(docs[1:] != docs[:-1]) + 1).tolist(), len(docs)] if len(docs) else []
        for x, y in zip(edges, edges[1:]):
            d = int(docs[x])
            low, text = int(self.bounds[d]), self.texts[d]
            ends = np.cumsum(self.sizes[low : self.bounds[d + 1]] + 1)
            at = firsts[x:y] - low
            begins = np.where(at > 0, ends[at - 1], 0)
            digests += [sha(text[i:j]).digest()[:12] for i, j in zip(begins.tolist(), (ends[at + WINDOW - 1] - 1).tolist())]
        raw = np.frombuffer(b"".join(digests), dtype=np.dtype([("a", "<u4"), ("b", "<u8")]))
        out["a"], out["b"] = (self.hashes[which] & _TAG) | raw["a"], raw["b"]
        return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting."""
    values = np.sort(values)
    return values[np.concatenate((values[:1] == values[:1], values[1:] != values[:-1]))]


def repeated(values: np.ndarray) -> np.ndarray:
    """The values that occur twice or more, in order."""
    values = np.sort(values)
    return distinct(values[1:][values[1:] == values[:-1]])


def contains(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in known, which is sorted."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    salted = hashes if row == 0 else _mixed(hashes ^ np.uint64(0x5851F42D4C957F2D * row & (1 << 64) - 1))
    return salted >> np.uint64(64 - bits)


def pack_cells(cells: np.ndarray) -> bytes:
    """Sorted distinct numbers in the Elias-Fano form: about two bits each besides the bits that tell neighbours apart."""
    n = len(cells)
    if not n:
        return b""
    base = int(cells[0])
    rest = cells - np.uint64(base)
    low = max(0, ((int(rest[-1]) + 1) // n).bit_length() - 1)
    high = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(high[-1]) + 1, dtype=np.uint8)
    marks[high] = 1
    lows = np.empty((n, low), dtype=np.uint8)
    for k in range(low):
        lows[:, k] = (rest >> np.uint64(k)) & np.uint64(1)
    return _HEAD.pack(n, low, base) + np.packbits(lows.ravel()).tobytes() + np.packbits(marks).tobytes()


def unpack_cells(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, dtype=np.uint64)
    n, low, base = _HEAD.unpack_from(blob)
    middle = _HEAD.size + (n * low + 7) // 8
    raw = np.frombuffer(blob, dtype=np.uint8)
    lows = np.unpackbits(raw[_HEAD.size : middle], count=n * low).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(raw[middle:]))[:n] - np.arange(n)
    out = high.astype(np.uint64) << np.uint64(low)
    for k in range(low):
        out |= lows[:, k].astype(np.uint64) << np.uint64(k)
    return out + np.uint64(base)


def _blobs(chunk: int, kinds: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(kinds), pa.int32()), "row": pa.array([k[0] for k in kinds], pa.int32()), "range": pa.array([k[1] for k in kinds], pa.int32()), "blob": pa.array([k[2] for k in kinds], pa.binary())})


def _by_range(values: np.ndarray, top_bits: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, last) of sorted values, cut by their top bits."""
    edges = np.searchsorted(values, np.arange(1 << top_bits, dtype=np.uint64) << np.uint64(bits - top_bits)).tolist()
    for r, (a, b) in enumerate(zip(edges, [*edges[1:], len(values)])):
        if b > a:
            yield r, a, b


def _sketch(table: pa.Table, bits: int, top: int) -> pa.Table:
    chunk = table.column("chunk")[0].as_py()
    hashes, kinds = distinct(Chunk(table).hashes), []
    for row in range(ROWS):
        cells = distinct(cells_of(hashes, row, bits))
        kinds += [(row, r, pack_cells(cells[a:b])) for r, a, b in _by_range(cells, top, bits)]
    return _blobs(chunk, kinds)


def _merge(table: pa.Table) -> pa.Table:
    """For one range of a row of the sketch: the cells that several chunks have, for each of these chunks."""
    chunks, row, at = table.column("chunk").to_pylist(), table.column("row")[0].as_py(), table.column("range")[0].as_py()
    cells = [unpack_cells(b) for b in table.column("blob").to_pylist()]
    again = repeated(np.concatenate(cells))
    found = [(c, both) for c, own in zip(chunks, cells) if len(both := own[contains(again, own)])]
    return pa.table({"chunk": pa.array([c for c, _ in found], pa.int32()), "row": pa.array([row] * len(found), pa.int32()), "range": pa.array([at] * len(found), pa.int32()), "blob": pa.array([pack_cells(x) for _, x in found], pa.binary())})


_PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])


def _candidates(docs: pa.Table, cells: pa.Table, bits: int, top: int) -> pa.Table:
    """Pairs of the windows whose cells all were handed back, by range of the hash."""
    if not docs.num_rows or not cells.num_rows:
        return _blobs(0, [])
    chunk = Chunk(docs)
    likely = np.ones(len(chunk.hashes), dtype=bool)
    rows, blobs = cells.column("row").to_pylist(), cells.column("blob").to_pylist()
    for row in range(ROWS):
        back = [unpack_cells(b) for r, b in zip(rows, blobs) if r == row]
        likely &= contains(np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *back])), cells_of(chunk.hashes, row, bits))
    pairs = chunk.pairs(np.flatnonzero(likely))
    pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    pairs = pairs[_starts(pairs)]
    return _blobs(docs.column("chunk")[0].as_py(), [(0, r, pairs[a:b].tobytes()) for r, a, b in _by_range(pairs["a"], top, 64)])


def _starts(pairs: np.ndarray) -> np.ndarray:
    """Where a new pair starts among sorted pairs."""
    a, b = pairs["a"], pairs["b"]
    return np.concatenate((a[:1] == a[:1], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))


def _told(table: pa.Table, ranks: int) -> pa.Table:
    """For one range of hashes: the windows that a chunk of smaller rank has, for each chunk; the rank is the number modulo ranks."""
    rows = sorted(zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist()))
    at = table.column("range")[0].as_py()
    pairs = [np.frombuffer(b, dtype=_PAIR) for _, b in rows]
    whole = np.concatenate(pairs)
    owner = np.repeat(np.array([c % ranks for c, _ in rows]), [len(p) for p in pairs])
    order = np.lexsort((owner, whole["b"], whole["a"]))
    whole, owner = whole[order], owner[order]
    fresh = _starts(whole)
    first = owner[fresh][np.cumsum(fresh) - 1]
    late = np.empty(len(order), dtype=bool)
    late[order] = first < owner
    out, i = [], 0
    for (c, _), p in zip(rows, pairs):
        if len(mine := p[late[i : i + len(p)]]):
            out.append((c, mine.tobytes()))
        i += len(p)
    return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "row": pa.array([0] * len(out), pa.int32()), "range": pa.array([at] * len(out), pa.int32()), "blob": pa.array([b for _, b in out], pa.binary())})


def removed_words(docs: pa.Table, told: pa.Table) -> tuple[Chunk, list[np.ndarray]]:
    """The chunk and, for each of its documents, which words go."""
    chunk = Chunk(docs)
    gone = np.zeros(len(chunk.window), dtype=bool)
    # documents are numbered in order of id; equal ids (and null ids) have one number
    number = np.cumsum([a != b for a, b in zip(chunk.ids, chunk.ids[:1] + chunk.ids)])
    known = np.concatenate([np.zeros(0, dtype=_PAIR), *[np.frombuffer(b, dtype=_PAIR) for b in told.column("blob").to_pylist()]])
    maybe = np.flatnonzero(contains(repeated(chunk.hashes), chunk.hashes) | contains(distinct(known["a"] & _TAG), chunk.hashes & _TAG))
    if len(maybe):
        # a told window has the number -1, smaller than every document's
        pairs = np.concatenate((known, chunk.pairs(maybe)))
        owner = np.concatenate((np.full(len(known), -1, dtype=np.int64), number[chunk.doc[maybe]]))
        order = np.lexsort((owner, pairs["b"], pairs["a"]))
        owner = owner[order]
        late = np.empty(len(order), dtype=bool)
        late[order] = owner[np.flatnonzero(fresh := _starts(pairs[order]))][np.cumsum(fresh) - 1] < owner
        gone[maybe] = late[len(known) :]
    steps = np.zeros(int(chunk.bounds[-1]) + 1, dtype=np.int32)
    np.add.at(steps, chunk.window[gone], 1)
    np.add.at(steps, chunk.window[gone] + WINDOW, -1)
    covered = np.cumsum(steps)[:-1] > 0
    return chunk, [covered[a:b] for a, b in zip(chunk.bounds, chunk.bounds[1:])]


def _removal(docs: pa.Table, told: pa.Table, key_type: pa.DataType, texts: bool) -> pa.Table:
    if not docs.num_rows:
        return pa.table({"doc_id": pa.array([], key_type), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
    chunk, gone = removed_words(docs, told)
    kept = []
    for joined, mask in zip(chunk.texts, gone):
        if mask.any():
            joined = b" ".join([w for w, g in zip(joined.split(), mask.tolist()) if not g])
        kept.append(joined.decode() if texts else hashlib.sha256(joined).hexdigest())
    return pa.table({"doc_id": pa.array(chunk.ids, key_type), "n_words": pa.array(chunk.n_words, pa.int64()), "n_removed": pa.array([int(m.sum()) for m in gone], pa.int64()), "kept": pa.array(kept, pa.string())})


def _bucketed(df: DataFrame, edges: list[float], out: str) -> DataFrame:
    """df with the number of the range that `id` falls into; edges are the least ids of all ranges but the first."""
    from pyspark.ml.feature import Bucketizer

    if not edges:
        return df.withColumn(out, F.lit(0))
    ranges = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="id", outputCol=out)
    return ranges.transform(df).withColumn(out, F.col(out).cast("int"))


def chunk_edges(sizes: DataFrame, chunk_bytes: int) -> tuple[list[float], dict[int, int]]:
    """Edges between chunks of about chunk_bytes, and the number of chunks over which a range of one id is spread.

    sizes: doc_id, id (double) and n (bytes) of the rows with an id. The histogram is refined where a range holds more
    than a chunk, until it holds one id; it has a few ranges for each chunk.
    """
    whole = sizes.agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    if not whole["n"]:
        return [], {}
    cut = lambda low, high, n: np.linspace(low, high, 2 * max(1, -(-n // chunk_bytes)) + 1).tolist()
    edges, found = set(cut(whole["low"], whole["high"], whole["n"])[1:]), []
    for _ in range(64):
        rows = _bucketed(sizes, sorted(edges), "range").groupBy("range").agg(
            F.sum("n").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), (F.min("doc_id") == F.max("doc_id")).alias("one")
        )
        found = sorted(rows.collect(), key=lambda r: r["range"])
        more = {e for r in found if r["n"] > chunk_bytes and r["low"] < r["high"] for e in cut(r["low"], r["high"], r["n"])} - edges
        if not more:
            break
        edges |= more
    bounds, spread, held = [], {}, 0
    for i, r in enumerate(found):
        if i and held + r["n"] > chunk_bytes:
            bounds.append(r["low"])
            held = 0
        held += r["n"]
        if r["one"] and r["n"] > chunk_bytes:
            spread[len(bounds)] = -(-r["n"] // chunk_bytes)
    return bounds, spread


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", texts: bool = False) -> DataFrame:
    """Per row of docs: key, n_words, n_removed and kept, the SHA-256 of the kept words or (texts) the words themselves."""
    from pyspark.sql.pandas.types import to_arrow_type

    lean = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumn("id", F.col("doc_id").cast("double"))
    sizes = common.stored(lean.select("doc_id", "id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("n")), "text-sizes")
    weights = {r["missing"]: r["n"] for r in sizes.groupBy(F.col("id").isNull().alias("missing")).agg(F.sum("n").alias("n")).collect()}
    total = sum(weights.values())
    chunk_bytes = int(CHUNK_BYTES * min(MOST, max(1.0, total / GROW_FROM) ** 0.5))
    bounds, spread = chunk_edges(sizes.filter("id IS NOT NULL"), chunk_bytes)
    ranks = len(bounds) + 2
    spread[ranks - 1] = -(-weights.get(True, 0) // chunk_bytes)
    n = ranks + sum(spread.values())
    bits = max(16, min(62, (max(1, total // 4)).bit_length() + 3))
    top = max(0, (total // 6 // MERGE_CELLS).bit_length())
    parts, ranges = 2 * n, 2 << top

    over: Column = F.create_map(*[F.lit(x) for k, v in spread.items() for x in (k, max(1, v))])
    chunked = _bucketed(lean, bounds, "rank").withColumn("rank", F.when(F.col("id").isNull(), ranks - 1).otherwise(F.col("rank")))
    pieces = F.coalesce(F.try_element_at(over, F.col("rank")), F.lit(1))
    chunked = chunked.withColumn("chunk", (F.col("rank") + ranks * F.pmod(F.xxhash64("text"), pieces)).cast("int"))
    chunked = chunked.select("doc_id", "text", "chunk").repartition(parts, "chunk")
    own = chunked.groupBy("chunk")
    blob = "chunk int, row int, range int, blob binary"
    key_type = to_arrow_type(lean.schema["doc_id"].dataType)
    sketches = own.applyInArrow(lambda t: _sketch(t, bits, top), blob)
    heavy = sketches.repartition(ROWS * ranges, "row", "range").groupBy("row", "range").applyInArrow(_merge, blob)
    likely = own.cogroup(heavy.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(lambda d, c: _candidates(d, c, bits, top), blob)
    told = likely.repartition(ranges, "range").groupBy("range").applyInArrow(lambda t: _told(t, ranks), blob)
    out = own.cogroup(told.repartition(parts, "chunk").groupBy("chunk")).applyInArrow(lambda d, t: _removal(d, t, key_type, texts), f"doc_id {lean.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return out.withColumnsRenamed({"doc_id": key})


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return dedup(docs).withColumnsRenamed({"kept": "kept_sha256"})
