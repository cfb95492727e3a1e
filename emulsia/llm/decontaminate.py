"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned along the training texts.

A text is lower-cased (A-Z) and cut into words; the windows of an item are its runs of N words, or all of its words if
it has fewer. The broadcast set is flat arrays: the items' words in one byte string, a sorted hash a word, and a sorted
hash and a place a window, about 20 bytes for a word of the benchmark beside the text. A scan hashes the windows of a
document whose words all occur in the benchmark, looks them up, and verifies each hit on the words themselves, so a hash
collision marks nothing. Documents aren't shuffled. Items are broadcast in blocks of at most BLOCK_BYTES of text: a
larger benchmark is scanned in several passes over the same rows, each in a stage behind the last.

Defined results: a null text has no words; an item without words has no windows; a null item id marks words but isn't
listed; equal ids count once; a very long text is scanned whole; columns of docs may have any names; an empty benchmark
marks nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

N = 10
BLOCK_BYTES = 16 << 20
#: Fixed value: a word of a lower-cased text; bytes from 0x80 belong to other characters of UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


def hashed(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` word hashes that starts at a place in `at`."""
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * _BASE + words[at + k]
    return out


class Grams:
    """Windows of the items, by length: sorted hashes and the places of their first words in the items' words."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = N):
        self.names, texts, hashes, counts = [], [], [], []
        for name, text in items:
            if words := words_of(text):
                self.names.append(name)
                texts.append(b" ".join(words))
                hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)))
                counts.append(len(words))
        self.text = b" ".join(texts)
        self.first = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))  # first word of each item
        words = np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])
        self.known = np.unique(words)
        blanks = np.flatnonzero(np.frombuffer(self.text, dtype=np.uint8) == 32)
        self.ends = np.append(blanks, len(self.text)).astype(np.uint32)  # of the words in text
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.minimum(n, counts) if counts else np.zeros(0, dtype=np.int64)
        for size in np.unique(sizes).tolist():
            at = np.concatenate([np.arange(self.first[i], self.first[i + 1] - size + 1, dtype=np.uint32) for i in np.flatnonzero(sizes == size).tolist()])
            keys = hashed(words, at, size)
            order = np.argsort(keys, kind="stable")
            self.windows[size] = (keys[order], at[order])

    def words(self, at: int, size: int) -> bytes:
        return self.text[int(self.ends[at - 1]) + 1 if at else 0 : int(self.ends[at + size - 1])]

    def scan(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """Verified windows: first word, number of words, and names of the items, from words and their hashes; an empty word is a gap."""
        inside = _contains(self.known, hashes)
        gaps = np.concatenate(([0], np.cumsum(~inside)))
        for size, (keys, places) in self.windows.items():
            n = len(hashes) - size + 1
            if n <= 0:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:n])
            mine = hashed(hashes, at, size)
            hit = _contains(keys, mine)
            at, mine = at[hit], mine[hit]
            low, high = np.searchsorted(keys, mine), np.searchsorted(keys, mine, side="right")
            for i, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
                text = b" ".join(words[i : i + size])
                where = [p for p in places[a:b].tolist() if self.words(p, size) == text]
                if where:
                    yield i, size, {self.names[k] for k in np.searchsorted(self.first, where, side="right") - 1}


def _contains(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


SPANS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))
NAMES = pa.list_(pa.string())


def _scan_batches(batches: Iterator[pa.RecordBatch], grams: Grams, text: str, words: str, spans: str, items: str, later: bool) -> Iterator[pa.RecordBatch]:
    """Adds, or on a later pass extends, the number of words, the marked spans and the names of the items."""
    for whole in batches:
        for batch in [whole.slice(i, 256) for i in range(0, whole.num_rows, 256)]:
            docs = [words_of(t) for t in batch.column(text).to_pylist()]
            bounds = np.cumsum([0, *[len(w) + 1 for w in docs]])
            flat = [x for w in docs for x in (*w, b"")]  # no word is empty: a gap between documents
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat), dtype=np.uint64, count=len(flat))
            marked: list[list[dict]] = [[] for _ in docs]
            named: list[set] = [set() for _ in docs]
            for i, size, names in grams.scan(flat, hashes):
                d = int(np.searchsorted(bounds, i, side="right")) - 1
                marked[d].append({"at": i - int(bounds[d]), "n": size})
                named[d] |= {x for x in names if x is not None}
            columns = dict(zip(batch.schema.names, batch.columns))
            if later:
                marked = [a + b for a, b in zip(columns[spans].to_pylist(), marked)]
                named = [set(a) | b for a, b in zip(columns[items].to_pylist(), named)]
            columns |= {words: pa.array([len(w) for w in docs], pa.int64()), spans: pa.array(marked, SPANS), items: pa.array([sorted(s, key=lambda x: x.encode()) for s in named], NAMES)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, names: tuple[str, str, str] = ("n_words", "hits", "items")) -> DataFrame:
    """docs with the number of words, the hit spans (overlapping; at and n in words) and the items that occur."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).distinct()
    sizes = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-sizes // BLOCK_BYTES))
    words, spans, items = names
    context = docs.sparkSession.sparkContext
    rows = rows.withColumn("k", F.pmod(F.xxhash64("t"), F.lit(blocks)))
    for k in range(blocks):
        # a block holds about BLOCK_BYTES by construction of `blocks`
        grams = context.broadcast(Grams([(r["i"], r["t"]) for r in rows.filter(F.col("k") == k).collect()], n))
        schema = docs.schema if k else T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{words}` long, `{spans}` array<struct<at:int,n:int>>, `{items}` array<string>").fields])
        scan = lambda batches, g=grams, later=bool(k): _scan_batches(batches, g.value, text, words, spans, items, later)
        docs = docs.mapInArrow(scan, schema)
    return docs


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hits, items = b.column("hits").to_pylist(), b.column("items").to_pylist()
        counts = []
        for spans in hits:
            end = total = 0
            for i, size in sorted((s["at"], s["n"]) for s in spans):
                total += max(0, i + size - max(i, end))
                end = max(end, i + size)
            counts.append(total)
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("n_words"), pa.array(counts, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
            pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([c > 0 for c in counts], pa.bool_()),
        ], names=names)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark(docs.select("doc_id", "text"), benchmark).drop("text")
    key = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(_digest_batches, f"doc_id {key}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _without_spans(batches: Iterator[pa.RecordBatch], text: str, spans: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for t, hit in zip(b.column(text).to_pylist(), b.column(spans).to_pylist()):
            if hit:
                raw = t.encode()
                at = [m.span() for m in WORD.finditer(raw.lower())]
                kept, last = [], 0
                for i, size in sorted((s["at"], s["n"]) for s in hit):
                    begin, end = at[i][0], at[i + size - 1][1]
                    if begin > last:
                        kept.append(raw[last:begin])
                    last = max(last, end)
                t = b"".join([*kept, raw[last:]]).decode()
            out.append(t)
        columns = dict(zip(b.schema.names, b.columns)) | {text: pa.array(out, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text") -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without the hit spans in the texts."""
    names = tuple(common.fresh(docs, "__n_words", "__hits", "__items"))
    marked = mark(docs, benchmark, text, names=names)
    if remove == "documents":
        return marked.filter(F.size(names[1]) == 0).select(*docs.columns)
    return marked.mapInArrow(lambda b: _without_spans(b, text, names[1]), marked.schema).select(*docs.columns)
