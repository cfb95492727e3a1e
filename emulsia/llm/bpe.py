"""Byte-level BPE: texts to token ids and back, by longest matches and backtracking instead of merging pair by pair.

The bytes of a piece of text are mapped to Latin-1 characters, in which a pyahocorasick automaton finds the longest token
at a place. A token may follow another only if BPE, run on the bytes of both, would leave just these two; that is decided
by undoing their last merges in turn along the border, and remembered for the pair. Where no token fits, the last one is
taken back and the next shorter one tried; a place that was given up is never tried again, so each place is extended once
and the time is linear in the piece. The ids are those of the merges, in the order of the ranks and leftmost first.

A rank file (a token in base64 and its rank a line) has every single byte. It is read once by the driver and broadcast:
its size is checked against RANK_BYTES. Tokens that merges never build are found only where a piece is just that token.

Defined results: a null or empty text has no tokens; bytes that aren't UTF-8 count as U+FFFD; a very long text, even of
one piece, is encoded whole; ids that are null, or outside the vocabulary, decode to null; repeated rows are encoded each;
an empty table gives an empty table; other columns stay, whatever their names, and a new column takes a free name.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
RANK_BYTES = 64 << 20
PIECES = 1 << 18  # pieces that a task remembers,
PIECE_CHARS = 48  # if they are no longer than this
PAIRS = 1 << 19  # pairs of tokens that it remembers


class Vocabulary:
    """The tokens of a rank file with what encoding needs: merges, next shorter tokens, and the automaton."""

    def __init__(self, raw: bytes):
        lines = (line.split() for line in raw.splitlines() if line.strip())
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.size = {r: len(t) for t, r in self.rank.items()}
        self.reach = max(map(len, self.rank))  # no match is longer, so a search sees no more of the piece
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        self.together = functools.lru_cache(maxsize=PAIRS)(self._together)
        self.pieces = Pieces(self)
        self.table = pa.array([self.bytes.get(r) for r in range(max(self.bytes) + 1)] + [None], pa.large_binary())
        self.automaton = ahocorasick.Automaton()
        built = set()
        for token, rank in sorted(self.rank.items(), key=lambda x: x[1]):
            parts = self._last_merge(token, rank, built)
            if parts:
                self.left[rank], self.right[rank] = parts
                self.merged[parts] = rank
            if parts or len(token) == 1:
                built.add(rank)
                self.automaton.add_word(token.decode("latin-1"), rank)
        for rank in built:
            token = self.bytes[rank]
            heads = (self.rank.get(token[:n]) for n in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((h for h in heads if h in built), -1)
        self.automaton.make_automaton()

    def _last_merge(self, token: bytes, rank: int, built: set[int]) -> tuple[int, int] | None:
        """The two tokens whose merge is the last one that builds a token."""
        for n in range(len(token) - 1, 0, -1):
            a, b = self.rank.get(token[:n]), self.rank.get(token[n:])
            if a in built and b in built and self._together(a, b):
                return a, b
        return None

    def _together(self, a: int, b: int) -> bool:
        """Whether BPE on the bytes of two tokens ends in these two.

        a and b walk along the border to the parts from which they were merged, the later merge undone first. Each pair
        of parts stood side by side until the first of them was merged into its own token (until_a, until_b): a merge of
        the two with a lower rank would have come before that, and one of equal rank before that of b, which is further
        to the right.
        """
        until_a = until_b = math.inf
        while True:
            joint = self.merged.get((a, b))
            if joint is not None and joint < until_a and joint <= until_b:
                return False
            since_a, since_b = a if a in self.right else -1, b if b in self.left else -1
            if since_a == since_b == -1:
                return True
            if since_a > since_b:
                until_a, a = a, self.right[a]
            else:
                until_b, b = b, self.left[b]

    def piece(self, raw: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        if raw in self.rank:
            return [self.rank[raw]]
        text, end = raw.decode("latin-1"), len(raw)
        size, together, shorter, scan = self.size, self.together, self.shorter, self.automaton.iter_long
        ids: list[int] = []
        at = 0
        for _, token in scan(text):  # the longest tokens one after another, up to the first that doesn't fit
            if ids and not together(ids[-1], token):
                break
            ids.append(token)
            at += size[token]
        open_ends = bytearray(b"\1") * (end + 1) if at < end else b""
        while at < end:
            while token >= 0 and not (open_ends[at + size[token]] and (not ids or together(ids[-1], token))):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at += size[token]
                token = next(scan(text[at : at + self.reach]))[1] if at < end else -1
            else:
                open_ends[at] = 0
                token = ids.pop()
                at -= size[token]
        return ids

    def encode(self, text: str, pattern: regex.Pattern) -> np.ndarray:
        """The ids of a text, as 32-bit integers."""
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, pattern.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> pa.LargeBinaryArray:
        """The bytes of each id, or null where there is no such id."""
        return self.table.take(pa.array(np.where((ids >= 0) & (ids < len(self.table)), ids, len(self.table) - 1)))


class Pieces(dict):
    """Pieces to their ids in bytes, computed where they are missing; the whole memory is dropped when it is full."""

    def __init__(self, words: Vocabulary):
        self.words = words

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.words.piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


@functools.lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    """One vocabulary a worker process and file."""
    return Vocabulary(raw)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, name])


def _encode(batches: Iterator[pa.RecordBatch], ranks, pattern: str, text: int, ids: str) -> Iterator[pa.RecordBatch]:
    words, cut = vocabulary(ranks.value), regex.compile(pattern)
    for whole in batches:
        for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
            rows = [words.encode((raw or b"").decode(errors="replace"), cut) for raw in batch.column(text).to_pylist()]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            kept = batch.select([i for i in range(batch.num_columns) if i != text])
            yield _with(kept, ids, pa.ListArray.from_arrays(ends, np.concatenate(rows)))


def _decode(batches: Iterator[pa.RecordBatch], ranks, ids: int, out: str) -> Iterator[pa.RecordBatch]:
    words = vocabulary(ranks.value)
    for whole in batches:
        for batch in (whole.slice(i, 64) for i in range(0, whole.num_rows, 64)):
            column = batch.column(ids)
            flat = column.flatten()
            tokens = words.decode(flat.fill_null(-1).to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            misses = np.concatenate([[0], np.cumsum(tokens.is_null().to_numpy(zero_copy_only=False))])
            unknown = (misses[ends[1:]] > misses[ends[:-1]]) | column.is_null().to_numpy(zero_copy_only=False)
            # the bytes of all tokens lie one after another in the buffer: a row's are those between its ends
            places = np.concatenate([[0], np.cumsum(pc.binary_length(tokens).fill_null(0).to_numpy(zero_copy_only=False))])[ends]
            joined = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(places.astype(np.int64).tobytes()), tokens.buffers()[2] or pa.py_buffer(b"")])
            yield _with(batch, out, pc.if_else(pa.array(unknown), None, joined).cast(pa.binary()))


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as file:
        raw = file.read(RANK_BYTES + 1)
    if len(raw) > RANK_BYTES:
        raise ValueError(f"{path}: over {RANK_BYTES} bytes, too large to broadcast")
    return df.sparkSession.sparkContext.broadcast(raw)


def encode(docs: DataFrame, path: str, text: str = "text", pattern: str = public_tokenizers.PATTERN, name: str = "ids") -> DataFrame:
    """docs with the ids of each text's tokens, an array of int under the name (or a free one near it)."""
    ranks = _broadcast(docs, path)
    raw, (ids,) = common.fresh(docs, "__raw")[0], common.fresh(docs, name)
    at, schema = len(docs.columns), T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    with_raw = docs.withColumn(raw, F.col(text).cast("binary"))
    return with_raw.mapInArrow(lambda b: _encode(b, ranks, pattern, at, ids), schema)


def decode(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids stand for, under the name (or a free one near it)."""
    ranks = _broadcast(docs, path)
    (out,) = common.fresh(docs, name)
    at, schema = docs.columns.index(ids), T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())])
    return docs.mapInArrow(lambda b: _decode(b, ranks, at, out), schema)


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256."""
    path = path or public_tokenizers.path(RANKS)
    both = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    ids = F.array_join("ids", ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
