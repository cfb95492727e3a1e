"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames of about FRAME_BYTES that decompress on their own; a bundle is a run of frames and a
skippable frame with the seek table, in the public seekable format. The index maps a record to its bundle, frame and
offset within the frame. Bundles are written to the shared folder under a name of the attempt that wrote them, and only
bundles that the written manifest names are read, so a repeated task leaves a file that nobody reads.

Of equal payloads of at least REVISIT_BYTES bytes, the one with the largest page id is a response and the others
revisit it. Payloads move once.

Defined results: a null html is the empty payload; a null id is smaller than every id; rows with the same id and
payload are all responses or all revisits; ids of any characters are quoted in the records; a null url is written as
none; an empty table gives an empty table. Payloads without a digest meet none in the join: each has a key of its own.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 16 << 20
#: Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
NO_ID = "%"  # in the place of a null id: what no quoted id is
INDEX = "record_id string, bundle string, frame int, offset int, length int"


@dataclass
class Record:
    record_id: str
    kind: str
    url: str | None
    payload: bytes
    digest: str
    size: int
    refers_to: str | None

    def to_bytes(self) -> bytes:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {self.size}\r\n\r\n".encode()
        block = http + (self.payload if self.kind == "response" else b"")
        lines = ["WARC/1.1", f"WARC-Type: {self.kind}", f"WARC-Record-ID: <urn:x-page:{self.record_id}>", f"WARC-Date: {DATE}"]
        if self.url is not None:
            lines.append(f"WARC-Target-URI: {quote(self.url, safe=chr(37) + ':/?#[]@!$&()*+,;=~')}")
        lines.append(f"WARC-Payload-Digest: sha1:{self.digest}")
        if self.kind == "revisit":
            lines += [f"WARC-Refers-To: <urn:x-page:{self.refers_to}>", f"WARC-Profile: {PROFILE}"]
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[Record]:
    """The records of a frame; a payload that doesn't have its digest is an error."""
    at = 0
    bare = lambda x: x.removeprefix("<urn:x-page:").removesuffix(">") if x is not None else None
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"record {head['WARC-Record-ID']} doesn't have its digest")
        yield Record(bare(head["WARC-Record-ID"]), head["WARC-Type"], head.get("WARC-Target-URI"), payload, digest, size, bare(head.get("WARC-Refers-To")))
        at = end + 4 + len(block) + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def open_uri(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


class BundleWriter:
    """Packs records into frames and frames into bundles; `rows` are the index."""

    def __init__(self, folder: str):
        self.fs, self.root = open_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.out, self.name, self.frames, self.written, self.buffer, self.rows = None, "", [], 0, bytearray(), []

    def add(self, record: Record) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            self.out, self.frames, self.written = self.fs.open_output_stream(f"{self.root}/{self.name}", compression=None), [], 0
        data = record.to_bytes()
        self.rows.append((record.record_id, self.name, len(self.frames), len(self.buffer), len(data)))
        self.buffer += data
        if len(self.buffer) >= FRAME_BYTES:
            self._frame()
            if self.written >= BUNDLE_BYTES:
                self.close()

    def _frame(self) -> None:
        packed = self.pack(bytes(self.buffer))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.buffer)))
        self.written += len(packed)
        self.buffer = bytearray()

    def close(self) -> None:
        if self.out is not None:
            if self.buffer:
                self._frame()
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None

    def taken_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, folder: str, name: str):
        fs, root = open_uri(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{name} has no seek table")
        sizes = list(struct.iter_unpack("<II", self.file.read_at(8 * n, size - 9 - 8 * n)))
        self.frames, at = [], 0
        for packed, whole in sizes:
            self.frames.append((at, packed, whole))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, whole = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=whole)

    def record(self, frame: int, offset: int, length: int) -> Record:
        return next(parse(self.frame(frame)[offset : offset + length]))

    def __iter__(self) -> Iterator[Record]:
        for i in range(len(self.frames)):
            yield from parse(self.frame(i))


def _arrow(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _named(who: str | None) -> str:
    return NO_ID if who is None else quote(who, safe="")


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    writer = BundleWriter(folder)
    names, types = ["record_id", "bundle", "frame", "offset", "length"], [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    for b in batches:
        for who, url, html, keeper in zip(*(b.column(c).to_pylist() for c in ("page", "url", "html", "keeper"))):
            payload = (html or "").encode()
            kind = "response" if keeper is None or keeper == who else "revisit"
            writer.add(Record(_named(who), kind, url, payload, hashlib.sha1(payload).hexdigest(), len(payload), _named(keeper) if kind == "revisit" else None))
        yield _arrow(writer.taken_rows(), names, types)
    writer.close()
    yield _arrow(writer.taken_rows(), names, types)


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes bundles into the folder and returns the index, a row for each record."""
    payload = common.text_of(F.col(html))
    lean = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), payload.alias("html"))
    alone = F.concat(F.lit("alone-"), F.monotonically_increasing_id().cast("string"))
    lean = lean.withColumn("digest", F.when(F.octet_length("html") >= REVISIT_BYTES, F.sha2("html", 256)).otherwise(alone))
    groups = lean.filter(F.octet_length("html") >= REVISIT_BYTES).groupBy("digest").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = common.join_same(lean, groups.hint("merge"), ["digest"], "left", nulls=())
    ids = joined.select(F.col("id").cast("string").alias("page"), "url", "html", F.col("keeper").cast("string").alias("keeper"))
    return common.stored(ids.mapInArrow(lambda b: _write(b, folder), INDEX), "warc-index")


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    names, types = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for bundle in b.column("bundle").to_pylist():
            yield _arrow([(r.record_id, r.size, r.digest, r.kind, r.refers_to) for r in BundleReader(folder, bundle)], names, types)


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """The records of the bundles that the index names."""
    bundles = index.groupBy("bundle").count().select("bundle").repartition("bundle")
    return bundles.mapInArrow(lambda b: _read(b, folder), "page string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = common.new_path(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    back = lambda c: F.when(F.col(c) != NO_ID, F.url_decode(c)).cast(kind)
    records = read_archive(write_archive(pages, folder), folder)
    return records.select(back("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", back("refers_to").alias("refers_to"))
