"""EXIF blocks and JPEG segments as bytes: orientation, removal of the place, profiles, and pictures behind the first.

Blocks are edited in place: what isn't meant stays byte for byte, also what this module doesn't know. A block that can't
be parsed is handed back as it is, with orientation 1.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulsia.errors import InputError

#: Tags, sizes of the TIFF types, and names at the start of JPEG segments.
ORIENTATION, GPS = 0x0112, 0x8825
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
EXIF_NAME, XMP_NAME, ICC_NAME, MPF_NAME = b"Exif\0\0", b"http://ns.adobe.com/xap/1.0/\0", b"ICC_PROFILE\0", b"MPF\0"
GAIN_MARKERS = (b"hdrgainmap", b"hdr-gain-map")


@dataclass
class Entry:
    tag: int
    kind: int
    count: int
    at: int  # of the entry

    @property
    def size(self) -> int:
        return TYPE_BYTES.get(self.kind, 1) * self.count


class Block:
    """A TIFF structure in a bytearray, with or without the name of an EXIF segment before it."""

    def __init__(self, data: bytes):
        self.data = bytearray(data)
        self.start = len(EXIF_NAME) if data.startswith(EXIF_NAME) else 0
        order = bytes(self.data[self.start : self.start + 2])
        if order not in (b"II", b"MM") or self.number(2, 2, "<" if order == b"II" else ">") != 42:
            raise ValueError("not a TIFF structure")
        self.order = "<" if order == b"II" else ">"

    def number(self, at: int, n: int, order: str | None = None) -> int:
        return struct.unpack_from((order or self.order) + {2: "H", 4: "I"}[n], self.data, self.start + at)[0]

    def put(self, at: int, n: int, value: int) -> None:
        struct.pack_into(self.order + {2: "H", 4: "I"}[n], self.data, self.start + at, value)

    def entries(self, directory: int) -> list[Entry]:
        n = self.number(directory, 2)
        return [Entry(self.number(at, 2), self.number(at + 2, 2), self.number(at + 4, 4), at) for at in range(directory + 2, directory + 2 + 12 * n, 12)]

    def first(self) -> int:
        return self.number(4, 4)

    def find(self, tag: int) -> Entry | None:
        return next((e for e in self.entries(self.first()) if e.tag == tag), None)

    def blank(self, at: int, n: int) -> None:
        end = min(len(self.data), self.start + at + n)
        self.data[self.start + at : end] = bytes(max(0, end - self.start - at))


def read_orientation(data: bytes | None) -> int:
    """The orientation, 1 where it is absent, out of 1 to 8, or the block can't be parsed."""
    try:
        block = Block(data or b"")
        entry = block.find(ORIENTATION)
        value = block.number(entry.at + 8, 2) if entry else 1
    except (ValueError, struct.error):
        return 1
    return value if 1 <= value <= 8 else 1


def upright(data: bytes | None) -> bytes | None:
    """The block with orientation 1, for pixels that were turned."""
    try:
        block = Block(data or b"")
        if entry := block.find(ORIENTATION):
            block.put(entry.at + 8, 2, 1)
            return bytes(block.data)
    except (ValueError, struct.error):
        pass
    return data


def without_place(data: bytes | None) -> bytes | None:
    """The block without its GPS directory: the pointer goes, and the directory and its values are blanked."""
    try:
        block = Block(data or b"")
        entry = block.find(GPS)
        if entry is None:
            return data
        directory = block.number(entry.at + 8, 4)
        for e in block.entries(directory):
            if e.size > 4:
                block.blank(block.number(e.at + 8, 4), e.size)
        block.blank(directory, 2 + 12 * block.number(directory, 2) + 4)
        # the entries behind the pointer, and the offset of the next directory, move up by one entry
        first = block.first()
        n = block.number(first, 2)
        end = first + 2 + 12 * n + 4
        moved = bytes(block.data[block.start + entry.at + 12 : block.start + end])
        block.data[block.start + entry.at : block.start + end] = moved + bytes(12)
        block.put(first, 2, n - 1)
        return bytes(block.data)
    except (ValueError, struct.error):
        return data


def has_place(data: bytes | None) -> bool:
    try:
        return Block(data or b"").find(GPS) is not None
    except (ValueError, struct.error):
        return False


def segments(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(marker, offset of the marker, payload) of the segments of a JPEG up to its scan."""
    if data[:2] != b"\xff\xd8":
        raise InputError("not a JPEG: it doesn't start with FFD8")
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        size = struct.unpack_from(">H", data, at + 2)[0]
        yield data[at + 1], at, data[at + 4 : at + 2 + size]
        at += 2 + size


def _named(data: bytes, marker: int, name: bytes) -> Iterator[tuple[int, bytes]]:
    for m, at, payload in segments(data):
        if m == marker and payload.startswith(name):
            yield at + 4 + len(name), payload[len(name) :]


def exif_of(data: bytes) -> bytes | None:
    return next((EXIF_NAME + p for _, p in _named(data, 0xE1, EXIF_NAME)), None)


def xmp_of(data: bytes) -> bytes | None:
    return next((p for _, p in _named(data, 0xE1, XMP_NAME)), None)


def profile_of(data: bytes) -> bytes | None:
    """The ICC profile, put together from its numbered parts; null if one is missing."""
    parts = {p[0]: (p[1], p[2:]) for _, p in _named(data, 0xE2, ICC_NAME) if len(p) > 2}
    total = next(iter(parts.values()))[0] if parts else 0
    return b"".join(parts[i][1] for i in range(1, total + 1)) if parts and set(parts) == set(range(1, total + 1)) else None


def app_ends(data: bytes) -> tuple[int, int]:
    """Ends of the leading run of APP0 and APP1 segments, and of the last APP1 in it."""
    run = last = 2
    for marker, at, payload in segments(data):
        if marker not in (0xE0, 0xE1):
            break
        run = at + 4 + len(payload)
        if marker == 0xE1:
            last = run
    return run, last


def pictures(data: bytes) -> list[bytes]:
    """The pictures behind the first that a multi-picture index names."""
    found = next(_named(data, 0xE2, MPF_NAME), None)
    if found is None:
        return []
    base, mp = found
    try:
        block = Block(mp)
        index = block.find(0xB002)
        first = block.number(index.at + 8, 4) if index else 0
        rows = [(block.number(first + 16 * i + 4, 4), block.number(first + 16 * i + 8, 4)) for i in range(index.count // 16)] if index else []
    except (ValueError, struct.error):
        return []
    return [data[base + offset : base + offset + size] for size, offset in rows[1:]]


def gain_map_of(data: bytes | None) -> tuple[int, bytes, bytes] | None:
    """(number, bytes, XMP) of the first picture whose XMP says that it is a gain map."""
    try:
        for i, picture in enumerate(pictures(data or b""), start=1):
            xmp = xmp_of(picture) if picture[:2] == b"\xff\xd8" else None
            if xmp and any(m in xmp.lower() for m in GAIN_MARKERS):
                return i, picture, xmp
    except (InputError, struct.error):
        pass
    return None


def with_gain_map(primary: bytes, gain: bytes, primary_xmp, index, segment) -> bytes:
    """A JPEG with a gain map behind it: XMP and index go behind the last APP1, the map to the end.

    primary_xmp: from the map's length to a packet; segment: from a packet to an APP1; index: from the size of the
    whole first picture, the place of the index's byte-order mark and the map's length to an APP2 of a fixed size.
    """
    _, at = app_ends(primary)
    xmp = segment(primary_xmp(len(gain)))
    mark = at + len(xmp) + 4 + len(MPF_NAME)
    total = len(primary) + len(xmp) + len(index(0, 0, 0))
    return primary[:at] + xmp + index(total, mark, len(gain)) + primary[at:] + gain


@F.pandas_udf(T.IntegerType())
def orientation_udf(blocks: pd.Series) -> pd.Series:
    return blocks.map(read_orientation)


@F.pandas_udf(T.BinaryType())
def upright_udf(blocks: pd.Series) -> pd.Series:
    return blocks.map(upright)


@F.pandas_udf(T.BinaryType())
def without_place_udf(blocks: pd.Series) -> pd.Series:
    return blocks.map(without_place)


@F.pandas_udf(T.BooleanType())
def has_place_udf(blocks: pd.Series) -> pd.Series:
    return blocks.map(has_place)


CARRIED = T.StructType([T.StructField(n, t) for n, t in (("exif", T.BinaryType()), ("icc", T.BinaryType()), ("orientation", T.IntegerType()), ("gain_map", T.BinaryType()), ("gain_xmp", T.StringType()))])


@F.pandas_udf(CARRIED)
def jpeg_metadata_udf(files: pd.Series) -> pd.DataFrame:
    """What a JPEG carries beside its pixels; nulls for what isn't one."""
    rows = []
    for data in files:
        try:
            exif, icc = exif_of(data or b""), profile_of(data or b"")
        except (InputError, struct.error):
            exif = icc = None
        gain = gain_map_of(data)
        rows.append((exif, icc, read_orientation(exif), gain[1] if gain else None, gain[2].decode("utf-8", "ignore") if gain else None))
    return pd.DataFrame(rows, columns=["exif", "icc", "orientation", "gain_map", "gain_xmp"])
