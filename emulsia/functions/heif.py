"""HEIF files as items: the box tree, what each item is, its bytes, turns, profile, EXIF block and gain map; no pixels.

A decoder plug-in gets whole files. An item beside the primary one (a gain map, say) becomes a file of its own, so that
the same plug-in decodes it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulsia.errors import InputError
from emulsia.functions import exif

#: Brands of still pictures, what says that an auxiliary picture is a gain map, and containers of boxes.
BRANDS = (b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1", b"avif")
GAIN_NAME = "hdrgainmap"
MOST_ITEMS = 1 << 16


@dataclass
class Item:
    """id, type, and what the file says of it; `parts` are (where: file or own data, offset, length)."""

    id: int
    kind: str
    parts: list[tuple[int, int, int]] = field(default_factory=list)
    properties: list[tuple[str, bytes]] = field(default_factory=list)
    refers: dict[str, list[int]] = field(default_factory=dict)

    def said(self, kind: str) -> bytes | None:
        return next((body for k, body in self.properties if k == kind), None)

    @property
    def size(self) -> tuple[int, int] | None:
        """Width and height before any turn."""
        body = self.said("ispe")
        return struct.unpack_from(">II", body, 4) if body else None

    @property
    def quarters(self) -> int:
        """Quarter turns against the clock."""
        body = self.said("irot")
        return body[0] & 3 if body else 0

    @property
    def mirror(self) -> str | None:
        """The axis: vertical (left and right change places) or horizontal."""
        body = self.said("imir")
        return None if not body else "horizontal" if body[0] & 1 else "vertical"

    @property
    def auxiliary(self) -> str | None:
        body = self.said("auxC")
        return body[4:].partition(b"\0")[0].decode("utf-8", "replace") if body else None

    @property
    def profile(self) -> bytes | None:
        return next((b[4:] for k, b in self.properties if k == "colr" and b[:4] in (b"prof", b"rICC")), None)


def owns(data: bytes) -> bool:
    """Whether the bytes begin as a HEIF file's."""
    if data[4:8] != b"ftyp":
        return False
    size = min(struct.unpack_from(">I", data)[0], 256)
    return any(data[at : at + 4] in BRANDS for at in (8, *range(16, size, 4)))


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Type, start and end of the content of each box in a range."""
    while at < end:
        if at + 8 > end:
            raise InputError("a box is cut off")
        size, kind, head = struct.unpack_from(">I", data, at)[0], data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1:
            if at + 16 > end:
                raise InputError(f"the {kind} box is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise InputError(f"the {kind} box is cut off")
        yield kind, at + head, at + size
        at += size


class Reader:
    """Numbers of a box's content, one after another."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def number(self, size: int) -> int:
        if self.at + size > self.end:
            raise InputError("a box ends too early")
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "big")

    def full(self) -> tuple[int, int]:
        """Version and flags."""
        return self.number(1), self.number(3)


class Heif:
    """The items of a file and the primary one's id."""

    def __init__(self, data: bytes):
        self.data, self.items, self.primary, self.own = data, {}, 0, (0, 0)
        if not owns(data):
            raise InputError("not a HEIF file")
        meta = next(((a, b) for kind, a, b in boxes(data, 0, len(data)) if kind == "meta"), None)
        if meta is None:
            raise InputError("the HEIF file has no items")
        parts = {kind: (a, b) for kind, a, b in boxes(data, meta[0] + 4, meta[1])}
        self.own = parts.get("idat", (0, 0))
        for kind, read in (("iinf", self._names), ("pitm", self._primary), ("iloc", self._places), ("iref", self._references), ("iprp", self._properties)):
            if kind in parts:
                read(*parts[kind])
        if self.primary not in self.items:
            raise InputError("the HEIF file has no primary item")

    def _names(self, at: int, end: int) -> None:
        r = Reader(self.data, at, end)
        r.number(2 if r.full()[0] == 0 else 4)
        for kind, a, b in boxes(self.data, r.at, end):
            entry = Reader(self.data, a, b)
            version, _ = entry.full()
            if kind == "infe" and version >= 2:
                number = entry.number(2 if version == 2 else 4)
                entry.number(2)
                self.items[number] = Item(number, self.data[entry.at : entry.at + 4].decode("latin-1"))
        if len(self.items) > MOST_ITEMS:
            raise InputError("the HEIF file has too many items")

    def _primary(self, at: int, end: int) -> None:
        r = Reader(self.data, at, end)
        self.primary = r.number(2 if r.full()[0] == 0 else 4)

    def _places(self, at: int, end: int) -> None:
        r = Reader(self.data, at, end)
        version, _ = r.full()
        a, b = r.number(1), r.number(1)
        offset, length, base, index = a >> 4, a & 15, b >> 4, b & 15 if version else 0
        for _ in range(r.number(4 if version == 2 else 2)):
            item = self.items.get(r.number(4 if version == 2 else 2))
            where = r.number(2) & 15 if version else 0
            r.number(2)
            start = r.number(base)
            for _ in range(r.number(2)):
                r.number(index)
                part = where, start + r.number(offset), r.number(length)
                if item:
                    item.parts.append(part)

    def _references(self, at: int, end: int) -> None:
        r = Reader(self.data, at, end)
        wide = 2 if r.full()[0] == 0 else 4
        for kind, a, b in boxes(self.data, r.at, end):
            entry = Reader(self.data, a, b)
            source = self.items.get(entry.number(wide))
            targets = [entry.number(wide) for _ in range(entry.number(2))]
            if source:
                source.refers.setdefault(kind, []).extend(targets)

    def _properties(self, at: int, end: int) -> None:
        parts = list(boxes(self.data, at, end))
        known = [(kind, self.data[a:b]) for k, x, y in parts if k == "ipco" for kind, a, b in boxes(self.data, x, y)]
        for _, a, b in (p for p in parts if p[0] == "ipma"):
            r = Reader(self.data, a, b)
            version, flags = r.full()
            for _ in range(r.number(4)):
                item = self.items.get(r.number(2 if version == 0 else 4))
                for _ in range(r.number(1)):
                    n = r.number(2) & 0x7FFF if flags & 1 else r.number(1) & 0x7F
                    if n > len(known):
                        raise InputError("an item has a property that isn't there")
                    if item and n:
                        item.properties.append(known[n - 1])

    def bytes_of(self, number: int) -> bytes:
        item = self.items.get(number)
        if item is None or not item.parts:
            raise InputError(f"item {number} has no data")
        out = []
        for where, offset, length in item.parts:
            low, high = (0, len(self.data)) if where == 0 else self.own
            stop = low + offset + length if length else high
            if where > 1 or stop > high:
                raise InputError(f"item {number} lies outside of the file")
            out.append(self.data[low + offset : stop])
        return b"".join(out)

    def exif(self) -> bytes | None:
        """The EXIF block that describes the primary item, behind its name; null where none can be read."""
        for item in self.items.values():
            if item.kind == "Exif" and self.primary in item.refers.get("cdsc", [self.primary]):
                try:
                    raw = self.bytes_of(item.id)
                except InputError:
                    return None
                block = raw[4 + int.from_bytes(raw[:4], "big") :]
                return (b"" if block.startswith(exif.EXIF_NAME) else exif.EXIF_NAME) + block if block else None
        return None

    def gain_map(self) -> Item | None:
        """The auxiliary picture of the primary item that is a gain map."""
        mine = (i for i in self.items.values() if self.primary in i.refers.get("auxl", []))
        return next((i for i in mine if GAIN_NAME in (i.auxiliary or "").lower()), None)

    def picture(self, number: int) -> bytes:
        """An item, with the tiles it is derived from, as a file of its own."""
        kept, queue = {}, [number]
        while queue:
            n = queue.pop(0)
            if n not in kept and n in self.items:
                kept[n] = self.items[n]
                queue += kept[n].refers.get("dimg", [])
        new = {old: i for i, old in enumerate(kept, 1)}
        refers = lambda item: {k: [new[t] for t in to] for k, to in item.refers.items() if k == "dimg"}
        return write([(Item(new[n], i.kind, [], i.properties, refers(i)), self.bytes_of(n)) for n, i in kept.items()])


def box(kind: str, *content: bytes, version: int | None = None, flags: int = 0) -> bytes:
    head = b"" if version is None else bytes([version]) + flags.to_bytes(3, "big")
    body = head + b"".join(content)
    return struct.pack(">I", 8 + len(body)) + kind.encode("latin-1") + body


def write(items: list[tuple[Item, bytes]], brand: bytes = b"heic") -> bytes:
    """A file of items and their bytes, the first of them primary."""
    known: list[tuple[str, bytes]] = []
    for item, _ in items:
        known += [p for p in item.properties if p not in known]
    wide = len(known) > 127
    number = lambda n: struct.pack(">H", n) if wide else bytes([n])
    names = box("iinf", struct.pack(">H", len(items)), *[box("infe", struct.pack(">HH", i.id, 0), i.kind.encode("latin-1"), b"\0", version=2) for i, _ in items], version=0)
    links = [box(kind, struct.pack(f">HH{len(to)}H", i.id, len(to), *to)) for i, _ in items for kind, to in i.refers.items() if to]
    linked = box("iref", *links, version=0) if links else b""
    held = b"".join(struct.pack(">HB", i.id, len(i.properties)) + b"".join(number(known.index(p) + 1) for p in i.properties) for i, _ in items)
    described = box("iprp", box("ipco", *[box(k, b) for k, b in known]), box("ipma", struct.pack(">I", len(items)), held, version=0, flags=int(wide)))
    first = box("ftyp", brand, bytes(4), b"mif1", brand)

    def meta(start: int) -> bytes:
        rows, at = [], start
        for i, data in items:
            rows.append(struct.pack(">HHHII", i.id, 0, 1, at, len(data)))
            at += len(data)
        places = box("iloc", b"\x44\0", struct.pack(">H", len(items)), *rows, version=0)
        return box("meta", box("hdlr", bytes(4), b"pict", bytes(13), version=0), box("pitm", struct.pack(">H", items[0][0].id), version=0), places, names, linked, described, version=0)

    head = first + meta(0)
    return first + meta(len(head) + 8) + box("mdat", *[data for _, data in items])


FACTS = T.StructType([T.StructField(n, t) for n, t in (
    ("width", T.IntegerType()), ("height", T.IntegerType()), ("quarters", T.IntegerType()), ("mirror", T.StringType()), ("items", T.IntegerType()), ("exif", T.BinaryType()), ("icc", T.BinaryType()),
    ("gain_name", T.StringType()), ("gain_width", T.IntegerType()), ("gain_height", T.IntegerType()), ("gain_bytes", T.IntegerType()),
)])


def facts(data: bytes | None) -> tuple | None:
    """A row of FACTS; null where the file can't be read."""
    try:
        h = Heif(data or b"")
        first, gain = h.items[h.primary], h.gain_map()
        size, small = first.size or (None, None), (gain.size if gain else None) or (None, None)
        count = len(h.bytes_of(gain.id)) if gain else None
        return (*size, first.quarters, first.mirror, len(h.items), h.exif(), first.profile, gain.auxiliary if gain else None, *small, count)
    except (InputError, struct.error):
        return None


@F.pandas_udf(FACTS)
def heif_facts(files: pd.Series) -> pd.DataFrame:
    """What a HEIF file carries beside its pixels; nulls for what isn't one or is damaged."""
    return pd.DataFrame([facts(data) or (None,) * len(FACTS) for data in files], columns=FACTS.names)


@F.pandas_udf(T.BinaryType())
def heif_file(sizes: pd.DataFrame) -> pd.Series:
    """A file of (width, height, quarters, exif, icc, gain): a primary item without pixels, a gain map of `gain` bytes if that isn't 0."""

    def one(r) -> bytes:
        shown = lambda w, h: ("ispe", struct.pack(">III", 0, int(w), int(h)))
        items = [(Item(1, "hvc1", [], [shown(r.width, r.height), ("irot", bytes([int(r.quarters)])), ("colr", b"prof" + r.icc)]), b"pixels")]
        items.append((Item(2, "Exif", [], [], {"cdsc": [1]}), bytes(4) + r.exif))
        if r.gain:
            items.append((Item(3, "hvc1", [], [shown(r.width // 2, r.height // 2), ("auxC", bytes(4) + b"urn:com:apple:photo:2020:aux:hdrgainmap\0")], {"auxl": [1]}), bytes(int(r.gain))))
        return write(items)

    return pd.Series([one(r) for r in sizes.itertuples()], dtype=object)
