"""Baseline JPEG: grey or colour, 8 bits, Huffman coding, with whole arrays for all but the walk from symbol to symbol.

Decoding looks up the code at every bit of the scan at once; the walk then only adds lengths, and all values are read
from the places that it visited. Encoding counts the symbols first and makes the picture's own codes. Pictures are arrays
of height, width and, for colour, three channels, red first; a chroma plane of half the size is spread by a triangle.
"""

from __future__ import annotations

import functools
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulsia.errors import EncodeError, InputError
from emulsia.functions import pixels

#: Steps at quality 50 for brightness and colour, row by row, as the standard recommends.
LUMA_STEPS = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_STEPS = [17, 18, 24, 47, 18, 21, 26, 66, 24, 26, 56, 99, 47, 66, 99, 99]  # of the first four rows and columns, else 99
#: Weights of red, green and blue in brightness.
WEIGHTS = np.array([0.299, 0.587, 0.114])
#: Places of an 8x8 block from corner to corner along its diagonals, every second one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
COSINES = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
MAX_PIXELS = 1 << 28


@functools.lru_cache(256)
def steps(quality: int, chroma: bool) -> np.ndarray:
    """The quantisation steps of a quality from 1 to 100, row by row, not to be written to."""
    base = np.full((8, 8), 99)
    base[:4, :4] = np.reshape(CHROMA_STEPS, (4, 4))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    out = np.clip(((base.ravel() if chroma else np.array(LUMA_STEPS)) * scale + 50) // 100, 1, 255)
    out.setflags(write=False)
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """To whole numbers, halves to even ones also where the sum of a product is off in its last digits."""
    return np.rint(np.round(x, 9))


@dataclass
class Component:
    """A plane of a frame: its sampling, steps, codes, and the blocks across and down that its scan has."""

    name: int
    across: int
    down: int
    table: int
    codes: tuple[int, int] = (0, 0)
    shape: tuple[int, int] = (0, 0)
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((0, 64)))


def _lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits the length of the code that they begin with (0: none) and its symbol."""
    lengths = np.repeat(np.arange(1, len(counts) + 1, dtype=np.uint8), np.array(list(counts), np.int64))[: len(symbols)]
    spans = 1 << 16 - lengths.astype(np.int64)
    left = (1 << 16) - int(spans.sum())
    if left < 0:
        raise InputError("the JPEG's codes don't fit")
    spans = np.append(spans, left)
    return np.repeat(np.append(lengths, np.uint8(0)), spans), np.repeat(np.array([*symbols[: len(lengths)], 0], np.uint8), spans)


def _segments(data: bytes):
    """(marker, body, end) up to the scan."""
    if data[:2] != b"\xff\xd8":
        raise InputError("not a JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise InputError("the JPEG has no marker where one should be")
        if data[at + 1] == 0xFF:
            at += 1
            continue
        marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        if size < 2 or at + 2 + size > len(data):
            break
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        at += 2 + size
    raise InputError("the JPEG is cut off")


def _windows(scan: bytes) -> np.ndarray:
    """The 16 bits that begin at each bit."""
    b = np.frombuffer(scan + bytes(4), np.uint8).astype(np.uint32)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (three[:, None] >> np.arange(8, 0, -1, dtype=np.uint32) & 0xFFFF).astype(np.uint16).ravel()


def _values(windows: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of `sizes` bits at the places: those that begin with 0 are negative."""
    raw = windows[at].astype(np.int64) >> (16 - sizes)
    return np.where(raw < 1 << np.maximum(sizes - 1, 0), raw - (1 << sizes) + 1, raw) * (sizes > 0)


def _interval(scan: bytes, order: list[tuple[int, int, int]], lookups: dict, units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coefficients of `units` units, each of the blocks in `order` (component, codes of DC and AC): block, place, value."""
    windows = _windows(scan)
    limit = 8 * len(scan)
    tables = {}
    for key in {("dc", d) for _, d, _ in order} | {("ac", a) for _, _, a in order}:
        sizes, symbols = (t[windows] for t in lookups[key])
        tables[key] = sizes, symbols, (sizes + (symbols & 15)).tobytes(), symbols.tobytes(), sizes.tobytes()
    alike = {key: ([], []) for key in {(d, a) for _, d, a in order}}  # blocks of the same codes: places in the scan, and whose values they are
    plan = [(tables["dc", d][2], tables["ac", a][2], tables["ac", a][3], tables["ac", a][4], *alike[d, a]) for _, d, a in order]
    dcs = []
    p, many = 0, len(order)
    for block in range(units * many):
        dc, ac, symbol, size, mine, where = plan[block % many]
        dcs.append(p)
        p += dc[p]
        k, base = 1, block << 6
        while k < 64:
            s = symbol[p]
            if not s:
                if not size[p]:
                    raise InputError("the JPEG's scan is damaged")
                p += ac[p]
                break
            k += s >> 4
            mine.append(p)
            where.append(base + k)
            k += 1
            p += ac[p]
        if p > limit or k > 64:
            raise InputError("the JPEG's scan is damaged")
    blocks, index, values = [], [], []
    at = np.array(dcs, np.int64)
    for (d, a), (mine, where) in alike.items():
        those = np.flatnonzero(np.tile([(d, a) == key[1:] for key in order], units)) if len(alike) > 1 else np.arange(units * many)
        for key, ps, to in ((("dc", d), at[those], those << 6), (("ac", a), np.array(mine, np.int64), np.array(where, np.int64))):
            sizes, symbols, *_ = tables[key]
            values.append(_values(windows, ps + sizes[ps], (symbols[ps] & 15).astype(np.int64)))
            blocks.append(to >> 6)
            index.append(to & 63)
    return np.concatenate(blocks), np.concatenate(index), np.concatenate(values)


def _planes(c: Component, table: np.ndarray) -> np.ndarray:
    """The samples of a component's blocks, as a plane."""
    square = np.zeros((len(c.blocks), 64))
    square[:, ZIGZAG] = c.blocks * table
    pixels = COSINES.T @ square.reshape(-1, 8, 8) @ COSINES + 128
    down, across = c.shape
    return np.clip(rounded(pixels), 0, 255).astype(np.int32).reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)


def _spread(plane: np.ndarray, axis: int, times: int) -> np.ndarray:
    """A plane `times` as long along an axis: for 2 each sample takes a quarter of its neighbour, else samples are repeated."""
    if times != 2:
        return plane if times == 1 else np.repeat(plane, times, axis)
    x = np.moveaxis(plane, axis, 0).astype(float)
    before, after = np.concatenate([x[:1], x[:-1]]), np.concatenate([x[1:], x[-1:]])
    out = np.empty((2 * len(x), *x.shape[1:]))
    out[0::2], out[1::2] = (3 * x + before) / 4, (3 * x + after) / 4
    return np.moveaxis(out, 0, axis)


def decode(data: bytes) -> np.ndarray:
    tables, lookups, parts, adobe, restart, size = {}, {}, [], None, 0, (0, 0)
    for marker, body, end in _segments(data):
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                tables[n] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                lookups["ac" if body[0] >> 4 else "dc", body[0] & 15] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3) or not width or not height or width * height > MAX_PIXELS:
                raise InputError("an unsupported kind of JPEG")
            parts, size = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)], (height, width)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise InputError("an unsupported kind of JPEG: not baseline")
        elif marker == 0xDD:
            (restart,) = struct.unpack_from(">H", body)
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            break
    try:
        chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
        if not parts or set(chosen) != {c.name for c in parts} or 0 in [x for c in parts for x in (c.across, c.down)]:
            raise InputError("an unsupported kind of JPEG: several scans")
        _scan(data[end:], parts, chosen, lookups, restart, size)
        planes = [_planes(c, tables[c.table]) for c in parts]
    except (KeyError, IndexError, ValueError) as e:
        raise InputError(f"the JPEG is damaged: {e}") from e
    return _picture(parts, planes, size, adobe)


def _scan(data: bytes, parts: list[Component], chosen: dict, lookups: dict, restart: int, size: tuple[int, int]) -> None:
    """Reads the coefficients of all blocks into the components."""
    if len(parts) == 1:
        parts[0].across = parts[0].down = 1  # a single component isn't interleaved
    wide, high = max(c.across for c in parts), max(c.down for c in parts)
    units = (-(-size[0] // (8 * high)), -(-size[1] // (8 * wide)))
    order, places = [], []
    for i, c in enumerate(parts):
        c.codes, c.shape = chosen[c.name], (units[0] * c.down, units[1] * c.across)
        c.blocks = np.zeros((c.shape[0] * c.shape[1], 64))
        order += [(i, *c.codes)] * (c.across * c.down)
        places += [(y, x) for y in range(c.down) for x in range(c.across)]
    total, done = units[0] * units[1], 0
    for scan in _intervals(data):
        n = min(restart or total, total - done)
        if n <= 0:
            break
        block, index, value = _interval(scan, order, lookups, n)
        unit, slot = block // len(order) + done, block % len(order)
        of, y, x = (np.array(v)[slot] for v in zip(*[(i, *p) for (i, *_), p in zip(order, places)]))
        for i, c in enumerate(parts):
            mine = of == i
            row, column = unit[mine] // units[1] * c.down + y[mine], unit[mine] % units[1] * c.across + x[mine]
            to, k, v = row * c.shape[1] + column, index[mine], value[mine]
            # differences of the first coefficients add up in the order of the scan
            first = np.flatnonzero(k == 0)
            first = first[np.argsort(block[mine][first], kind="stable")]
            v[first] = np.cumsum(v[first])
            c.blocks[to, k] += v
        done += n
    if done < total:
        raise InputError("the JPEG is cut off")


def _intervals(data: bytes) -> list[bytes]:
    """The scan's bytes between restart markers, up to any other marker, without stuffing."""
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0) & (raw[1:] != 0xFF))
    out, begin = [], 0
    for at in marks.tolist():
        out.append(data[begin:at].replace(b"\xff\x00", b"\xff"))
        begin = at + 2
        if not 0xD0 <= data[at + 1] <= 0xD7:
            return out
    return [*out, data[begin:].replace(b"\xff\x00", b"\xff")]


def _picture(parts: list[Component], planes: list[np.ndarray], size: tuple[int, int], adobe: int | None) -> np.ndarray:
    height, width = size
    wide, high = max(c.across for c in parts), max(c.down for c in parts)
    full = []
    for c, plane in zip(parts, planes):
        if wide % c.across or high % c.down:
            raise InputError("an unsupported kind of JPEG: fractions of samples")
        # only samples of the picture are spread, so that what fills its last blocks doesn't bleed in
        plane = plane[: -(-height * c.down // high), : -(-width * c.across // wide)]
        full.append(_spread(_spread(plane, 0, high // c.down), 1, wide // c.across)[:height, :width].astype(float))
    if len(full) == 1:
        return full[0].astype(np.uint8)
    if adobe == 0 or (adobe is None and bytes(c.name for c in parts) == b"RGB"):
        out = np.stack(full, axis=2)
    else:
        y, blue, red = full[0], full[1] - 128, full[2] - 128
        r, b = y + 2 * (1 - WEIGHTS[0]) * red, y + 2 * (1 - WEIGHTS[2]) * blue
        out = np.stack([r, (y - WEIGHTS[0] * r - WEIGHTS[2] * b) / WEIGHTS[1], b], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _code_sizes(counts: np.ndarray) -> np.ndarray:
    """Lengths of the codes of 256 symbols, at most 16; none is all ones."""
    found = np.flatnonzero(counts).tolist()
    heap = [*zip(counts[found].tolist(), found, range(len(found))), (0, 256, len(found))]  # the last keeps the code of all ones free
    above = [0] * (2 * len(found) + 1)
    heapq.heapify(heap)
    for node in range(len(found) + 1, len(above)):
        (a, i, x), (b, j, y) = heapq.heappop(heap), heap[0]
        above[x] = above[y] = node
        heapq.heapreplace(heap, (a + b, max(i, j), node))
    depths = [0] * len(above)
    for node in range(len(above) - 2, -1, -1):
        depths[node] = depths[above[node]] + 1
    number = [0] * max(64, max(depths) + 1)
    for size in depths[: len(found) + 1]:
        number[size] += 1
    for length in range(len(number) - 1, 16, -1):  # a pair that is too deep moves up, beside a shallower code that splits
        while number[length]:
            up = max(k for k in range(1, length - 1) if number[k])
            number[length] -= 2
            number[length - 1] += 1
            number[up + 1] += 2
            number[up] -= 1
    used = [*(i for _, i in sorted(zip(depths, found))), 256] if found else []
    out = np.zeros(257, np.int64)
    out[used] = [length for length in range(1, 17) for _ in range(number[length])]
    return out[:256]


def _codes(sizes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The code of each symbol, and the table as it is stored."""
    order = np.flatnonzero(sizes)
    order = order[np.argsort(sizes[order], kind="stable")]
    found, code, last, number = [], 0, 0, [0] * 17
    for size in sizes[order].tolist():
        code <<= size - last
        found.append(code)
        last = size
        code += 1
        number[size] += 1
    codes = np.zeros(256, np.int64)
    codes[order] = found
    return codes, bytes(number[1:]) + bytes(order.tolist())


def _symbols(blocks: np.ndarray, unit: np.ndarray, begins: list[int]) -> tuple[np.ndarray, ...]:
    """Of planes one behind the other: (block, whether it is a first one, where it belongs, symbol, value, its bits), unsorted; `begins`: each plane's first block."""
    first = blocks[:, 0].copy()
    first[1:] -= blocks[:-1, 0]
    first[begins] = blocks[begins, 0]
    row, k = np.nonzero(blocks[:, 1:])
    k += 1
    before = np.zeros_like(k)
    before[1:] = np.where(row[1:] == row[:-1], k[:-1], 0)
    gap = k - before - 1
    long_ = np.repeat(np.arange(len(row)), gap >> 4)
    nth = np.arange(len(long_)) - np.repeat(np.cumsum(gap >> 4) - (gap >> 4), gap >> 4)
    last = np.zeros(len(blocks), np.int64)
    last[row] = k  # the last one of a row stays
    short = np.flatnonzero(last < 63)
    n, m, at = len(blocks), len(blocks) + len(row), unit * 4096
    value = np.concatenate([first, blocks[row, k], np.zeros(len(long_) + len(short), np.int64)])
    bits = np.frexp(value)[1].astype(np.int64)
    symbol = bits.copy()
    symbol[n:m] += (gap & 15) << 4
    symbol[m : m + len(long_)] = 0xF0
    block = np.concatenate([np.arange(n), row, row[long_], short])
    where = at[block] + np.concatenate([np.zeros(n, np.int64), 16 * k + 15, 16 * k[long_] + nth, np.full(len(short), 16 * 64)])
    return block, np.arange(len(block)) < n, where, symbol, value, bits


def _packed(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Codes of the given sizes one behind the other, the last byte filled up with ones."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    for a in range(0, len(codes), 1 << 20):
        s, c, e = (x[a : a + (1 << 20)] for x in (sizes, codes, ends))
        left = np.repeat(e, s) - np.arange(int(e[0] - s[0]), int(e[-1])) - 1
        bits[int(e[0] - s[0]) : int(e[-1])] = np.repeat(c, s) >> left & 1
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def _filled(planes: np.ndarray, down: int, across: int) -> np.ndarray:
    """Planes filled up to whole numbers of rows and columns by their last samples."""
    more = -planes.shape[-2] % down, -planes.shape[-1] % across
    return np.pad(planes, [(0, 0)] * (planes.ndim - 2) + [(0, n) for n in more], mode="edge") if any(more) else planes


def _blocks(planes: np.ndarray, k: int, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients in zigzag order of planes in the order of the scan, filled up to whole units of k by k blocks."""
    full = _filled(planes, 8 * k, 8 * k) - 128.0
    n, down, across = len(full), full.shape[1] // 8, full.shape[2] // 8
    cells = full.reshape(n, down, 8, across, 8).swapaxes(2, 3)
    waves = (COSINES @ cells @ COSINES.T).reshape(n, down, across, 64)
    found = rounded(waves / table).astype(np.int64)[..., ZIGZAG]
    return found.reshape(n, down // k, k, across // k, k, 64).swapaxes(2, 3).reshape(n, -1, 64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(image: np.ndarray, quality: int = 85, subsampled: bool = True, exif: bytes | None = None) -> bytes:
    """A JPEG of a grey or RGB picture; `subsampled` halves the planes of colour. A lossless JPEG doesn't exist here."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3) or not image.size or (image.ndim == 3 and image.shape[2] not in (1, 3)) or max(image.shape[:2]) > 65535:
        raise EncodeError(f"can't encode an array of {image.dtype} and shape {image.shape} as JPEG")
    if quality is None or not 1 <= quality <= 100:
        raise EncodeError("a JPEG needs a quality from 1 to 100")
    if image.ndim == 2 or image.shape[2] == 1:
        half, k, planes = False, 1, [image.reshape(1, *image.shape[:2]).astype(float)]
    else:
        y, half, k = image @ WEIGHTS, subsampled, 2 if subsampled else 1
        colour = np.stack([(image[..., c] - y) / (2 * (1 - WEIGHTS[c])) + 128 for c in (2, 0)])
        if half:
            even = _filled(colour, 2, 2)
            colour = even.reshape(2, even.shape[1] // 2, 2, even.shape[2] // 2, 2).mean(axis=(2, 4))
        planes = [y[None], colour]
    found = [_blocks(p, k if not i else 1, steps(quality, bool(i))) for i, p in enumerate(planes)]
    n = sum(map(len, planes))
    blocks = np.concatenate([f.reshape(-1, 64) for f in found])
    light, each = found[0].shape[1], len(blocks) - found[0].shape[1]
    at = np.arange(light)
    unit = at // (k * k) * (k * k + n - 1) + at % (k * k)
    if n == 3:
        unit = np.concatenate([unit, *(np.arange(each // 2) * (k * k + 2) + k * k + c for c in (0, 1))])
    block, first, where, symbol, value, bits = _symbols(blocks, unit, [0, light, light + each // 2] if n == 3 else [0])
    # the codes of the brightness' first coefficients and others, then of the colours'
    group = 2 * (block >= light) + ~first
    tables, codes, lengths = b"", [], []
    for g, counts in enumerate(np.bincount(256 * group + symbol, minlength=256 * (n + 1)).reshape(-1, 256)):
        lengths.append(_code_sizes(counts))
        own, stored = _codes(lengths[-1])
        codes.append(own)
        tables += _segment(0xC4, bytes([(g & 1) << 4 | g >> 1]) + stored)
    order = np.argsort(where)
    symbol, value, bits = (256 * group + symbol)[order], value[order], bits[order]
    codes = np.concatenate(codes)[symbol] << bits | np.where(value < 0, value + (1 << bits) - 1, value)
    sizes = np.concatenate(lengths)[symbol] + bits
    frame = struct.pack(">BHHB", 8, *image.shape[:2], n) + b"".join(bytes([i + 1, 0x22 if half and not i else 0x11, min(i, 1)]) for i in range(n))
    scan = bytes([n]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(n)) + bytes([0, 63, 0])
    quants = b"".join(_segment(0xDB, bytes([k]) + bytes(steps(quality, bool(k))[ZIGZAG].tolist())) for k in range(min(n, 2)))
    block = _segment(0xE1, b"Exif\0\0" + exif) if exif else b""
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + block
    return head + quants + _segment(0xC0, frame) + tables + _segment(0xDA, scan) + _packed(codes, sizes) + b"\xff\xd9"


@F.pandas_udf(T.BinaryType())
def grey_jpeg(values: pd.Series, width: pd.Series, times: pd.Series, quality: pd.Series) -> pd.Series:
    """Grey values of 0 to 255, row by row, as a JPEG with each pixel repeated `times` in both directions."""
    return pd.Series([encode(np.kron(np.asarray(v, dtype=np.uint8).reshape(-1, w), np.ones((k, k), dtype=np.uint8)), q) for v, w, k, q in zip(values, width, times, quality)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def jpeg_values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The samples of a JPEG in one array; null for what isn't one."""
    return pixels.samples(batches, decode)
