"""PNG with the standard library: grey, grey with alpha, RGB, RGBA and palettes, 8 or 16 bits, not interlaced.

Pictures are arrays of height, width and channels (none for grey), uint8 or uint16, red first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulsia.errors import EncodeError, InputError
from emulsia.functions import pixels

#: The signature, and the channels of the colour types.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not data.startswith(SIGNATURE):
        raise InputError("not a PNG")
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise InputError(f"the {kind.decode('latin-1')} chunk is damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise InputError("the PNG is cut off")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(image: np.ndarray, exif: bytes | None = None, icc: bytes | None = None, level: int = 6) -> bytes:
    """A PNG whose rows are stored as differences from the row above, with the EXIF block and profile given."""
    if image.dtype not in (np.uint8, np.uint16) or image.ndim not in (2, 3) or not image.size:
        raise EncodeError(f"can't encode an array of {image.dtype} and shape {image.shape}")
    kinds = {1: 0, 2: 4, 3: 2, 4: 6}
    cube = image[..., None] if image.ndim == 2 else image
    if cube.shape[2] not in kinds:
        raise EncodeError(f"can't encode {cube.shape[2]} channels")
    bits = 8 * image.dtype.itemsize
    rows = np.ascontiguousarray(cube.astype(image.dtype.newbyteorder(">"))).view(np.uint8).reshape(len(cube), -1)
    up = rows.copy()
    up[1:] -= rows[:-1]
    lines = np.concatenate([np.full((len(rows), 1), 2, dtype=np.uint8), up], axis=1)
    head = struct.pack(">IIBBBBB", cube.shape[1], cube.shape[0], bits, kinds[cube.shape[2]], 0, 0, 0)
    extra = (_chunk(b"iCCP", b"profile\0\0" + zlib.compress(icc)) if icc else b"") + (_chunk(b"eXIf", exif) if exif else b"")
    return SIGNATURE + _chunk(b"IHDR", head) + extra + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, lines: int, width: int, step: int) -> np.ndarray:
    rows = raw.reshape(lines, width + 1)
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if (kinds == 2).all():
        return np.cumsum(out, axis=0, dtype=np.uint8)
    above = np.zeros(width, dtype=np.uint8)
    for kind, line in zip(kinds.tolist(), out):
        if kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind == 2:
            line += above
        elif kind == 3:
            for i in range(width):
                line[i] = (int(line[i]) + ((int(line[i - step]) if i >= step else 0) + int(above[i])) // 2) & 255
        elif kind == 4:
            for i in range(width):
                a, b, c = (int(line[i - step]), int(above[i]), int(above[i - step])) if i >= step else (0, int(above[i]), 0)
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[i] = (int(line[i]) + near) & 255
        elif kind:
            raise InputError(f"unknown row filter {kind}")
        above = line
    return out


def decode(data: bytes) -> np.ndarray:
    head, palette, packed = None, None, []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[3] not in CHANNELS or head[2] not in (8, 16) or head[6]:
        raise InputError("an unsupported kind of PNG")
    width, height, bits, kind, *_ = head
    step = CHANNELS[kind] * bits // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8)
    except zlib.error as e:
        raise InputError(f"the PNG is damaged: {e}") from e
    if len(raw) != height * (width * step + 1):
        raise InputError("the PNG has another number of pixels than it says")
    rows = _unfiltered(raw, height, width * step, step)
    image = rows.view(">u2").astype(np.uint16) if bits == 16 else rows
    image = image.reshape(height, width, CHANNELS[kind])
    if kind == 3:
        if palette is None or image.max(initial=0) >= len(palette):
            raise InputError("the PNG lacks colours of its palette")
        return palette[image[..., 0]]
    return image[..., 0] if CHANNELS[kind] == 1 else image


def extras(data: bytes) -> tuple[bytes | None, bytes | None]:
    """The EXIF block and the profile."""
    found = {kind: body for kind, body in chunks(data) if kind in (b"eXIf", b"iCCP")}
    icc = found.get(b"iCCP")
    try:
        return found.get(b"eXIf"), zlib.decompress(icc.partition(b"\0")[2][1:]) if icc else None
    except zlib.error:
        return found.get(b"eXIf"), None


@F.pandas_udf(T.BinaryType())
def grey_png(values: pd.Series, width: pd.Series, times: pd.Series) -> pd.Series:
    """Grey values of 0 to 255, row by row, as a PNG with each pixel repeated `times` in both directions."""
    return pd.Series([encode(np.kron(np.asarray(v, dtype=np.uint8).reshape(-1, w), np.ones((k, k), dtype=np.uint8))) for v, w, k in zip(values, width, times)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def png_values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The samples of a PNG in one array; null for what isn't one."""
    return pixels.samples(batches, decode)
