"""Codecs as plug-ins beside the built-in PNG and JPEG: what is there, encoding, decoding by content, and checked round trips."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from emulsia.errors import EncodeError, InputError
from emulsia.functions import heif, jpeg, pixels, png

#: The names and suffixes that settings may ask for.
KNOWN = ("avif", "jxl", "webp", "jpg", "png", "heif")


@dataclass(frozen=True)
class Codec:
    """encode: from an array and a quality (null: lossless) to bytes; decode: back; owns: whether bytes are of this format."""

    name: str
    encode: Callable[[np.ndarray, int | None], bytes]
    decode: Callable[[bytes], np.ndarray]
    owns: Callable[[bytes], bool]


BUILT_IN = {
    "png": Codec("png", lambda image, quality: png.encode(image), png.decode, lambda data: data.startswith(png.SIGNATURE)),
    "jpg": Codec("jpg", jpeg.encode, jpeg.decode, lambda data: data[:3] == b"\xff\xd8\xff"),
}
_codecs = dict(BUILT_IN)


def register(codec: Codec) -> None:
    if codec.name not in KNOWN:
        raise EncodeError(f"{codec.name!r} isn't one of {', '.join(KNOWN)}")
    _codecs[codec.name] = codec


def unregister(name: str) -> None:
    """Takes a plug-in away; in the place of a built-in codec, that one is back."""
    if _codecs.get(name) is BUILT_IN.get(name, False):
        raise EncodeError(f"{name} is built in")
    _codecs.pop(name, None)
    if name in BUILT_IN:
        _codecs[name] = BUILT_IN[name]


def plugins() -> dict[str, Codec]:
    """What is registered beside the built-in codecs: a job takes it along, as tasks run in processes of their own."""
    return {name: codec for name, codec in _codecs.items() if codec is not BUILT_IN.get(name)}


def install(found: dict[str, Codec]) -> None:
    """The built-in codecs and those that a job took along, and no others that an earlier job left in the process."""
    _codecs.clear()
    _codecs.update(BUILT_IN | found)


def available(name: str) -> bool:
    return name in _codecs


def encode(image: np.ndarray, name: str, quality: int | None) -> bytes:
    if name not in _codecs:
        raise EncodeError(f"the codec {name!r} isn't installed: register one, or ask for one of {', '.join(sorted(_codecs))}")
    if name == "webp" and max(image.shape[:2]) > pixels.WEBP_SIDE:
        raise EncodeError(f"{image.shape[1]}x{image.shape[0]} is over the {pixels.WEBP_SIDE} pixels a side that webp takes: ask for avif or jxl")
    return _codecs[name].encode(image, quality)


def decode(data: bytes) -> np.ndarray:
    for codec in _codecs.values():
        if codec.owns(data):
            return codec.decode(data)
    if heif.owns(data):
        raise InputError("no installed codec reads HEIF pixels: register one under the name heif")
    raise InputError("no installed codec reads this format")


def unit(image: np.ndarray) -> np.ndarray:
    """Samples as numbers from 0 to 1 by their depth."""
    return image / float(np.iinfo(image.dtype).max) if image.dtype.kind == "u" else image.astype(float)


def similarity(a: np.ndarray, b: np.ndarray, longest: int | None = None) -> float:
    """Mean similarity over the channels; with `longest`, of copies shrunk to that side. Sides under 7 pixels compare by difference."""
    a, b = unit(a), unit(b)
    scale = longest / max(a.shape[:2]) if longest and max(a.shape[:2]) > longest else 1.0
    size = tuple(max(1, round(n * scale)) for n in a.shape[:2])
    planes = [(x[..., None] if x.ndim == 2 else x) for x in (a, b)]
    planes = [np.stack([pixels.resized(x[..., k], *size) for k in range(x.shape[2])]) for x in planes]
    if min(size) < 7:
        return float(1 - np.abs(planes[0] - planes[1]).mean())
    return float(np.mean(pixels.windowed_ssim(*planes)))


def checked(data: bytes, image: np.ndarray, thorough: bool = False, floor: float = 0.90) -> float | None:
    """The similarity of the decoded bytes and the picture where that was asked for; an error if they can't be the same picture."""
    try:
        back = decode(data)
    except InputError as e:
        raise EncodeError(f"the output can't be decoded: {e}") from e
    if back.shape[:2] != image.shape[:2]:
        raise EncodeError(f"the output has {back.shape[1]}x{back.shape[0]} pixels, the source {image.shape[1]}x{image.shape[0]}")
    if not thorough:
        return None
    score = similarity(image, back, 512)
    if score < floor:
        raise EncodeError(f"the output doesn't look like the source: similarity {score:.3f}, at least {floor:.2f} is asked")
    return score
