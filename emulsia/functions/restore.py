"""Restoring a picture from its container as array arithmetic: blur, grain, back-projection, blending.

Plain NumPy on one picture at a time; `blended` is the built-in form of the linear blend.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most samples of noise that a task remembers for the next picture.
KEPT_NOISE = 1 << 16


def gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    """Separable blur of the first two axes, edges reflected without the border pixel."""
    if sigma <= 0:
        return x.astype(float)
    reach = max(1, int(round(3 * sigma)))
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    taps /= taps.sum()
    out = x.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = np.abs(np.arange(-reach, n + reach))
        at = np.where(at >= n, 2 * (n - 1) - at, at) if n > 1 else np.zeros(n + 2 * reach, dtype=int)
        padded = np.take(out, np.clip(at, 0, n - 1), axis=axis)
        out = sum(t * np.take(padded, np.arange(k, k + n), axis=axis) for k, t in enumerate(taps))
    return out


def shrink(x: np.ndarray, by: int) -> np.ndarray:
    """Means of by x by blocks; a rest at the border is left out."""
    h, w = x.shape[0] // by * by, x.shape[1] // by * by
    return x[:h, :w].reshape(h // by, by, w // by, by, *x.shape[2:]).mean(axis=(1, 3))


def enlarge(x: np.ndarray, by: int) -> np.ndarray:
    """Bilinear enlargement about pixel centres."""
    out = x.astype(float)
    for axis in (0, 1):
        n = out.shape[axis]
        at = (np.arange(n * by) + 0.5) / by - 0.5
        low = np.clip(np.floor(at).astype(int), 0, n - 1)
        high, part = np.minimum(low + 1, n - 1), np.clip(at - low, 0, 1)
        part = part.reshape([-1 if a == axis else 1 for a in range(out.ndim)])
        out = np.take(out, low, axis=axis) * (1 - part) + np.take(out, high, axis=axis) * part
    return out


def anchored(upscaled: np.ndarray, stored: np.ndarray, scale: float) -> np.ndarray:
    """The upscale with its low frequencies replaced by those of the stored background."""
    sigma = 1 / scale
    return upscaled - gaussian(upscaled, sigma) + gaussian(enlarge(stored, round(1 / scale)), sigma)


def back_projected(upscaled: np.ndarray, stored: np.ndarray, by: int, rounds: int) -> np.ndarray:
    """The upscale moved, half a step a round, until it shrinks to the stored background."""
    out = upscaled.astype(float)
    for _ in range(rounds):
        out = out + 0.5 * enlarge(stored - shrink(out, by), by)
    return out


def grain(shape: tuple[int, int], sigma: float, soft: float = 0.7) -> np.ndarray:
    """Seeded, blurred noise of the given deviation, the same for all channels."""
    field, deviation = (_noise if shape[0] * shape[1] <= KEPT_NOISE else _noise.__wrapped__)(tuple(shape), soft)
    return field * (sigma / max(deviation, 1e-12))


@functools.lru_cache(16)
def _noise(shape: tuple[int, int], soft: float) -> tuple[np.ndarray, float]:
    """Blurred noise that is the same each time, and its deviation."""
    field = gaussian(np.random.default_rng(0).standard_normal(shape), soft)
    field.setflags(write=False)
    return field, field.std()


def composite(background: np.ndarray, patches: list[tuple[tuple[int, int, int, int], np.ndarray, np.ndarray]]) -> np.ndarray:
    """Patches (box, pixels, mask) laid over the background in order: regions first, faces last."""
    out = background.astype(float)
    for (x1, y1, x2, y2), pixels, mask in patches:
        m = mask[..., None] if pixels.ndim == 3 else mask
        out[y1:y2, x1:x2] = m * pixels + (1 - m) * out[y1:y2, x1:x2]
    return out


def poisson(background: np.ndarray, box: tuple[int, int, int, int], patch: np.ndarray) -> np.ndarray:
    """The background with a patch whose differences between neighbours are kept and whose border is the background's.

    The inner pixels solve the discrete Poisson equation, directly by sine transforms; a box under three pixels a side is
    pasted as it is.
    """
    x1, y1, x2, y2 = box
    out = background.astype(float)
    under, over = out[y1:y2, x1:x2], patch.astype(float)
    if min(under.shape[:2]) < 3:
        out[y1:y2, x1:x2] = over
        return out
    # what the patch lacks of the border spreads harmonically over its inside
    lack = under - over
    lack[1:-1, 1:-1] = 0
    spread = lack[:-2, 1:-1] + lack[2:, 1:-1] + lack[1:-1, :-2] + lack[1:-1, 2:]
    n, m = spread.shape[:2]
    eigen = (2 - 2 * np.cos(np.pi * np.arange(1, n + 1) / (n + 1)))[:, None] + (2 - 2 * np.cos(np.pi * np.arange(1, m + 1) / (m + 1)))[None, :]
    rows, columns = (np.sin(np.pi * np.outer(np.arange(1, k + 1), np.arange(1, k + 1)) / (k + 1)) * np.sqrt(2 / (k + 1)) for k in (n, m))
    turned = np.einsum("ij,jk...,kl->il...", rows, spread, columns)
    inner = np.einsum("ij,jk...,kl->il...", rows, turned / eigen.reshape(n, m, *[1] * (spread.ndim - 2)), columns)
    out[y1 + 1 : y2 - 1, x1 + 1 : x2 - 1] = over[1:-1, 1:-1] + inner
    return out


def blended(front: Column, back: Column, mask: Column) -> Column:
    """m * front + (1 - m) * back over three arrays."""
    pairs = F.arrays_zip(front.alias("f"), back.alias("b"), mask.alias("m"))
    return F.transform(pairs, lambda p: p["m"] * p["f"] + (1 - p["m"]) * p["b"])
