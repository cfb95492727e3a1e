"""Arithmetic on arrays of pixels, scores and residuals."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulsia.errors import InputError

#: Fixed value: the longest side that WebP takes.
WEBP_SIDE = 16383
#: The samples that a function over pictures hands on at once, unless one picture has more.
SAMPLES_AT_ONCE = 1 << 19
#: The most weights of a resizing that a task remembers for the next picture.
KEPT_WEIGHTS = 1 << 14


def samples(batches: Iterator[pd.Series], decode: Callable[[bytes], np.ndarray]) -> Iterator[pd.Series]:
    """The samples of each picture in one array, null for what isn't one.

    They are handed on in slices of SAMPLES_AT_ONCE: a batch's rows are counted by the session, and its samples needn't fit.
    """
    for b in batches:
        ready, many = [], 0
        for data in b:
            try:
                ready.append(decode(data or b"").ravel().astype(np.int32))
                many += len(ready[-1])
            except InputError:
                ready.append(None)
            if many >= SAMPLES_AT_ONCE:
                yield pd.Series(ready, dtype=object)
                ready, many = [], 0
        if ready:
            yield pd.Series(ready, dtype=object)


def mean_square(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(a)


def psnr(a: Column, b: Column) -> Column:
    """Decibels for a data range of 1; infinite for equal arrays."""
    mse = mean_square(a, b)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(mse))


def diff_map(a: Column, b: Column, amplify: float) -> Column:
    """Absolute differences, amplified and clipped to 0..1."""
    return F.zip_with(a, b, lambda x, y: F.least(F.lit(1.0), F.abs(x.cast("double") - y.cast("double")) * amplify))


def encode_residual(r: Column, high: bool = False) -> Column:
    """A residual as an offset code of 8 or 16 bits: halved, half-even, clipped."""
    middle, top = (32768.0, 65535.0) if high else (128.0, 255.0)
    return F.transform(r, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(top), F.rint(x / 2 + middle))).cast("int"))


def decode_residual(e: Column, high: bool = False) -> Column:
    return F.transform(e, lambda x: x * 2 - (65536 if high else 256))


def soft_mask(x: Column, y: Column, width: Column, height: Column, margin: float) -> Column:
    """Distance to the nearest edge over margin, clipped to 0..1."""
    edge = F.least(y, height - 1 - y, x, width - 1 - x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), edge / margin))


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


#: The constants of SMPTE ST 2084.
PQ = {"m1": 2610 / 16384, "m2": 2523 / 4096 * 128, "c1": 3424 / 4096, "c2": 2413 / 4096 * 32, "c3": 2392 / 4096 * 32}


def pq_encode(nits: Column) -> Column:
    light = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), nits / 10000.0)), F.lit(PQ["m1"]))
    return F.pow((PQ["c1"] + PQ["c2"] * light) / (1 + PQ["c3"] * light), F.lit(PQ["m2"]))


def gain_mapped(base: Column, gain: Column, headroom: float) -> Column:
    """Linear light boosted by 2 to the headroom times the gain."""
    return F.zip_with(base, gain, lambda b, g: b * F.pow(F.lit(2.0), g * headroom))


def to_eight_bits(x: Column) -> Column:
    """16 to 8 bits by rounding half-even."""
    return F.rint(x / 257.0).cast("int")


def view_eight_bits(x: Column) -> Column:
    """16 to 8 bits by flooring, as comparisons show them."""
    return F.floor(x * 255 / 65535.0).cast("int")


def pooled(values: Column) -> Column:
    """(mean, p1, min, frames): p1 is the order statistic at n // 100 - 1, the least for n under 200."""
    ranked = F.sort_array(values)
    at = F.greatest(F.lit(0), F.floor(F.size(values) / 100).cast("int") - 1)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.struct((total / F.size(values)).alias("mean"), F.get(ranked, at).alias("p1"), F.array_min(values).alias("min"), F.size(values).cast("long").alias("frames"))


def median_of(values: Column) -> Column:
    """The median of an array, the mean of the middle two for an even size."""
    ranked, n = F.sort_array(values), F.size(values)
    low, high = F.get(ranked, F.floor((n - 1) / 2).cast("int")), F.get(ranked, F.floor(n / 2).cast("int"))
    return (low + high) / 2.0


def robust_sigma(values: Column) -> Column:
    """1.4826 times the median distance from the median."""
    middle = F.element_at(F.transform(F.array(median_of(values)), lambda m: median_of(F.transform(values, lambda v: F.abs(v - m)))), 1)
    return 1.4826 * middle


def windowed_ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> np.ndarray:
    """Mean structural similarity over all whole windows of the last two axes, data range 1, by summed-area tables."""

    def means(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.cumsum(-2).cumsum(-1), [(0, 0)] * (x.ndim - 2) + [(1, 0), (1, 0)])
        return (s[..., window:, window:] - s[..., :-window, window:] - s[..., window:, :-window] + s[..., :-window, :-window]) / window**2

    n = window * window / (window * window - 1)
    ma, mb = means(a), means(b)
    va, vb, cov = (n * (means(p) - q) for p, q in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    c1, c2 = 0.01**2, 0.03**2
    return np.mean((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2)), axis=(-2, -1))


@F.pandas_udf(T.DoubleType())
def ssim_8x8(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        x, y = (np.stack(s.to_numpy()).astype(float).reshape(-1, 8, 8) if len(s) else np.zeros((0, 8, 8)) for s in (a, b))
        yield pd.Series(windowed_ssim(x, y))


def mask_mass(width: Column, height: Column, margin: int) -> Column:
    """The sum of soft_mask over a crop: a pixel that is k or more from each edge counts 1 / margin for each k up to margin."""
    inside = lambda k: F.greatest(F.lit(0), width - 2 * k).cast("long") * F.greatest(F.lit(0), height - 2 * k)
    return sum((inside(k) for k in range(1, margin + 1)), F.lit(0).cast("long")) / F.lit(float(margin))


def to_unit(x: Column, bits: int) -> Column:
    """Samples of 8 or 16 bits as numbers from 0 to 1; others (0 bits) as they are."""
    return F.transform(x, lambda v: v.cast("double") / (float(2**bits - 1) if bits else 1.0))


def to_depth(x: Column, bits_from: int, bits_to: int) -> Column:
    """Samples of 8 or 16 bits at the other depth: times 257, or divided by it half-even."""
    if bits_from == bits_to:
        return x
    return F.transform(x, lambda v: v.cast("int") * 257 if bits_to == 16 else F.rint(v / 257.0).cast("int"))


def clipped(x: Column, bits: int) -> Column:
    """A float blend cut to the range of its depth, and truncated."""
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(2**bits - 1)), v)).cast("int"))


def fits_webp(width: Column, height: Column) -> Column:
    return (width <= WEBP_SIDE) & (height <= WEBP_SIDE)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image at another size: averages of areas where it shrinks, cubic where it only grows; the same size as it is."""
    if image.shape[:2] == (height, width):
        return image
    shrinks = image.shape[0] > height or image.shape[1] > width
    return _weights(image.shape[0], height, shrinks) @ image @ _weights(image.shape[1], width, shrinks).T


def _weights(n: int, m: int, shrinks: bool) -> np.ndarray:
    """The weights from n samples to m, those of small pictures from memory."""
    return (_kept_weights if n * m <= KEPT_WEIGHTS else _kept_weights.__wrapped__)(n, m, shrinks)


@functools.lru_cache(64)
def _kept_weights(n: int, m: int, shrinks: bool) -> np.ndarray:
    out = (_area_weights if shrinks else _cubic_weights)(n, m)
    out.setflags(write=False)
    return out


def _area_weights(n: int, m: int) -> np.ndarray:
    edges = np.arange(m + 1) * (n / m)
    low, high = edges[:-1, None], edges[1:, None]
    cells = np.arange(n)[None, :]
    share = np.clip(np.minimum(high, cells + 1) - np.maximum(low, cells), 0, None)
    return share / share.sum(axis=1, keepdims=True)


def _cubic_weights(n: int, m: int, a: float = -0.75) -> np.ndarray:
    at = (np.arange(m) + 0.5) * (n / m) - 0.5
    out = np.zeros((m, n))
    for k in range(-1, 3):
        place = np.floor(at).astype(int) + k
        d = np.abs(at - place)
        near = (a + 2) * d**3 - (a + 3) * d**2 + 1
        far = a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
        np.add.at(out, (np.arange(m), np.clip(place, 0, n - 1)), np.where(d <= 1, near, np.where(d < 2, far, 0)))
    return out


def edge_map(gray: np.ndarray, low: float = 80, high: float = 200, sigma: float = 1.5) -> np.ndarray | None:
    """Strong edges of an image of 0 to 255: blur, gradients, the ridge across each gradient, and what hangs on a strong ridge.

    None for an empty image.
    """
    from emulsia.functions.restore import gaussian

    if not gray.size:
        return None
    x = np.pad(gaussian(gray.astype(float), sigma), 1, mode="edge")
    smooth, slope = (1, 2, 1), (-1, 0, 1)
    take = lambda i, j: x[i : i + gray.shape[0], j : j + gray.shape[1]]
    gx = sum(smooth[i] * slope[j] * take(i, j) for i in range(3) for j in range(3))
    gy = sum(slope[i] * smooth[j] * take(i, j) for i in range(3) for j in range(3))
    size = np.abs(gx) + np.abs(gy)
    ring = np.pad(size, 1)
    near = lambda di, dj: ring[1 + di : 1 + di + gray.shape[0], 1 + dj : 1 + dj + gray.shape[1]]
    turn = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    ridge = np.zeros(gray.shape, dtype=bool)
    for k, (di, dj) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        ridge |= (turn == k) & (size > near(-di, -dj)) & (size >= near(di, dj))
    weak, strong = ridge & (size > low), ridge & (size > high)
    while True:
        ring = np.pad(strong, 1)
        grown = weak & (sum(near(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)) > 0)
        if (grown == strong).all():
            return strong
        strong = grown


def detail_ratio(gray: np.ndarray) -> float:
    """The share of pixels on strong edges, 0 for an empty image."""
    edges = edge_map(gray)
    return 0.0 if edges is None else float(edges.mean())
