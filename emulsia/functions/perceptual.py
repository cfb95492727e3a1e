"""SSIMULACRA 2: how alike two pictures look, 100 for equal ones, about 90 where nobody sees a difference.

Both pictures are brought to linear light and halved up to five times; at each size they become three planes (red against
green, brightness, blue against brightness, all made positive), whose local means and variances come from a Gaussian of
deviation 1.5. Three maps tell errors of structure, edges that weren't there and details that are gone; of each the mean
and the mean fourth power's root are weighed and summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulsia.errors import InputError

SCALES, SIDE, SIGMA = 6, 8, 1.5
#: Absorption of red, green and blue, and its bias.
ABSORBED = np.array([[0.30, 0.622, 0.078], [0.23, 0.692, 0.078], [0.24342268924547819, 0.20476744424496821, 0.5518098665095536]])
BIAS = 0.0037930732552754493
#: What makes the planes positive, and the constant of the structure term.
X_TIMES, X_PLUS, Y_PLUS, B_PLUS, STABLE = 14.0, 0.42, 0.01, 0.55, 0.0009
#: Weights by plane, size, norm (mean, fourth power) and map (structure, new edges, lost details).
WEIGHTS = np.array([
    0.0, 0.0007376606707406586, 0.0, 0.0, 0.0007793481682867309, 0.0, 0.0, 0.0004371155730107379, 0.0, 1.1041726426657346, 0.00066284834129271, 0.00015231632783718752,
    0.0, 0.0016406437456599754, 0.0, 1.8422455520539298, 11.441172603757666, 0.0, 0.0007989109436015163, 0.000176816438078653, 0.0, 1.8787594979546387, 10.94906990605142, 0.0,
    0.0007289346991508072, 0.9677937080626833, 0.0, 0.00014003424285435884, 0.9981766977854967, 0.00031949755934435053, 0.0004550992113792063, 0.0, 0.0, 0.0013648766163243398, 0.0, 0.0,
    0.0, 0.0, 0.0, 7.466890328078848, 0.0, 17.445833984131262, 0.0006235601634041466, 0.0, 0.0, 6.683678146179332, 0.00037724407979611296, 1.027889937768264,
    225.20515300849274, 0.0, 0.0, 19.213238186143016, 0.0011401524586618361, 0.001237755635509985, 176.39317598450694, 0.0, 0.0, 24.43300999870476, 0.28520802612117757, 0.0004485436923833408,
    0.0, 0.0, 0.0, 34.77906344483772, 44.835625328877896, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
    0.0, 0.0008680556573291698, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0005313191874358747, 0.0, 0.00016533814161379112, 0.0, 0.0,
    0.0, 0.0, 0.0, 0.0004179171803251336, 0.0017290828234722833, 0.0, 0.0020827005846636437, 0.0, 0.0, 8.826982764996862, 23.19243343998926, 0.0,
    95.1080498811086, 0.9863978034400682, 0.9834382792465353, 0.0012286405048278493, 171.2667255897307, 0.9807858872435379, 0.0, 0.0, 0.0, 0.0005130064588990679, 0.0, 0.00010854057858411537,
]).reshape(3, SCALES, 2, 3)
#: From the weighted sum to the score.
SUM_TIMES, CUBIC, POWER, SLOPE = 0.9562382616834844, (2.326765642916932, -0.020884521182843837, 6.248496625763138e-05), 0.6276336467831387, 10.0


def kernel(sigma: float = SIGMA) -> np.ndarray:
    """Taps of a Gaussian made of three cosines that vanish at its ends, and have its area and its variance."""
    radius = round(3.2795 * sigma + 0.2546)
    waves = np.array([1, 3, 5]) * np.pi / (2 * radius)
    n = np.arange(-radius, radius + 1)
    cosines = np.cos(waves[:, None] * n)
    # the cosines nearest to the Gaussian's own spectrum, among those with sum 1 and variance sigma squared
    near = np.exp(-0.5 * (sigma * waves) ** 2) / radius
    bounds = np.stack([cosines.sum(axis=1), (cosines * n**2).sum(axis=1)])
    lack = np.array([1.0, sigma**2]) - bounds @ near
    return (near + bounds.T @ np.linalg.solve(bounds @ bounds.T, lack)) @ cosines


def blurred(planes: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Planes under a separable kernel; there is nothing beyond their borders."""
    half = len(taps) // 2
    for axis in (-1, -2):
        wide = np.pad(planes, [(half, half) if a == planes.ndim + axis else (0, 0) for a in range(planes.ndim)])
        length = planes.shape[axis]
        planes = sum(t * np.take(wide, range(k, k + length), axis=axis) for k, t in enumerate(taps))
    return planes


def linear(image: np.ndarray) -> np.ndarray:
    """Linear light of 8- or 16-bit samples: three planes, equal ones for grey."""
    x = image / float(np.iinfo(image.dtype).max) if image.dtype.kind == "u" else np.asarray(image, dtype=float)
    x = x[..., None] if x.ndim == 2 else x
    x = np.repeat(x[..., :1], 3, axis=2) if x.shape[2] < 3 else x[..., :3]
    return np.moveaxis(np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4), 2, 0)


def halved(planes: np.ndarray) -> np.ndarray:
    """Means of squares of four samples, the last ones repeated where a side is odd."""
    even = np.pad(planes, [(0, 0), (0, planes.shape[1] % 2), (0, planes.shape[2] % 2)], mode="edge")
    return even.reshape(3, even.shape[1] // 2, 2, even.shape[2] // 2, 2).mean(axis=(2, 4))


def opponents(light: np.ndarray) -> np.ndarray:
    """Red against green, brightness, and blue against brightness, all positive."""
    mixed = np.cbrt(np.maximum(np.tensordot(ABSORBED, light, 1) + BIAS, 0)) - np.cbrt(BIAS)
    x, y, b = (mixed[0] - mixed[1]) / 2, (mixed[0] + mixed[1]) / 2, mixed[2]
    return np.stack([X_TIMES * x + X_PLUS, y + Y_PLUS, b - y + B_PLUS])


def _norms(errors: np.ndarray) -> np.ndarray:
    """Mean, and root of the mean fourth power, of each plane."""
    return np.stack([errors.mean(axis=(1, 2)), (errors**4).mean(axis=(1, 2)) ** 0.25], axis=1)


def _errors(a: np.ndarray, b: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """By plane, norm and map."""
    mean_a, mean_b, aa, bb, ab = blurred(np.stack([a, b, a * a, b * b, a * b]), taps)
    like = (1 - (mean_a - mean_b) ** 2) * (2 * (ab - mean_a * mean_b) + STABLE) / ((aa - mean_a * mean_a) + (bb - mean_b * mean_b) + STABLE)
    edges = (1 + np.abs(b - mean_b)) / (1 + np.abs(a - mean_a)) - 1
    return np.stack([_norms(np.maximum(1 - like, 0)), _norms(np.maximum(edges, 0)), _norms(np.maximum(-edges, 0))], axis=2)


def score(before: np.ndarray, after: np.ndarray) -> float:
    """The score of a picture against the one before it; sizes with a side under 8 don't count, the first always does."""
    if before.shape[:2] != after.shape[:2] or not before.size:
        raise InputError("the pictures have different sizes, or none")
    a, b, taps, total = linear(before), linear(after), kernel(), 0.0
    for scale in range(SCALES):
        if scale and min(a.shape[1:]) < SIDE:
            break
        total += float((WEIGHTS[:, scale] * np.abs(_errors(opponents(a), opponents(b), taps))).sum())
        a, b = halved(a), halved(b)
    total *= SUM_TIMES
    total = CUBIC[0] * total + CUBIC[1] * total**2 + CUBIC[2] * total**3
    return 100.0 - SLOPE * total**POWER if total > 0 else 100.0


@F.pandas_udf(T.DoubleType())
def raster_score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The score of two grey rasters of 0 to 255, row by row, of the given width; null where one is missing or another size."""

    def one(a, b, width) -> float | None:
        if a is None or b is None or len(a) != len(b) or not len(a) or len(a) % width:
            return None
        return score(*(np.asarray(v, dtype=np.uint8).reshape(-1, width) for v in (a, b)))

    for batch in batches:
        yield pd.Series([one(*x) for x in zip(*batch)], dtype=float)
