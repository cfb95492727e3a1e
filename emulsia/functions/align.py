"""Faces lifted out of a picture upright, handed to an enhancer, and laid back: least squares, warps and feathers.

A point is a complex number here, so a rotation with a scale is one multiplication and the least-squares fit a quotient.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The side of an upright face, and where its eyes, nose and corners of the mouth are.
SIDE = 512
UPRIGHT = np.array([[192.98138, 239.94708], [318.90277, 240.1936], [256.63416, 314.01935], [201.26117, 371.41043], [313.08905, 371.15118]])
FEATHER = 10  # the mask falls off over a tenth of a face's side
ROWS = 256  # rows that are warped at a time

Turn = tuple[complex, complex]  # z to a * z + b


def fitted(points: np.ndarray, onto: np.ndarray) -> Turn | None:
    """The turn, scale and move that bring the points nearest to others; null where all points are one."""
    z, w = (np.asarray(p, dtype=float) @ np.array([1, 1j]) for p in (points, onto))
    z0, w0 = z - z.mean(), w - w.mean()
    size = float((np.abs(z0) ** 2).sum())
    if size == 0 or not np.isfinite(size) or not np.isfinite(w).all():
        return None
    a = complex((z0.conj() * w0).sum() / size)
    return (a, complex(w.mean() - a * z.mean())) if a else None


def inverse(turn: Turn) -> Turn:
    a, b = turn
    return 1 / a, -b / a


def fit_column(points: Column, onto: Column) -> Column:
    """fitted over two arrays of (x, y): a struct of the real and imaginary parts of the factor and the move; null likewise."""
    pairs = F.arrays_zip(points.alias("p"), onto.alias("q"))
    mean = lambda part, k: F.aggregate(F.transform(pairs, lambda x: x[part][k]), F.lit(0.0), lambda s, v: s + v) / F.size(pairs)
    means = F.struct(*[mean(p, k).alias(p + k) for p in "pq" for k in "xy"])

    def moved(m: Column) -> Column:
        d = lambda x, p, k: x[p][k] - m[p + k]
        terms = F.transform(pairs, lambda x: F.struct(
            (d(x, "p", "x") * d(x, "q", "x") + d(x, "p", "y") * d(x, "q", "y")).alias("re"), (d(x, "p", "x") * d(x, "q", "y") - d(x, "p", "y") * d(x, "q", "x")).alias("im"), (d(x, "p", "x") * d(x, "p", "x") + d(x, "p", "y") * d(x, "p", "y")).alias("size"),
        ))
        total = lambda k: F.aggregate(terms, F.lit(0.0), lambda s, t: s + t[k])
        re, im = total("re") / total("size"), total("im") / total("size")
        move = F.struct(re.alias("re"), im.alias("im"), (m["qx"] - re * m["px"] + im * m["py"]).alias("x"), (m["qy"] - re * m["py"] - im * m["px"]).alias("y"))
        return F.when(total("size") > 0, move)

    return F.element_at(F.transform(F.array(means), moved), 1)


def warped(image: np.ndarray, turn: Turn, height: int, width: int, origin: complex = 0) -> np.ndarray:
    """The picture under a turn, in a frame that begins at an origin: bilinear, nothing beyond the picture's border."""
    back, rest = inverse(turn)
    flat = image[..., None] if image.ndim == 2 else image
    padded = np.pad(flat.astype(float), ((1, 1), (1, 1), (0, 0)))
    out = np.empty((height, width, flat.shape[2]))
    for top in range(0, height, ROWS):
        y, x = np.mgrid[top : min(height, top + ROWS), 0:width]
        at = back * (x + 1j * y + origin) + rest
        px, py = np.clip(at.real, -1, flat.shape[1]) + 1, np.clip(at.imag, -1, flat.shape[0]) + 1
        left, above = np.minimum(px.astype(int), flat.shape[1]), np.minimum(py.astype(int), flat.shape[0])
        u, v = (px - left)[..., None], (py - above)[..., None]
        pick = lambda dy, dx: padded[above + dy, left + dx]  # noqa: B023, E731
        out[top : top + ROWS] = (1 - v) * ((1 - u) * pick(0, 0) + u * pick(0, 1)) + v * ((1 - u) * pick(1, 0) + u * pick(1, 1))
    return out[..., 0] if image.ndim == 2 else out


def feather(height: int, width: int) -> np.ndarray:
    """1 inside, and down to 0 at the border."""
    ramp = lambda n: np.clip(np.minimum(np.arange(n), np.arange(n)[::-1]) * FEATHER / n, 0, 1)
    return np.minimum(ramp(height)[:, None], ramp(width)[None, :])


def pasted(image: np.ndarray, face: np.ndarray, turn: Turn, strength: float = 1.0) -> np.ndarray:
    """The picture with a face laid under a turn, as strong as asked; only the box that holds the face is worked on."""
    height, width = face.shape[:2]
    a, b = turn
    corners = [a * z + b for z in (0, width, 1j * height, width + 1j * height)]
    if not np.isfinite([abs(c) for c in corners]).all():
        return image
    x1, y1 = (max(0, int(np.floor(min(getattr(c, k) for c in corners)))) for k in ("real", "imag"))
    x2, y2 = (min(n, int(np.ceil(max(getattr(c, k) for c in corners))) + 1) for k, n in (("real", image.shape[1]), ("imag", image.shape[0])))
    if x2 <= x1 or y2 <= y1:
        return image
    over, mask = (warped(x, turn, y2 - y1, x2 - x1, x1 + 1j * y1) for x in (face, feather(height, width)))
    part = strength * (mask[..., None] if image.ndim == 3 else mask)
    out = image.astype(float)
    # what lies beyond the face weighs nothing, so the colours there don't matter
    out[y1:y2, x1:x2] = part * over + (1 - part) * out[y1:y2, x1:x2]
    return out


def enhanced(image: np.ndarray, landmarks: list[np.ndarray], enhance: Callable[[np.ndarray], np.ndarray], strength: float = 1.0, side: int = SIDE) -> np.ndarray:
    """The picture with each face, given by five landmarks, lifted out upright, enhanced and laid back.

    A face that can't be fitted, or that the enhancer fails on or returns in another shape, stays as it is.
    """
    out = image.astype(float)
    for points in landmarks if strength > 0 else []:
        turn = fitted(points, UPRIGHT * side / SIDE)
        if turn is None:
            continue
        face = warped(image, turn, side, side)
        try:
            better = np.asarray(enhance(face), dtype=float)
        except Exception:  # noqa: BLE001, S112 - a model's failure must not lose the picture
            continue
        if better.shape == face.shape and np.isfinite(better).all():
            out = pasted(out, better, inverse(turn), strength)
    return out
