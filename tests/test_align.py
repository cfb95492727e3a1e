"""Faces lifted out and laid back: fits, warps there and back, feathers, and enhancers that fail."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsia import photos, settings
from emulsia.functions import align, png

RNG = np.random.default_rng(6)


def scene(height=300, width=360):
    y, x = np.mgrid[:height, :width]
    return np.stack([128 + 60 * np.sin(x / (17 + 5 * c)) * np.cos(y / 23) for c in range(3)], axis=2)


def landmarks(scale, angle, x, y):
    turn = scale * np.exp(1j * angle)
    z = turn * (align.UPRIGHT @ np.array([1, 1j])) + x + 1j * y
    return np.column_stack([z.real, z.imag]), (turn, x + 1j * y)


def test_the_fit_is_that_of_least_squares():
    for scale, angle, x, y in ((1.0, 0.0, 0, 0), (0.3, 0.7, 40, -9), (2.5, -2.9, 1e3, 5)):
        points, turn = landmarks(scale, angle, x, y)
        assert np.allclose(align.fitted(align.UPRIGHT, points), turn) and np.allclose(align.fitted(points, align.UPRIGHT), align.inverse(turn))
    points = align.UPRIGHT + 9 * RNG.standard_normal((5, 2))
    # rows of the real system: x' = re x - im y + dx, y' = im x + re y + dy
    left = np.concatenate([np.column_stack([align.UPRIGHT[:, 0], -align.UPRIGHT[:, 1], np.ones(5), np.zeros(5)]), np.column_stack([align.UPRIGHT[:, 1], align.UPRIGHT[:, 0], np.zeros(5), np.ones(5)])])
    re, im, dx, dy = np.linalg.lstsq(left, points.T.ravel(), rcond=None)[0]
    assert np.allclose(align.fitted(align.UPRIGHT, points), (re + 1j * im, dx + 1j * dy))
    assert align.fitted(np.ones((5, 2)), points) is None and align.fitted(points, np.ones((5, 2))) is None and align.fitted(points * np.nan, points) is None


def test_there_and_back():
    image = scene()
    points, _ = landmarks(0.4, 0.4, 120, 20)
    turn = align.fitted(points, align.UPRIGHT)
    face = align.warped(image, turn, align.SIDE, align.SIDE)
    back = align.pasted(image, face, align.inverse(turn))
    mask = align.warped(align.feather(align.SIDE, align.SIDE), align.inverse(turn), *image.shape[:2])
    assert 0.1 < (mask == 0).mean() < 0.9 and (back[mask == 0] == image[mask == 0]).all()
    error = ((back - image)[mask > 0] ** 2).mean()
    assert 10 * np.log10(255**2 / error) > 40
    grey = align.pasted(image[..., 0], face[..., 0], align.inverse(turn))
    assert np.allclose(grey, back[..., 0])


def test_a_warp_is_that_of_plain_sampling():
    image = RNG.integers(0, 256, (7, 9)).astype(float)
    turn = (0.8 + 0.3j, 1.5 - 0.7j)
    got = align.warped(image, turn, 8, 10, 2 + 1j)
    for y in range(8):
        for x in range(10):
            z = (x + 2 + 1j * (y + 1) - turn[1]) / turn[0]
            left, above = int(np.floor(z.real)), int(np.floor(z.imag))
            want = 0.0
            for i in (0, 1):
                for j in (0, 1):
                    if 0 <= above + i < 7 and 0 <= left + j < 9:
                        want += image[above + i, left + j] * (1 - abs(z.imag - above - i)) * (1 - abs(z.real - left - j))
            assert got[y, x] == pytest.approx(want)


def test_enhancers():
    image = scene()
    near, _ = landmarks(0.3, 0.1, 30, 40)
    far, _ = landmarks(0.3, 0.1, 5000, 5000)
    bright = lambda face: np.clip(face + 80, 0, 255)
    whole, half, none = (align.enhanced(image, [near], bright, s) for s in (1.0, 0.5, 0.0))
    assert (none == image).all() and np.allclose(half - image, (whole - image) / 2) and (whole - image).max() > 60
    assert (align.enhanced(image, [far], bright) == image).all()

    def broken(face):
        raise RuntimeError("no model")

    for bad in (broken, lambda face: face[:10], lambda face: face * np.nan):
        assert (align.enhanced(image, [near, np.ones((5, 2))], bad) == image).all()
    both = align.enhanced(image, [near, far, np.ones((5, 2))], bright)
    assert np.allclose(both, whole)


def test_stored_faces_lie_over_enhanced_ones(spark):
    image = np.clip(scene(120, 160), 0, 255).astype(np.uint8)
    chosen = settings.resolve(flags={"aggressive.content_aware": False, "aggressive.face_quality": 100, "aggressive.restore_grain": False})
    stored = (100, 20, 140, 60, 0.9)
    packed = photos.compress_photos(spark.createDataFrame([("a.png", png.encode(image))], "path string, content binary"), chosen, lambda i: [stored])
    missed, _ = landmarks(0.1, 0.0, 10, 30)
    seen, _ = landmarks(0.1, 0.0, 95, 15)
    enhancer = photos.Enhancer(lambda i: [missed, seen], lambda face: face * 0)
    plain, better = (photos.load(bytes(photos.restore_photos(packed, chosen, enhancer=e).first()["content"])).image.astype(int) for e in (None, enhancer))
    assert np.abs(better - plain)[45:65, 25:45].mean() > 60
    assert (better[30:50, 110:130] == image[30:50, 110:130]).all() and (better[:, :5] == plain[:, :5]).all()


def test_the_fit_as_columns(spark):
    rows = [([(1.0, 1.0)] * 3, [(0.0, 0.0)] * 3), ([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)], [(5.0, 5.0), (5.0, 7.0), (3.0, 5.0)]), (None, None)]
    df = spark.createDataFrame(rows, "p array<struct<x:double,y:double>>, q array<struct<x:double,y:double>>").coalesce(1)
    got = [r["t"] for r in df.select(align.fit_column(F.col("p"), F.col("q")).alias("t")).collect()]
    assert got[0] is None and got[2] is None and tuple(got[1]) == pytest.approx((0.0, 2.0, 5.0, 5.0))
