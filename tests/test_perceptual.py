"""SSIMULACRA 2 against a version that walks over pixels, its order over distortions, and the search that it guides."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsia import codecs, errors, photos, settings
from emulsia.functions import jpeg, perceptual, png

RNG = np.random.default_rng(8)


def scene(height, width, noise=6.0):
    y, x = np.mgrid[:height, :width]
    image = np.stack([128 + 80 * np.sin(x / (9 + 4 * c)) * np.cos(y / 11) + noise * RNG.standard_normal((height, width)) for c in range(3)], axis=2)
    return np.clip(image, 0, 255).astype(np.uint8)


def plain_score(a, b):
    """Pixel by pixel, with a full table of the taps in two dimensions."""
    taps = perceptual.kernel()
    half = len(taps) // 2

    def eotf(v):
        v = v / 255
        return v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4

    def planes(light):
        out = np.zeros((3, len(light), len(light[0])))
        for y, row in enumerate(light):
            for x, rgb in enumerate(row):
                cone = [max(0.0, sum(m * v for m, v in zip(line, rgb)) + perceptual.BIAS) ** (1 / 3) - perceptual.BIAS ** (1 / 3) for line in perceptual.ABSORBED]
                bright = (cone[0] + cone[1]) / 2
                out[:, y, x] = 7 * (cone[0] - cone[1]) + 0.42, bright + 0.01, cone[2] - bright + 0.55
        return out

    def blur(plane):
        out = np.zeros_like(plane)
        for y in range(plane.shape[0]):
            for x in range(plane.shape[1]):
                for i in range(-half, half + 1):
                    for j in range(-half, half + 1):
                        if 0 <= y + i < plane.shape[0] and 0 <= x + j < plane.shape[1]:
                            out[y, x] += taps[half + i] * taps[half + j] * plane[y + i, x + j]
        return out

    def half_size(light):
        h, w = len(light), len(light[0])
        at = lambda y, x: np.array(light[min(y, h - 1)][min(x, w - 1)])
        return [[(at(2 * y, 2 * x) + at(2 * y, 2 * x + 1) + at(2 * y + 1, 2 * x) + at(2 * y + 1, 2 * x + 1)) / 4 for x in range((w + 1) // 2)] for y in range((h + 1) // 2)]

    lights = [[[[eotf(int(v)) for v in px] for px in row] for row in image] for image in (a, b)]
    total, weights = 0.0, perceptual.WEIGHTS.ravel()
    for scale in range(6):
        if scale and min(len(lights[0]), len(lights[0][0])) < 8:
            break
        p, q = map(planes, lights)
        for c in range(3):
            m1, m2, s11, s22, s12 = blur(p[c]), blur(q[c]), blur(p[c] ** 2), blur(q[c] ** 2), blur(p[c] * q[c])
            d = np.maximum(1 - (1 - (m1 - m2) ** 2) * (2 * (s12 - m1 * m2) + 0.0009) / (s11 - m1 * m1 + s22 - m2 * m2 + 0.0009), 0)
            e = (1 + abs(q[c] - m2)) / (1 + abs(p[c] - m1)) - 1
            for n, norm in enumerate((lambda v: v.mean(), lambda v: (v**4).mean() ** 0.25)):
                for k, v in enumerate((d, np.maximum(e, 0), np.maximum(-e, 0))):
                    total += weights[c * 36 + scale * 6 + n * 3 + k] * norm(v)
        lights = [half_size(x) for x in lights]
    total *= 0.9562382616834844
    total = 2.326765642916932 * total - 0.020884521182843837 * total**2 + 6.248496625763138e-05 * total**3
    return 100 - 10 * total**0.6276336467831387 if total > 0 else 100.0


@pytest.mark.parametrize("shape", [(17, 19), (8, 33), (5, 6)])
def test_against_a_walk_over_pixels(shape):
    a = scene(*shape)
    for b in (np.clip(a.astype(int) + RNG.integers(-9, 10, a.shape), 0, 255).astype(np.uint8), a // 32 * 32):
        assert perceptual.score(a, b) == pytest.approx(plain_score(a, b), abs=1e-8)


def test_the_kernel_has_the_area_and_the_variance_of_its_gaussian():
    for sigma in (1.5, 2.0, 3.7):
        taps = perceptual.kernel(sigma)
        n = np.arange(len(taps)) - len(taps) // 2
        assert taps.sum() == pytest.approx(1) and (taps * n**2).sum() == pytest.approx(sigma**2) and taps[0] == pytest.approx(0, abs=1e-12)
        assert np.abs(taps - np.exp(-(n**2) / (2 * sigma**2)) / (sigma * np.sqrt(2 * np.pi))).max() < 0.01


def test_equal_pictures_have_100_and_more_distortion_has_less():
    image = scene(96, 130)
    assert perceptual.score(image, image) == perceptual.score(image[..., 0], image[..., 0]) == 100.0
    by_quality = [perceptual.score(image, jpeg.decode(jpeg.encode(image, q))) for q in (5, 20, 40, 60, 80, 95)]
    assert by_quality == sorted(by_quality) and by_quality[-1] > 80 > 50 > by_quality[0]
    by_noise = [perceptual.score(image, np.clip(image + s * RNG.standard_normal(image.shape), 0, 255).astype(np.uint8)) for s in (1, 3, 9, 27)]
    assert by_noise == sorted(by_noise, reverse=True)
    deep = image.astype(np.uint16) * 257
    assert perceptual.score(deep, deep) == 100.0 and perceptual.score(image, deep) == pytest.approx(100.0, abs=1e-3)
    for bad in ((image, image[:50]), (image[:0], image[:0])):
        with pytest.raises(errors.InputError):
            perceptual.score(*bad)


def test_rasters_without_a_score_are_null(spark):
    rows = [([1] * 64, [1] * 64), ([1] * 64, [1] * 63), (None, [1] * 64), ([], []), ([9] * 10, [9] * 10)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").coalesce(1)
    assert [r[0] for r in df.select(perceptual.raster_score("a", "b", F.lit(8))).collect()] == [100.0, None, None, None, None]


def test_the_quality_is_the_least_that_keeps_the_faces(spark):
    image = scene(80, 100, 3.0)
    box = (20, 16, 70, 60)
    part = image[box[1] : box[3], box[0] : box[2]]
    base = settings.resolve(flags={"faithful.codec": "avif"})
    codecs.register(codecs.Codec("avif", lambda x, q: b"AV" + jpeg.encode(x, q, False), lambda d: jpeg.decode(d[2:]), lambda d: d[:2] == b"AV"))
    try:
        for metric, target in (("ssimulacra2", 90.0), ("ssimulacra2", 99.9), ("ssim", 0.95), ("ssimulacra2", -1000.0)):
            chosen = base | {"faithful.target_metric": metric, "faithful.target_value": target}
            q = photos.tuned(image, [box, (25, 20, 30, 30)], "avif", chosen)
            kept = lambda q, m=metric: photos.METRICS[m](part, jpeg.decode(jpeg.encode(part, q, False)))
            if target in (90.0, 0.95):
                assert kept(q) >= target and (q == 39 or kept(q - 1) < target) and q <= 95
            else:
                assert q == (95 if target > 0 else 39)  # the search ends one below its range
        assert photos.tuned(image, [], "avif", base) == base["faithful.quality"]
        files = spark.createDataFrame([("a.png", png.encode(image))], "path string, content binary")
        face = lambda i: [(30, 24, 60, 50, 0.9)]
        sizes = [photos.compress_faithful(files, base | {"faithful.target_value": t}, face).first()["compressed_size"] for t in (50.0, 90.0, 94.0)]
        assert sizes == sorted(sizes) and sizes[0] < sizes[2]
    finally:
        codecs.unregister("avif")
