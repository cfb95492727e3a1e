from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsia import detectors, settings
from emulsia.functions import restore as R
from emulsia.sources.ledger import fingerprint


def test_layers():
    s = settings.resolve({"aggressive.bg_scale": 0.5, "unknown": 1}, {"aggressive.face_quality": 80}, "ratio")
    assert (s["aggressive.bg_scale"], s["aggressive.face_quality"], s["aggressive.bg_codec"], s["aggressive.bg_quality"]) == (0.5, 80, "jxl", 85)
    assert settings.resolve(flags={"faithful.quality": 50})["faithful.auto_tune"] is False
    assert settings.resolve(preset="share")["strip_gps"] is True
    assert settings.detector_of(settings.resolve())["backend"] == "haar" and settings.detector_of(settings.resolve(preset="family"))["backend"] == "yunet"
    assert settings.restore_overrides("pretty", {"aggressive.face_enhance_strength"}) == {"aggressive.face_enhance_fidelity": 0.5} and settings.restore_overrides("?", set()) == {}


@pytest.mark.parametrize("flags", [{"mode": "x"}, {"faithful.quality": 101}, {"detector.backend": "none"}, {"aggressive.region_scale": 0.0}, {"nope": 1}])
def test_bad_settings_raise(flags):
    with pytest.raises(settings.SettingsError):
        settings.resolve(flags=flags)


def test_settings_fingerprint_follows_what_it_covers(spark):
    a, b = settings.resolve(), settings.resolve(flags={"faithful.speed": 7})
    row = spark.range(1).select(*[fingerprint(settings.as_struct(s, p)).alias(f"{n}{p}") for n, s in (("a", a), ("b", b)) for p in ("faithful.", "video.")]).first()
    assert row[0] != row[2] and row[1] == row[3]


def test_registry_and_isolation(spark):
    def factory(**_):
        def run(data):
            if data == b"bad":
                raise OSError("unreadable")
            return [(0, 0, 100, 100, 0.9), (2, 2, 100, 100, 0.8), (300, 300, 420, 400, 0.7), (0, 0, 5, 5, 1.0)]

        return run

    detectors.register_detector("plain", factory)
    try:
        for name, f in (("plain", factory), ("haar", factory), ("", factory), ("other", None)):
            with pytest.raises(detectors.DetectorError):
                detectors.register_detector(name, f)
        files = spark.createDataFrame([("a", b"ok"), ("b", b"bad")], "path string, content binary")
        found = detectors.detect(files, "plain")
        assert {r["path"]: r["error"] for r in found.collect()} == {"a": None, "b": "OSError: unreadable"}
        kept = {r["path"]: [tuple(f)[:4] for f in r["faces"]] for r in detectors.post_filter(found, 1000, 800).collect()}
        assert kept == {"a": [(0, 0, 100, 100), (300, 300, 420, 400)], "b": []}
    finally:
        detectors.unregister_detector("plain")
    with pytest.raises(detectors.DetectorError):
        detectors.create_detector("plain")


def test_restore_arithmetic(spark):
    rng = np.random.default_rng(0)
    x = rng.random((32, 32))
    assert np.allclose(R.gaussian(np.ones((9, 9)), 2.0), 1)
    assert abs(R.grain((64, 64), 3.0).std() - 3.0) < 1e-9 and (R.grain((8, 8), 1.0) == R.grain((8, 8), 1.0)).all()
    small = R.shrink(x, 4)
    start = R.enlarge(small, 4)
    errors = [np.abs(R.shrink(R.back_projected(start, small, 4, n), 4) - small).max() for n in (0, 3, 12)]
    assert errors[0] > errors[1] > errors[2]
    flat = R.anchored(np.zeros((32, 32)), np.ones((8, 8)), 0.25)
    assert np.allclose(flat, 1)
    out = R.composite(np.zeros((8, 8)), [((0, 0, 4, 4), np.ones((4, 4)), np.ones((4, 4))), ((2, 2, 6, 6), np.full((4, 4), 2.0), np.full((4, 4), 0.5))])
    assert out[0, 0] == 1 and out[3, 3] == 1.5 and out[5, 5] == 1 and out[7, 7] == 0
    row = spark.createDataFrame([([1.0, 1.0], [0.0, 4.0], [0.25, 0.5])], "f array<double>, b array<double>, m array<double>").select(R.blended(F.col("f"), F.col("b"), F.col("m")).alias("x")).first()
    assert row["x"] == [0.25, 2.5]


def test_poisson_blending_keeps_differences_and_the_border():
    rng = np.random.default_rng(4)
    for shape in ((20, 24), (20, 24, 3)):
        background, box = rng.random(shape) * 50, (3, 4, 15, 16)
        patch = background[4:16, 3:15] + 40
        assert np.allclose(R.poisson(background, box, patch), background)
        patch = rng.random(patch.shape) * 50
        out = R.poisson(background, box, patch)
        inside = out[4:16, 3:15]
        assert np.allclose(inside[0], background[4, 3:15]) and np.allclose(out[:4], background[:4])
        lap = lambda x: 4 * x[1:-1, 1:-1] - x[:-2, 1:-1] - x[2:, 1:-1] - x[1:-1, :-2] - x[1:-1, 2:]
        mixed = inside.copy()
        assert np.allclose(lap(mixed)[1:-1, 1:-1], lap(patch)[1:-1, 1:-1])
    assert (R.poisson(np.zeros((4, 4)), (0, 0, 2, 2), np.ones((2, 2)))[:2, :2] == 1).all()
