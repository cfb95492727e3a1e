"""A small cascade against plain loops over every window, planted patterns at three sizes, and files that can't be read."""

from __future__ import annotations

import numpy as np
import pytest

from emulsia import detectors, errors
from emulsia.functions import cascade as C
from emulsia.functions import pixels, png

XML = """<?xml version="1.0"?><opencv_storage><cascade type_id="opencv-cascade-classifier"><stageType>BOOST</stageType><featureType>HAAR</featureType>
<height>12</height><width>12</width><stageNum>2</stageNum>
<stages><_><maxWeakCount>1</maxWeakCount><stageThreshold>0.5</stageThreshold><weakClassifiers><_><internalNodes>0 -1 0 0.9</internalNodes><leafValues>0. 1.</leafValues></_></weakClassifiers></_>
<_><maxWeakCount>2</maxWeakCount><stageThreshold>1.5</stageThreshold><weakClassifiers>
<_><internalNodes>0 1 1 -0.12 -1 -2 1 0.12</internalNodes><leafValues>0. 1. 0.</leafValues></_>
<_><internalNodes>0 1 2 -0.12 -1 -2 2 0.12</internalNodes><leafValues>0. 1. 0.</leafValues></_></weakClassifiers></_></stages>
<features><_><rects><_>0 0 12 12 -1.</_><_>3 3 6 6 4.</_></rects><tilted>0</tilted></_>
<_><rects><_>0 0 12 12 -1.</_><_>0 0 6 12 2.</_></rects><tilted>0</tilted></_>
<_><rects><_>0 0 12 12 -1.</_><_>0 0 12 6 2.</_></rects><tilted>0</tilted></_></features></cascade></opencv_storage>"""


def scene(places, shape=(90, 120), seed=4):
    image = 30 + 4 * np.random.default_rng(seed).standard_normal(shape)
    for x, y, side in places:  # a bright square in the middle of a dark one
        image[y : y + side, x : x + side] = 20
        q = side // 4
        image[y + q : y + side - q, x + q : x + side - q] = 200
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def plain_windows(cascade, gray, least=0):
    out, factor = [], 1.0
    while True:
        size = round(gray.shape[0] / factor), round(gray.shape[1] / factor)
        if size[0] < 12 or size[1] < 12:
            return sorted(out)
        side = round(12 * factor)
        small = gray if factor == 1 else np.clip(np.rint(pixels.resized(gray.astype(float), *size)), 0, 255).astype(np.uint8)
        for y in range(0, size[0] - 11, 1 if factor > 2 else 2):
            for x in range(0, size[1] - 11, 1 if factor > 2 else 2):
                window = small[y : y + 12, x : x + 12].astype(float)
                inner = window[1:11, 1:11]
                norm = np.sqrt(100 * (inner**2).sum() - inner.sum() ** 2) or 1.0
                value = [sum(w * window[b : b + h, a : a + v].sum() for a, b, v, h, w in f) / norm for f in cascade.features]
                ok = value[0] >= 0.9
                for v in value[1:]:
                    ok = ok and -0.12 <= v < 0.12
                if ok and side >= least:
                    out.append((round(x * factor), round(y * factor), side, side))
        factor *= 1.1


def test_windows_are_those_of_plain_loops():
    cascade = C.read(XML)
    for places in ([(10, 12, 12), (50, 20, 24)], [(40, 10, 48)], []):
        gray = scene(places, (72, 96))
        got = sorted(tuple(b) for b in C.windows(cascade, gray).tolist())
        assert got == plain_windows(cascade, gray) and bool(got) == bool(places)
    assert C.windows(cascade, np.zeros((11, 40), np.uint8)).shape == (0, 4) and len(C.windows(cascade, np.full((40, 40), 9, np.uint8))) == 0


def test_patterns_of_three_sizes_are_found_once_each():
    places = [(8, 10, 24), (60, 8, 36), (20, 60, 60)]
    found = C.faces(C.read(XML), scene(places, (140, 130)), least=16)
    assert len(found) == 3
    for x, y, side in places:
        near = [b for b in found if abs((b[0] + b[2]) / 2 - x - side / 2) < side / 6 and abs((b[1] + b[3]) / 2 - y - side / 2) < side / 6]
        assert len(near) == 1 and 0.7 * side < near[0][2] - near[0][0] < 1.4 * side
    assert C.faces(C.read(XML), scene([], (140, 130)), least=16) == []


def test_grouping():
    near = np.array([[10, 10, 20, 20]] * 4 + [[11, 10, 20, 21]] * 3 + [[80, 80, 20, 20]] * 2)
    assert C.grouped(near, 5) == [(10, 10, 20, 20)] and C.grouped(near, 1) == [(10, 10, 20, 20), (80, 80, 20, 20)]
    chain = np.array([[10 + 2 * k, 10, 20, 20] for k in range(9)])  # alike through others
    assert C.grouped(chain, 8) == [(18, 10, 20, 20)]
    inner = np.array([[0, 0, 60, 60]] * 9 + [[20, 20, 10, 10]] * 6)
    assert C.grouped(inner, 5) == [(0, 0, 60, 60)] and C.grouped(inner[:0]) == [] and len(C.grouped(inner, 0)) == 15


def test_a_cascade_in_a_job(spark, tmp_path, monkeypatch):
    path = tmp_path / "c.xml"
    path.write_text(XML)
    image = png.encode(scene([(20, 16, 48)], (90, 120)))
    files = spark.createDataFrame([("a.png", image), ("b.png", b"junk")], "path string, content binary")
    rows = {r["path"]: r for r in detectors.detect(files, "haar", cascade=str(path)).collect()}
    assert len(rows["a.png"]["faces"]) == 1 and rows["a.png"]["faces"][0]["confidence"] == 1.0 and abs(rows["a.png"]["faces"][0]["x1"] - 20) < 8
    assert rows["b.png"]["faces"] == [] and rows["b.png"]["error"]
    monkeypatch.setenv("EMULSIA_HAAR_CASCADE", str(path))
    assert len(detectors.create_detector("haar")(image)) == 1
    monkeypatch.setenv("EMULSIA_HAAR_CASCADE", str(tmp_path / "gone"))
    with pytest.raises(errors.DetectorError):
        detectors.create_detector("haar")


def test_files_that_are_no_cascade_are_errors():
    for bad in ("", "<a/>", XML.replace("HAAR", "LBP"), XML.replace("<tilted>0", "<tilted>1"), XML.replace("0 -1 0 0.9", "0 -1 7 0.9"), XML.replace("3 3 6 6 4.", "3 3 16 6 4."), XML.replace("0 1 1 -0.12", "0 5 1 -0.12"), XML.replace("0. 1. 0.", "0."), XML.replace("<width>12", "<width>x")):
        with pytest.raises(errors.DetectorError):
            C.read(bad)
