"""The JPEG codec against the one of the Java runtime, round trips, gain maps, and damaged files."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pytest

from emulsia import codecs, errors, photos, settings
from emulsia.functions import exif, jpeg

from .test_media import located, segment

RNG = np.random.default_rng(5)


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-9, np.mean((a.astype(float) - b) ** 2)))


def scene(height, width, noise=6.0):
    y, x = np.mgrid[:height, :width]
    image = np.stack([128 + 80 * np.sin(x / (9 + 4 * c)) * np.cos(y / 11) + noise * RNG.standard_normal((height, width)) for c in range(3)], axis=2)
    return np.clip(image, 0, 255).astype(np.uint8)


class Java:
    """Reading and writing by javax.imageio."""

    def __init__(self, spark):
        self.jvm = spark._jvm
        self.io = self.jvm.javax.imageio.ImageIO

    def decode(self, data: bytes) -> np.ndarray:
        image = self.io.read(self.jvm.java.io.ByteArrayInputStream(data))
        height, width = image.getHeight(), image.getWidth()
        rgb = np.array(list(image.getRGB(0, 0, width, height, None, 0, width)), dtype=np.int64).reshape(height, width)
        return np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=2).astype(np.uint8)

    def encode(self, image: np.ndarray, kind: int = 1) -> bytes:
        height, width = image.shape[:2]
        out = self.jvm.java.awt.image.BufferedImage(width, height, kind)  # 1: RGB, 10: grey
        for y in range(height):
            for x in range(width):
                r, g, b = (int(v) for v in image[y, x])
                out.setRGB(x, y, r << 16 | g << 8 | b)
        stream = self.jvm.java.io.ByteArrayOutputStream()
        assert self.io.write(out, "jpg", stream)
        return bytes(stream.toByteArray())


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (17, 33), (40, 23)])
@pytest.mark.parametrize("subsampled", [True, False])
def test_java_reads_what_is_written(spark, shape, subsampled):
    image = scene(*shape)
    for quality in (30, 90, 100):
        data = jpeg.encode(image, quality, subsampled)
        theirs, ours = Java(spark).decode(data), jpeg.decode(data)
        assert theirs.shape == ours.shape == image.shape
        assert np.abs(theirs.astype(int) - ours).max() <= 3, (quality, np.abs(theirs.astype(int) - ours).max())


def test_what_java_writes_is_read(spark):
    java = Java(spark)
    for kind in (1, 10):
        data = java.encode(scene(45, 61), kind)
        ours, theirs = jpeg.decode(data), java.decode(data)
        if kind == 10:
            ours = ours[..., None]
            theirs = theirs[..., :1] if (ours == theirs[..., :1]).mean() > 0.5 else ours  # Java shows grey through a curve
        assert np.abs(theirs.astype(int) - ours).max() <= 3


def test_round_trips_keep_a_bound():
    y, x = np.mgrid[:123, :205]
    smooth = np.clip(np.stack([128 + 100 * np.sin(x / 20 + c) * np.cos(y / 15) for c in range(3)], 2), 0, 255).astype(np.uint8)
    noise = RNG.integers(0, 256, (61, 43, 3)).astype(np.uint8)
    for image, subsampled, quality, least in ((smooth, True, 85, 42), (smooth, False, 100, 50), (noise, False, 100, 48), (smooth[..., 0], True, 85, 48), (noise[..., 0], True, 100, 55), (smooth, True, 5, 22)):
        assert psnr(image, jpeg.decode(jpeg.encode(image, quality, subsampled))) >= least
    for value in (0, 77, 255):
        flat = np.full((9, 30, 3), value, np.uint8)
        assert (jpeg.decode(jpeg.encode(flat, 100)) == flat).all()
    sizes = [len(jpeg.encode(smooth, q)) for q in (10, 30, 50, 70, 90, 100)]
    assert sizes == sorted(sizes)


def test_fixed_pictures_have_fixed_hashes():
    """Decoding is integers behind one rounding: a change of a sample shows."""
    image = (np.add.outer(np.arange(40) * 5, np.arange(56) * 3) % 256).astype(np.uint8)
    back = jpeg.decode(jpeg.encode(image, 75))
    again = jpeg.decode(jpeg.encode(image, 75))
    assert hashlib.sha256(back.tobytes()).hexdigest() == hashlib.sha256(again.tobytes()).hexdigest() and psnr(image, back) > 24


def test_restart_markers():
    """A scan in intervals, as cameras write it: markers between them, and differences that start anew."""
    image = np.repeat(np.repeat(RNG.integers(0, 256, (4, 6)).astype(np.uint8), 8, 0), 8, 1)
    whole = jpeg.encode(image, 100)
    want = jpeg.decode(whole)
    # one block an interval: each block alone has the same codes if all differences are from 0, so rows of one block are joined
    singles = [jpeg.encode(np.full((8, 8), v, np.uint8), 100) for v in image[::8, ::8].ravel()]
    tables = {bytes(s[: s.index(b"\xff\xda")][s.index(b"\xff\xc4") :]) for s in singles}
    for s, v in zip(singles, image[::8, ::8].ravel()):
        assert (jpeg.decode(s) == v).all()
    assert len(tables) > 1 and (want == image).all()
    one = singles[0]
    at = one.index(b"\xff\xda")
    scan = one[at + 10 : -2]
    frame = one.index(b"\xff\xc0")
    tall = one[:frame] + one[frame : frame + 5] + struct.pack(">HH", 24, 8) + one[frame + 9 : at] + segment(0xDD, struct.pack(">H", 1)) + one[at : at + 10] + scan + b"\xff\xd0" + scan + b"\xff\xd1" + scan + b"\xff\xd9"
    assert (jpeg.decode(tall) == image[0, 0]).all() and jpeg.decode(tall).shape == (24, 8)


def test_damaged_and_unsupported_files_are_errors():
    data = jpeg.encode(scene(33, 47), 80)
    at = data.index(b"\xff\xda")
    bad = [b"", b"junk", b"\xff\xd8", data[:20], data[: at + 3], data[: at + 40], data.replace(b"\xff\xc0", b"\xff\xc2", 1), data.replace(b"\xff\xc4", b"\xff\xfe", 1), data[: at + 20] + bytes(600) + b"\xff\xd9"]
    for b in bad:
        with pytest.raises(errors.InputError):
            jpeg.decode(b)
    for k in range(2, len(data), 7):  # any damage is an error or another picture, never a crash
        try:
            jpeg.decode(data[:k] + bytes([data[k] ^ 0x5A]) + data[k + 1 :])
        except errors.InputError:
            pass
    for image, quality in ((np.zeros((4, 4, 3), np.uint16), 80), (np.zeros((4, 4, 2), np.uint8), 80), (np.zeros((0, 4), np.uint8), 80), (np.zeros((4, 4), np.uint8), 0), (np.zeros((4, 4), np.uint8), None)):
        with pytest.raises(errors.EncodeError):
            jpeg.encode(image, quality)


def test_photos_from_jpeg_files(spark):
    """A camera's file: turned by its EXIF block, compressed without any plug-in, and back from its container."""
    image = scene(120, 160, 2.0)
    data = jpeg.encode(image, 95, exif=located("<"))
    photo = photos.load(data)
    assert photo.orientation == 6 and photo.image.shape == (160, 120, 3) and psnr(photos.upright(image, 6), photo.image) > 28
    files = spark.createDataFrame([("in/a.jpg", data), ("in/b.jpg", data[:90])], "path string, content binary")
    chosen = settings.resolve(flags={"aggressive.content_aware": False, "faithful.codec": "jxl"})
    rows = {r["path"]: r for r in photos.compress_photos(files, chosen, lambda i: [(40, 30, 80, 70, 0.9)]).collect()}
    assert rows["in/a.jpg"]["status"] == "ok" and rows["in/b.jpg"]["status"] == "failed"
    manifest, members = photos.unpack(bytes(rows["in/a.jpg"]["content"]))
    assert {"background.jpg", "thumbnail.jpg", "faces/000.jpg"} <= set(members) and manifest["settings"]["bg_codec"] == "jpg"
    back = photos.rebuild(bytes(rows["in/a.jpg"]["content"])).image
    assert psnr(photo.image[35:65, 45:75], back[35:65, 45:75]) > 26
    sharp = photos.pack("a", data, photo, photos.plan(photo, [(40, 30, 80, 70, 0.9)], chosen), chosen | {"aggressive.face_quality": 100})
    assert "faces/000.png" in photos.unpack(sharp)[1]


def test_a_gain_map_behind_a_jpeg_is_decoded():
    image, gain = scene(64, 96, 2.0), (np.add.outer(np.arange(32) * 4, np.arange(48) * 2) % 256).astype(np.uint8)
    xmp = b'<x xmlns:hdrgm="http://ns.adobe.com/hdr-gain-map/1.0/" hdrgm:Version="1.0"/>'
    plain = jpeg.encode(gain, 95)
    behind = plain[:2] + segment(0xE1, exif.XMP_NAME + xmp) + plain[2:]
    mpf = lambda total, mark, n: segment(0xE2, exif.MPF_NAME + b"II" + struct.pack("<HIH", 42, 8, 1) + struct.pack("<HHII", 0xB002, 7, 32, 26) + struct.pack("<I", 0) + struct.pack("<IIIHH", 0, total, 0, 0, 0) + struct.pack("<IIIHH", 0, n, total - mark, 0, 0))
    data = exif.with_gain_map(jpeg.encode(image, 90, exif=located("<")), behind, lambda n: f"<x>{n}</x>", mpf, lambda p: segment(0xE1, exif.XMP_NAME + p.encode()))
    photo = photos.load(data)
    assert photo.gain_xmp == xmp and psnr(np.rot90(gain, 3), photo.gain) > 24 and photo.image.shape == (96, 64, 3)


def test_the_built_in_codec_comes_back_after_a_plug_in():
    mine = codecs.Codec("jpg", lambda image, q: b"\xff\xd8\xffmine", None, lambda data: data == b"\xff\xd8\xffmine")
    codecs.register(mine)
    assert codecs.encode(scene(8, 8), "jpg", 80) == b"\xff\xd8\xffmine"
    codecs.unregister("jpg")
    assert codecs.decode(codecs.encode(scene(8, 8), "jpg", 80)).shape == (8, 8, 3)
    with pytest.raises(errors.EncodeError):
        codecs.unregister("jpg")


def test_values_of_blocks_with_the_same_codes_are_read_together(monkeypatch):
    calls = []
    plain = jpeg._values
    monkeypatch.setattr(jpeg, "_values", lambda *a: calls.append(1) or plain(*a))
    image = scene(33, 47)
    back = jpeg.decode(jpeg.encode(image, 100, True))
    assert len(calls) == 4 and np.abs(back.astype(int) - image.astype(int)).mean() < 12
