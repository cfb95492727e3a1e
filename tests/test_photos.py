"""PNG, codecs, programs outside, and photos from file to container and back."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emulsia import codecs, errors, photos, settings, tools
from emulsia.functions import exif, pixels, png, restore
from emulsia.plans import catalogue
from emulsia.sources import container

from .test_media import located

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
@pytest.mark.parametrize("shape", [(5, 7), (9, 4, 3), (1, 1, 4), (6, 6, 2)])
def test_png_round_trip(dtype, shape):
    x = RNG.integers(0, np.iinfo(dtype).max, shape).astype(dtype)
    data = png.encode(x, located("<"), b"a profile")
    assert (png.decode(data) == x).all() and png.decode(data).dtype == dtype and png.extras(data) == (located("<"), b"a profile")


def filtered(rows: np.ndarray, step: int) -> bytes:
    """Rows under all five filters, one after the other."""
    out, above = [], np.zeros(rows.shape[1], dtype=int)
    for i, row in enumerate(rows.astype(int)):
        left, corner = (np.concatenate([np.zeros(step, dtype=int), x[:-step]]) for x in (row, above))
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, near][i % 5]
        out.append(bytes([i % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        above = row
    return b"".join(out)


def test_png_filters_and_palettes():
    x = RNG.integers(0, 256, (11, 6, 3)).astype(np.uint8)
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    whole = lambda head, *parts: png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", *head, 0, 0, 0)) + b"".join(parts) + part(b"IEND", b"")
    assert (png.decode(whole((6, 11, 8, 2), part(b"IDAT", zlib.compress(filtered(x.reshape(11, 18), 3))))) == x).all()
    places = RNG.integers(0, 4, (5, 5)).astype(np.uint8)
    colours = RNG.integers(0, 256, (4, 3)).astype(np.uint8)
    indexed = whole((5, 5, 8, 3), part(b"PLTE", colours.tobytes()), part(b"IDAT", zlib.compress(filtered(places, 1))))
    assert (png.decode(indexed) == colours[places]).all()
    good = png.encode(x)
    for bad in (b"", good[:-20], good.replace(b"IDAT", b"JDAT"), good[:50] + b"\0" + good[51:], whole((6, 11, 4, 2))):
        with pytest.raises(errors.InputError):
            png.decode(bad)
    with pytest.raises(errors.EncodeError):
        png.encode(x.astype(float))


def test_codecs_and_checks():
    x = RNG.integers(0, 256, (40, 30, 3)).astype(np.uint8)
    assert codecs.available("png") and not codecs.available("avif") and codecs.checked(codecs.encode(x, "png", None), x, thorough=True) == 1.0
    for call in (lambda: codecs.encode(x, "avif", 50), lambda: codecs.checked(b"junk", x), lambda: codecs.checked(png.encode(x[:20]), x), lambda: codecs.checked(png.encode(255 - x), x, True), lambda: codecs.register(codecs.Codec("gif", None, None, None)), lambda: codecs.unregister("png")):
        with pytest.raises(errors.EncodeError):
            call()
    coarse = codecs.Codec("avif", lambda image, q: b"AV" + png.encode(image // 16 * 16), lambda data: png.decode(data[2:]), lambda data: data.startswith(b"AV"))
    codecs.register(coarse)
    try:
        name, data, _ = photos.encoded(photos.Photo(x), ["jxl", "avif", "png"], 50)
        assert name == "avif" and 0.9 < codecs.similarity(x, codecs.decode(data)) < 1
    finally:
        codecs.unregister("avif")


def test_photos_are_turned_upright():
    x = np.arange(24, dtype=np.uint8).reshape(4, 6)
    for turn in range(1, 9):
        block = exif.EXIF_NAME + located("<").replace(struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0), struct.pack("<HHIHH", 0x0112, 3, 1, turn, 0))
        photo = photos.load(png.encode(x, block), strip_place=True)
        assert photo.orientation == turn and photo.image.shape == ((4, 6, 3) if turn < 5 else (6, 4, 3)) and exif.read_orientation(photo.exif) == 1 and not exif.has_place(photo.exif)
    corners = {turn: photos.upright(x, turn)[0, 0] for turn in range(1, 9)}
    # the pixel that an orientation says is at the top left
    assert corners == {1: 0, 2: 5, 3: 23, 4: 18, 5: 0, 6: 18, 7: 23, 8: 5}


def picture() -> np.ndarray:
    y, x = np.mgrid[0:120, 0:160]
    image = np.stack([x, y, (x + y) // 2], axis=2).astype(float)
    image[30:70, 40:80] += 40 * RNG.standard_normal((40, 40, 3))
    return np.clip(image, 0, 255).astype(np.uint8)


def face(image):
    return [(40, 30, 80, 70, 0.9)]


def test_container_of_a_photo_and_back(spark):
    image = picture()
    files = spark.createDataFrame([("in/a.png", png.encode(image, located("<"), b"icc")), ("in/b.png", b"junk"), ("in/c.png", None)], "path string, content binary").coalesce(1)
    chosen = settings.resolve(flags={"aggressive.content_aware": False, "aggressive.face_quality": 100})
    packed = photos.compress_photos(files, chosen, face)
    rows = {r["path"]: r for r in packed.collect()}
    assert rows["in/a.png"]["status"] == "ok" and rows["in/a.png"]["faces"] == 1 and rows["in/b.png"]["status"] == rows["in/c.png"]["status"] == "failed"
    done = packed.filter("status = 'ok'")
    assert [r["ok"] for r in container.audit(container.read_containers(done)).collect()] == [True]
    (back,) = photos.restore_photos(done).collect()
    got = photos.load(bytes(back["content"]))
    turned = photos.upright(image, 6)
    assert got.image.shape == turned.shape and got.icc == b"icc" and back["faces"] == 1
    manifest, _ = photos.unpack(bytes(rows["in/a.png"]["content"]))
    x1, y1, x2, y2 = manifest["faces"][0]["bbox"]
    assert (got.image[y1 + 4 : y2 - 4, x1 + 4 : x2 - 4] == turned[y1 + 4 : y2 - 4, x1 + 4 : x2 - 4]).mean() > 0.9
    assert np.abs(got.image.astype(int) - turned.astype(int)).mean() < 12


def test_residuals_models_and_strategies():
    image = picture()
    photo = photos.Photo(image)
    base = settings.resolve(flags={"aggressive.content_aware": False, "aggressive.restore_grain": False})
    error = lambda s, **k: np.abs(photos.rebuild(photos.pack("a.png", b"", photo, photos.plan(photo, [], s), s), settings=s, **k).image.astype(int) - image.astype(int)).mean()
    assert error(base | {"aggressive.residual": True, "aggressive.residual_scale": 1.0}) < error(base)
    drift = lambda small, h, w: photos.enlarged(small, h, w) + 30
    plain = error(base | {"aggressive.restore_anchor": False}, upscale=drift)
    assert error(base, upscale=drift) < 0.5 * plain and error(base | {"aggressive.restore_anchor": False, "aggressive.restore_backproject_iters": 6}, upscale=drift) < 0.5 * plain
    seam = base | {"aggressive.blend_mode": "poisson", "aggressive.face_quality": 100}
    whole = photos.rebuild(photos.pack("a.png", b"", photo, photos.plan(photo, face(image), seam), seam), settings=seam).image
    assert whole.shape == image.shape and np.abs(whole[40:60, 50:70].astype(int) - image[40:60, 50:70]).mean() < 12
    with pytest.raises(errors.SkipFile):
        photos.plan(photo, [], base | {"aggressive.no_face_strategy": "skip"})
    aware = settings.resolve(flags={"aggressive.conservative_bg_scale": 0.7})
    small = photos.plan(photo, [(10, 10, 13, 13, 0.9)], aware)
    assert small.scale == 0.7 and small.reason == "small face" and len(small.regions) == 1
    for bad in (b"junk", container.pack("{}", {}), container.pack("no json", {}), container.pack(container.manifest_text("a", 4, 4, [{"padded_bbox": [0, 0, 2, 2]}]), {"background.jxl": png.encode(image[:2, :2])})):
        with pytest.raises((errors.ContainerError, errors.RestoreError, KeyError)):
            photos.rebuild(bad)


def test_faithful_photos(spark):
    image = picture()
    loose = png.encode(image, level=0)
    files = spark.createDataFrame([("a.png", loose), ("b.png", b"junk")], "path string, content binary")
    rows = {r["path"]: r for r in photos.compress_faithful(files, settings.resolve(flags={"faithful.lossless": True, "faithful.verify_thorough": True})).collect()}
    assert rows["a.png"]["codec"] == "png" and rows["a.png"]["compressed_size"] < len(loose) and rows["a.png"]["similarity"] == 1.0 and rows["b.png"]["status"] == "failed"
    assert (photos.load(bytes(rows["a.png"]["content"])).image == image).all()
    (row,) = photos.compress_faithful(files.filter("path = 'a.png'"), settings.resolve()).collect()
    assert row["status"] == "failed" and "avif" in row["error"]


def test_programs_outside(monkeypatch, tmp_path):
    for name in ("ffmpeg", "ffprobe", "avifenc", "avifdec"):
        monkeypatch.delenv(f"EMULSIA_{name.upper()}", raising=False)
    monkeypatch.setenv("PATH", str(tmp_path))
    assert tools.find("avifdec") is None and not tools.clips_encodable() and not tools.clips_scorable() and not tools.keeps_dynamic_metadata()
    for name, text in (("ffmpeg", "#!/bin/sh\necho ' T.. libvmaf  x'; echo dolbyvision"), ("ffprobe", "#!/bin/sh\n")):
        (tmp_path / "own").mkdir(exist_ok=True)
        (tmp_path / "own" / name).write_text(text)
        (tmp_path / "own" / name).chmod(0o755)
    monkeypatch.setenv("PATH", "/bin:/usr/bin")
    monkeypatch.setenv("EMULSIA_FFMPEG", str(tmp_path / "own" / "ffmpeg"))
    assert tools.find("ffprobe") == str(tmp_path / "own" / "ffprobe") and tools.clips_scorable() and tools.keeps_dynamic_metadata()
    monkeypatch.setenv("EMULSIA_FFMPEG", str(tmp_path / "gone"))
    assert tools.find("ffmpeg") != str(tmp_path / "gone")


def test_weights(tmp_path):
    file = tmp_path / "w.bin"
    for make in (None, b"x" * 10, b"x" * 5000):
        if make is not None:
            file.write_bytes(make)
        if make is None or len(make) < 1024:
            with pytest.raises(errors.ModelError):
                tools.weights(str(file))
    assert tools.weights(str(file)) == file
    with pytest.raises(errors.ModelError):
        tools.weights(str(file), "00")


def test_sample_command(spark):
    rows = spark.createDataFrame([(0.0,), (2.5,)], "s double")
    got = [r["c"] for r in rows.coalesce(1).select(tools.sample_command(F.lit("a.mov"), F.lit("t.mp4"), F.col("s"), F.lit(3.0), F.lit(30), F.lit(6), F.lit(False)).alias("c")).collect()]
    assert "-ss" not in got[0] and got[1][got[1].index("-ss") + 1] == "2.500" and got[1][-1] == "t.mp4" and "-an" in got[1]


def test_bench_of_both_modes(spark, tmp_path):
    from emulsia.sources import sinks

    files = spark.createDataFrame([("a.png", png.encode(picture(), level=0)), ("b.png", b"junk")], "path string, content binary")
    rows = photos.bench(files, settings.resolve(flags={"faithful.lossless": True, "aggressive.content_aware": False}), face)
    sinks.save_baseline(rows, str(tmp_path / "baseline"))
    got = {(r["file"], r["mode"]): r for r in sinks.load_baseline(spark, str(tmp_path / "baseline")).collect()}
    assert len(got) == 4 and got["a.png", "faithful"]["ssim"] == 1.0 and 0.3 < got["a.png", "aggressive"]["ssim"] < 1 and min(got["a.png", m]["ratio"] for m in ("aggressive", "faithful")) > 1
    assert got["b.png", "aggressive"]["status"] == "failed" and got["b.png", "aggressive"]["ratio"] is None


def test_a_gain_map_is_turned_with_its_photo():
    from .test_media import jpeg, segment

    held = lambda x, *parts: jpeg(*parts).replace(b"scan", png.encode(x))
    codec = codecs.Codec("jpg", lambda image, q: held(image), lambda data: png.decode(data[data.index(png.SIGNATURE) :]), lambda data: data[:2] == b"\xff\xd8")
    image, gain = picture(), RNG.integers(0, 256, (60, 80)).astype(np.uint8)
    xmp = b'<x xmlns:hdrgm="http://ns.adobe.com/hdr-gain-map/1.0/" hdrgm:Version="1.0"/>'
    behind = held(gain, segment(0xE1, exif.XMP_NAME + xmp))
    mpf = lambda total, mark, n: segment(0xE2, exif.MPF_NAME + b"II" + struct.pack("<HIH", 42, 8, 1) + struct.pack("<HHII", 0xB002, 7, 32, 26) + struct.pack("<I", 0) + struct.pack("<IIIHH", 0, total, 0, 0, 0) + struct.pack("<IIIHH", 0, n, total - mark, 0, 0))
    data = exif.with_gain_map(held(image, segment(0xE1, exif.EXIF_NAME + located("<"))), behind, lambda n: f"<x>{n}</x>", mpf, lambda p: segment(0xE1, exif.XMP_NAME + p.encode()))
    codecs.register(codec)
    try:
        photo = photos.load(data)
        assert photo.image.shape == (160, 120, 3) and (photo.gain == np.rot90(gain, 3)).all() and photo.gain_xmp == xmp
        chosen = settings.resolve(flags={"aggressive.content_aware": False})
        packed = photos.pack("a.jpg", data, photo, photos.plan(photo, [], chosen), chosen)
        assert photos.unpack(packed)[0]["gain_map_preserved"] and (photos.rebuild(packed).gain == photo.gain).all()
    finally:
        codecs.unregister("jpg")


def test_each_photo_is_packed_once_whatever_its_key(spark, tmp_path):
    rows = [(k, [0.01 * (i % 40) for i in range(64)]) for k in (7, 7, 8, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = catalogue.QUERIES["photo_containers"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Join" not in plan
    assert sorted(tuple(r) for r in df.fillna(-1, ["vec_id"]).collect()) == [(k, True, 1, 32, 32, 0.25, 3072) for k in (-1, 7, 7, 8)]


def test_rows_are_handed_on_in_slices_with_what_goes_along(spark):
    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], names=["k"])
    slices = list(container.sliced(batch, (((f"{k}",), 1 << 20 if k < 16 else 1) for k in range(600)), ["name"], [pa.string()], ["k"]))
    assert [s.num_rows for s in slices] == [8, 8, 256, 256, 72]
    assert all(s["name"].to_pylist() == [f"{k}" for k in s["k"].to_pylist()] for s in slices) and sum((s["k"].to_pylist() for s in slices), []) == list(range(600))
    files = spark.createDataFrame([(f"{k}.png", png.encode(np.full((8, 8), k, dtype=np.uint8)) if k % 50 else b"junk", k) for k in range(200)], "path string, content binary, k int").coalesce(1)
    packed = photos.compress_photos(files, settings.resolve(flags={"aggressive.content_aware": False}), lambda image: [])
    read = container.read_containers(packed, ["status", "content"])
    assert read.columns == ["path", "manifest", "members", "error", "status", "content"]
    back = photos.restore_photos(container.audit(read, ["status", "content"]).withColumnRenamed("status", "before"), kept=["ok", "before"])
    got = {int(r["path"][:-4]): (r["status"], r["ok"], r["before"]) for r in back.collect()}
    assert got == {k: ("ok", True, "ok") if k % 50 else ("failed", False, "failed") for k in range(200)}


def test_photos_of_a_size_share_weights_and_noise(monkeypatch):
    made = []
    for owner, name in ((pixels, "_cubic_weights"), (pixels, "_area_weights"), (np.random, "default_rng")):
        plain = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *a, plain=plain, name=name: made.append((name, *a)) or plain(*a))
    pixels._kept_weights.cache_clear()
    restore._noise.cache_clear()
    chosen = settings.resolve(flags={"aggressive.content_aware": False})
    for k in range(4):
        photo = photos.Photo(np.clip(RNG.normal(128, 20, (36, 44, 3)), 0, 255).astype(np.uint8))
        photos.rebuild(photos.pack("a.png", b"", photo, photos.plan(photo, [(10, 8, 30, 28, 0.9)], chosen), chosen))
    assert len(made) == len(set(made)) and {"_cubic_weights", "_area_weights", "default_rng"} == {n for n, *_ in made}
