"""Byte-level metadata, probes, pictures and texts against plain versions."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsia import detectors, errors, settings
from emulsia.functions import exif, probe
from emulsia.functions import metadata as M
from emulsia.functions import pixels as P
from emulsia.operators import pooled, reports
from emulsia.sources import ledger


def block(order: str, entries: list[tuple[int, int, int, bytes]], tail: bytes = b"") -> bytes:
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    rows = b"".join(struct.pack(order + "HHI", *e[:3]) + e[3].ljust(4, b"\0") for e in entries)
    return head + struct.pack(order + "H", len(entries)) + rows + struct.pack(order + "I", 0) + tail


def located(order: str) -> bytes:
    at = 8 + 2 + 36 + 4
    gps = struct.pack(order + "HHHII", 1, 2, 5, 3, at + 18) + struct.pack(order + "I", 0) + struct.pack(order + "6I", 47, 1, 30, 1, 15, 1)
    entries = [(0x0110, 2, 4, b"cam\0"), (0x0112, 3, 1, struct.pack(order + "H", 6)), (0x8825, 4, 1, struct.pack(order + "I", at))]
    return block(order, entries, gps)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("name", [b"", exif.EXIF_NAME])
def test_exif_edits_in_place(order, name):
    data = name + located(order)
    assert exif.read_orientation(data) == 6 and exif.has_place(data)
    turned = exif.upright(data)
    assert exif.read_orientation(turned) == 1 and len(turned) == len(data) and sum(a != b for a, b in zip(data, turned)) == 1
    clean = exif.without_place(data)
    assert not exif.has_place(clean) and exif.read_orientation(clean) == 6 and b"cam" in clean and struct.pack(order + "II", 47, 1) not in clean
    assert exif.without_place(clean) == clean


@pytest.mark.parametrize("data", [None, b"", b"junk", b"II*\0", located("<")[:30], block("<", [])])
def test_odd_exif_stays(data):
    assert exif.read_orientation(data) == 1 and exif.upright(data) == data and exif.without_place(data) == data


def segment(marker: int, payload: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(payload) + 2) + payload


def jpeg(*parts: bytes) -> bytes:
    return b"\xff\xd8" + b"".join(parts) + b"\xff\xda\0\x02scan\xff\xd9"


def test_jpeg_with_a_gain_map(spark):
    params = M.headroom_parameters(F.lit(2.5))
    row = spark.range(1).select(M.app1(M.gain_packet(params)).alias("x")).first()
    gain = b"\xff\xd8" + bytes(row["x"]) + b"\xff\xda\0\x02map\xff\xd9"
    icc = [segment(0xE2, exif.ICC_NAME + bytes([i, 2]) + part) for i, part in ((2, b"file"), (1, b"pro"))]
    first = jpeg(segment(0xE0, b"JFIF\0"), segment(0xE1, exif.EXIF_NAME + located("<")), *icc)
    assert exif.app_ends(first)[0] == exif.app_ends(first)[1] < len(first)

    ask = lambda c: bytes(spark.range(1).select(c.alias("x")).first()["x"])
    whole = exif.with_gain_map(
        first, gain, lambda n: ask(M.directory_packet(F.lit(n)).cast("binary")).decode(),
        lambda total, mark, n: ask(M.app2(M.picture_block(F.lit(total).cast("long"), F.lit(mark).cast("long"), F.lit(n).cast("long")))),
        lambda packet: ask(M.app1(F.lit(packet))),
    )
    assert exif.pictures(whole) == [gain] and f'Item:Length="{len(gain)}"'.encode() in exif.xmp_of(whole)
    files = spark.createDataFrame([("a", whole), ("b", first), ("c", b"no"), ("d", None)], "name string, data binary")
    got = {r["name"]: r["m"] for r in files.select("name", exif.jpeg_metadata_udf("data").alias("m")).collect()}
    assert bytes(got["a"]["gain_map"]) == gain and got["a"]["orientation"] == 6 and bytes(got["a"]["icc"]) == b"profile"
    back = spark.createDataFrame([(got["a"]["gain_xmp"],)], "x string").select(M.gain_map_parameters(F.col("x")).alias("p")).first()["p"]
    assert back["GainMapMax"] == [2.5] and back["OffsetSDR"] == [0.0]
    assert got["b"]["gain_map"] is None and got["c"]["exif"] is None and got["d"]["orientation"] == 1
    # without the marker, a second picture is no gain map
    stereo = whole.replace(b"hdr-gain-map", b"xxx-xxxx-xxx")
    assert exif.gain_map_of(stereo) is None
    with pytest.raises(errors.InputError):
        exif.app_ends(b"PNG")


def test_probe_of_odd_texts(spark):
    rows = [("",), ("{}",), (None,), ('{"streams":[{"codec_type":"video","width":"x","avg_frame_rate":"1/0","r_frame_rate":"0/0"}]}',)]
    got = [r["f"] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(probe.clip_facts(F.col("t")).alias("f")).collect()]
    assert got[:3] == [None] * 3 and (got[3]["width"], got[3]["fps"], got[3]["bit_depth"], got[3]["size"], got[3]["pair_id"]) == (0, 0.0, 8, 0, None)
    scores = spark.createDataFrame([('{"frames":[{"metrics":{"vmaf":91.5}},{"metrics":{"vmaf":90}}]}',), ('{"frames":[]}',)], "t string").coalesce(1)
    assert [r["s"] for r in scores.select(probe.frame_scores(F.col("t")).alias("s")).collect()] == [[91.5, 90.0], None]


def test_order_statistics_with_ties(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([1.0, 2.0, 2.5, rng.random()])) for g in ("a", "b", None) for _ in range(700)] + [("c", 5.0)] * 900 + [("d", 1.0)]
    wanted = [(g, n) for g in ("a", "b", None, "c") for n in (1, 2, 350, 699, 700)] + [("d", 1)]
    got = pooled.ranked_values(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", spark.createDataFrame(wanted, "g string, nth long"))
    assert {(r["g"], r["nth"]): r["v"] for r in got.collect()} == {(g, n): sorted(v for h, v in rows if h == g)[n - 1] for g, n in wanted}


def test_mask_mass_is_the_sum_of_the_mask(spark):
    rows = spark.createDataFrame([(w, h) for w in (1, 5, 16, 17, 40) for h in (1, 9, 33)], "w int, h int")
    each = rows.select("w", "h", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x")).select("*", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    plain = {(r["w"], r["h"]): r["m"] for r in each.groupBy("w", "h").agg(F.sum(P.soft_mask(F.col("x"), F.col("y"), F.col("w"), F.col("h"), 8.0)).alias("m")).collect()}
    assert all(abs(plain[r["w"], r["h"]] - r["m"]) < 1e-9 for r in rows.select("w", "h", P.mask_mass(F.col("w"), F.col("h"), 8).alias("m")).collect())


def test_resizing_and_edges():
    rng = np.random.default_rng(0)
    x = rng.random((12, 8))
    assert P.resized(x, 12, 8) is x
    assert np.allclose(P.resized(x, 6, 4), x.reshape(6, 2, 4, 2).mean(axis=(1, 3)))
    assert np.allclose(P.resized(np.full((5, 5), 3.0), 11, 13), 3) and abs(P.resized(x, 5, 3).mean() - x.mean()) < 0.05
    board = np.zeros((64, 64))
    board[:, 32:] = 255
    edges = P.edge_map(board)
    assert edges.sum() == 64 and (edges.sum(axis=1) == 1).all() and abs(int(np.argmax(edges[0])) - 31.5) <= 1
    assert P.detail_ratio(np.full((32, 32), 90.0)) == 0 and P.detail_ratio(np.zeros((0, 5))) == 0 and P.edge_map(np.zeros((0, 5))) is None
    noise = 128 + 6 * rng.standard_normal((64, 64))
    assert P.detail_ratio(noise) < 0.01 < P.detail_ratio(board)


def test_settings_as_text(tmp_path):
    text = settings.default_text()
    assert settings.from_text(text) == settings.DEFAULTS and "# must be one of" in text
    path = tmp_path / "deep" / "settings.yaml"
    settings.save(settings.resolve(flags={"faithful.quality": 50}), str(path))
    read = settings.load(str(path))
    assert read["faithful.quality"] == 50 and settings.resolve(read)["faithful.auto_tune"] is False
    with pytest.raises(settings.SettingsError):
        settings.from_text("mode faithful")


def test_clip_fingerprint_follows_what_it_covers(spark):
    base = settings.resolve()
    variants = {"base": base, "photo": base | {"faithful.quality": 5}, "crf": base | {"video.crf": 20}, "found": base | {"detector.confidence": 0.9}, "shape": base | {"detector.padding": 2.0}, "blind": base | {"video.face_aware": False}, "blind found": base | {"video.face_aware": False, "detector.confidence": 0.9}}
    f = spark.range(1).select(*[ledger.fingerprint(settings.clip_struct(v)).alias(k) for k, v in variants.items()]).first()
    assert f["base"] == f["photo"] == f["shape"] and f["blind"] == f["blind found"] and len({f["base"], f["crf"], f["found"], f["blind"]}) == 4


def test_built_in_detectors_need_a_library():
    with pytest.raises(errors.EmulsiaError):
        detectors.create_detector("haar")
    detectors.provide("haar", lambda **_: lambda data: [(0, 0, 9, 9, 0.9)])
    try:
        assert detectors.create_detector("haar")(b"x") == [(0, 0, 9, 9, 0.9)] and detectors.known_backends().count("haar") == 1
    finally:
        detectors._plugins.pop("haar")


def test_a_refreshed_ledger_hits_by_stat(spark):
    files = spark.createDataFrame([("a", "h1", "f", 10, 5), ("b", "h2", "f", 20, 6), ("c", "h3", "f", 1, 1)], "path string, content_hash string, fingerprint string, size long, mtime long")
    old = spark.createDataFrame([("a", "h1", "f", None, None, "o"), ("b", "x", "f", 20, 1, "p")], "path string, content_hash string, fingerprint string, size long, mtime long, output_path string")
    new = ledger.refreshed(old, files)
    assert new.columns == old.columns and {r["path"]: (r["size"], r["mtime"], r["output_path"]) for r in new.collect()} == {"a": (10, 5, "o"), "b": (20, 1, "p")}
    assert [r["path"] for r in ledger.stat_hits(files, new).collect()] == ["a"]


def test_pictures_of_other_sizes_are_not_compared(spark):
    bad = spark.createDataFrame([([0.0, 1.0], [0.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="different sizes"):
        bad.select(reports.quality_report(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1), F.lit(1)).alias("r")).select("r.psnr").collect()
