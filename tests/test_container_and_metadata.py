from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import functions as F

from emulsia.functions import metadata as M
from emulsia.sources import container as C

FACES = [{"id": 0, "bbox": [0, 0, 4, 4], "padded_bbox": [0, 0, 6, 6], "confidence": 0.9}, {"id": 1, "bbox": [5, 5, 5, 9], "padded_bbox": [5, 5, 6, 9], "confidence": 0.8}]


def test_container_round_trip_and_audit(spark):
    whole = (C.manifest_text("a.jpg", 10, 10, FACES[:1]), {"background.avif": b"b", "faces/000.png": b"f"})
    bad = (C.manifest_text("b.jpg", 10, 10, FACES), {"faces/000.jpg": b"f"})
    plans = spark.createDataFrame([("a.zip", *whole), ("b.zip", *bad)], "path string, manifest string, members map<string,binary>")
    packed = C.pack_containers(plans)
    files = packed.select("path", "content").unionAll(spark.createDataFrame([("c.zip", b"no archive"), ("d.zip", None)], "path string, content binary"))
    read = C.read_containers(files)
    rows = {r["path"]: r for r in read.select("path", "manifest.version", "manifest.faces", C.member(F.col("members"), "background", "background").alias("bg"), "error").collect()}
    assert rows["a.zip"]["version"] == C.VERSION and bytes(rows["a.zip"]["bg"]) == b"b" and len(rows["b.zip"]["faces"]) == 2
    assert rows["c.zip"]["error"].startswith("unreadable") and rows["d.zip"]["error"].startswith("unreadable")
    audit = {r["path"]: (r["ok"], r["problems"]) for r in C.audit(read).collect()}
    assert audit["a.zip"] == (True, [])
    assert audit["b.zip"] == (False, ["missing background", "face 1: malformed bbox", "face 1: missing crop"])
    assert not audit["c.zip"][0]
    assert all(r["size"] == len(r["content"]) for r in packed.collect())


def test_read_folder(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(C.pack(C.manifest_text("a.jpg", 1, 1, []), {}))
    (tmp_path / "b.txt").write_text("x")
    assert [r["manifest"]["original"]["filename"] for r in C.read_folder(spark, str(tmp_path)).collect()] == ["a.jpg"]


def test_gain_map_parameters(spark):
    good = '<x hdrgm:Version="1.0" hdrgm:GainMapMax="3/2" hdrgm:Gamma="1.0"><hdrgm:GainMapMin><rdf:Seq><rdf:li>0.1</rdf:li><rdf:li>0.2</rdf:li><rdf:li>0.3</rdf:li></rdf:Seq></hdrgm:GainMapMin></x>'
    cases = [(good,), (good.replace('Gamma="1.0"', 'Gamma="0"'),), ("<x/>",), (good.replace("3/2", "3/0"),), (None,)]
    first, *others = [r["p"] for r in spark.createDataFrame(cases, "x string").select(M.gain_map_parameters(F.col("x")).alias("p")).collect()]
    assert first["GainMapMax"] == [1.5] and first["GainMapMin"] == [0.1, 0.2, 0.3] and first["OffsetSDR"] == [1 / 64]
    assert others == [None] * 4


def test_gain_applies_by_channel(spark):
    xmp = '<x hdrgm:Version="1.0" hdrgm:GainMapMax="2" hdrgm:OffsetSDR="0" hdrgm:OffsetHDR="0"/>'
    row = spark.createDataFrame([(xmp, [0.5], [1.0])], "x string, b array<double>, g array<double>").select(M.apply_gain(F.col("b"), F.col("g"), F.lit(1.0), M.gain_map_parameters(F.col("x")), 0).alias("v")).first()
    assert row["v"] == [2.0]


def test_picture_index(spark):
    def block(order, pictures):
        body = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0xB002, 7, 16 * len(pictures), 8 + 2 + 12 + 4) + struct.pack(order + "I", 0)
        entries = b"".join(struct.pack(order + "IIIHH", 0, size, offset, 0, 0) for size, offset in pictures)
        return (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(order + "I", 8) + body + entries

    two = [(100, 0), (50, 200)]
    rows = spark.createDataFrame([(block("<", two),), (block(">", two),), (block("<", two[:1]),)], "m binary").select(M.picture_index(F.col("m")).alias("i")).collect()
    assert [[tuple(e) for e in r["i"]] for r in rows] == [two, two, []]


def test_app1(spark):
    data = bytes(spark.range(1).select(M.app1(F.lit("<x/>"))).first()[0])
    assert data[:2] == b"\xff\xe1" and struct.unpack(">H", data[2:4])[0] == len(data) - 2 and data.endswith(b"\x00<x/>")


def test_archives_are_unpacked_and_packed_in_slices():
    data = C.pack(C.manifest_text("a.jpg", 4, 4, []), {"background.jpg": bytes(1 << 20)})
    rows = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(20)]), pa.array([data, b"junk"] * 10)], names=["path", "content"])
    batches = list(C._unpacked(iter([rows, rows.slice(0, 0)])))
    assert len(batches) == 2 and all(b.nbytes < 10 << 20 for b in batches)
    table = pa.Table.from_batches(batches)
    assert table["path"].to_pylist() == [str(k) for k in range(20)] and [e is None for e in table["error"].to_pylist()] == [True, False] * 10
    plans = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(600)]), pa.array(["{}"] * 600), pa.array([[]] * 600, pa.map_(pa.string(), pa.binary()))], names=["path", "manifest", "members"])
    packed = list(C._packed(iter([plans])))
    assert [b.num_rows for b in packed] == [256, 256, 88] and pa.Table.from_batches(packed)["path"].to_pylist() == [str(k) for k in range(600)]
