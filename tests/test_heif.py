"""HEIF files built box by box: items, turns, EXIF, profiles, gain maps, and damage."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from emulsia import codecs, errors, photos
from emulsia.functions import exif, heif, jpeg
from emulsia.functions.heif import Heif, Item, box, write

from .test_media import located

GAIN = ("auxC", bytes(4) + b"urn:com:apple:photo:2020:aux:hdrgainmap\0")


def shown(width, height):
    return "ispe", struct.pack(">III", 0, width, height)


def whole(gain: bytes = b"gain", pixels: bytes = b"pixels"):
    return [
        (Item(5, "hvc1", [], [shown(64, 48), ("irot", b"\x03"), ("colr", b"nclx" + bytes(7)), ("colr", b"prof" + b"a profile")]), pixels),
        (Item(2, "Exif", [], [], {"cdsc": [5]}), struct.pack(">I", 6) + exif.EXIF_NAME + located("<")),
        (Item(7, "hvc1", [], [shown(64, 48), ("auxC", bytes(4) + b"urn:mpeg:hevc:2015:auxid:1\0")], {"auxl": [5]}), b"mask"),
        (Item(9, "hvc1", [], [shown(32, 24), GAIN, ("imir", b"\x01")], {"auxl": [5]}), gain),
        (Item(11, "hvc1", [], [shown(8, 6)], {"thmb": [5]}), b"small"),
    ]


def test_items_come_back():
    h = Heif(write(whole()))
    first = h.items[h.primary]
    assert h.primary == 5 and list(h.items) == [5, 2, 7, 9, 11] and first.size == (64, 48) and first.quarters == 3 and first.mirror is None and first.profile == b"a profile"
    assert h.bytes_of(5) == b"pixels" and h.exif() == exif.EXIF_NAME + located("<") and exif.read_orientation(h.exif()) == 6
    gain = h.gain_map()
    assert gain.id == 9 and gain.size == (32, 24) and gain.mirror == "horizontal" and h.bytes_of(9) == b"gain"
    alone = Heif(h.picture(9))
    assert len(alone.items) == 1 and alone.bytes_of(alone.primary) == b"gain" and alone.items[alone.primary].auxiliary == gain.auxiliary
    many = [(Item(1, "hvc1", [], [shown(k, 1) for k in range(140)]), b"x")]  # numbers of properties over 127 take two bytes
    assert Heif(write(many)).items[1].properties == many[0][0].properties


def test_a_grid_keeps_its_tiles():
    tiles = [(Item(k, "hvc1", [], [shown(32, 32)]), b"tile %d" % k) for k in (3, 4)]
    grid = (Item(8, "grid", [], [shown(64, 32)], {"dimg": [3, 4]}), b"\0\0\0\1\0\x40\0\x20")
    h = Heif(write([grid, *tiles, (Item(6, "hvc1"), b"other")]))
    alone = Heif(h.picture(8))
    assert len(alone.items) == 3 and [alone.bytes_of(i) for i in alone.items[1].refers["dimg"]] == [b"tile 3", b"tile 4"]


def test_wide_boxes_and_data_inside_the_items():
    """Sizes of 64 bits, 32-bit ids, several parts, offsets from a base, and data in the box of the items."""
    infe = box("infe", struct.pack(">IH", 70000, 0), b"hvc1\0", version=3)
    iloc = box("iloc", b"\x44\x40", struct.pack(">IIHHIH", 1, 70000, 1, 0, 2, 2) + struct.pack(">IIII", 0, 3, 4, 2), version=2)
    ref = box("iref", box("cdsc", struct.pack(">IHI", 70000, 1, 5)), version=1)
    parts = [box("hdlr", bytes(4), b"pict", bytes(13), version=0), box("pitm", struct.pack(">I", 70000), version=1), box("iinf", struct.pack(">I", 1), infe, version=1), iloc, ref, box("idat", b"..abcdef..")]
    body = bytes(4) + b"".join(parts)
    wide = struct.pack(">I", 1) + b"meta" + struct.pack(">Q", 16 + len(body)) + body
    h = Heif(box("ftyp", b"mif1", bytes(4), b"heic") + wide + struct.pack(">I", 0) + b"mdat" + b"to the end")
    assert h.primary == 70000 and h.bytes_of(70000) == b"abc" + b"ef" and h.items[70000].refers == {"cdsc": [5]} and h.exif() is None and h.gain_map() is None


def test_damage_is_an_error_and_null_in_a_table(spark):
    data = write(whole())
    for end in range(0, len(data) - 1, 3):
        facts = heif.facts(data[:end])
        assert facts is None or end > data.index(b"mdat")
    for at in range(len(data)):
        heif.facts(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :])  # never anything but facts or null
    for bad in (b"", b"junk", data.replace(b"ftypheic", b"ftypxxxx").replace(b"mif1heic", b"yyyyzzzz"), data.replace(b"meta", b"free"), data.replace(b"pitm", b"skip")):
        with pytest.raises(errors.InputError):
            Heif(bad)
    rows = spark.createDataFrame([(1, data), (2, data[:90]), (3, None)], "k int, f binary").coalesce(1).select("k", heif.heif_facts("f").alias("x")).select("k", "x.width", "x.items", "x.gain_bytes", "x.exif").collect()
    assert [tuple(r)[:4] for r in rows] == [(1, 64, 5, 4), (2, None, None, None), (3, None, None, None)] and bytes(rows[0]["exif"]) == exif.EXIF_NAME + located("<")


def test_photos_from_heif_by_a_plug_in():
    """A decoder that turns its pixels, as those of HEIF do; here the coded bytes are JPEG."""
    image, gain = np.zeros((48, 64, 3), np.uint8), np.full((24, 32), 90, np.uint8)
    image[:, 32:] = 200
    data = write(whole(jpeg.encode(gain, 95), jpeg.encode(image, 95)))
    with pytest.raises(errors.InputError, match="heif"):
        photos.load(data)

    def decode(file):
        h = Heif(file)
        item = h.items[h.primary]
        return np.rot90(jpeg.decode(h.bytes_of(h.primary)), item.quarters)

    codecs.register(codecs.Codec("heif", None, decode, heif.owns))
    try:
        photo = photos.load(data, strip_place=True)
        assert photo.image.shape == (64, 48, 3) and photo.icc == b"a profile" and photo.orientation == 6
        assert exif.read_orientation(photo.exif) == 1 and not exif.has_place(photo.exif) and (photo.gain == 90).all()
        broken = photos.load(write(whole(b"no picture", jpeg.encode(image, 95))))
        assert broken.gain is None and broken.image.shape == (64, 48, 3)
    finally:
        codecs.unregister("heif")
