"""Gain-map parameters from XMP, and binary segments, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parameters of a gain map and their defaults.
GAIN_DEFAULTS = {"GainMapMin": 0.0, "GainMapMax": 1.0, "Gamma": 1.0, "OffsetSDR": 1 / 64, "OffsetHDR": 1 / 64, "HDRCapacityMin": 0.0, "HDRCapacityMax": 1.0}
#: The TIFF tag of the entries of a multi-picture index, and the bytes of an entry.
MP_ENTRY_TAG, MP_ENTRY_BYTES = 0xB002, 16


def number(text: Column) -> Column:
    """A decimal or a rational a/b; null if it is neither or b is 0."""
    halves = F.split(F.trim(text), "/")
    part = lambda i: F.get(halves, F.lit(i)).try_cast("double")
    return F.when(F.size(halves) == 2, F.try_divide(part(0), part(1))).when(F.size(halves) == 1, part(0))


def gain_map_parameters(xmp: Column) -> Column:
    """A struct of arrays with one value or three, defaults where absent; null without a marker, or with a bad number or gamma."""

    def values(name: str) -> Column:
        attribute = F.regexp_extract(xmp, rf'hdrgm:{name}="([^"]*)"', 1)
        block = F.regexp_extract(xmp, rf"(?s)<hdrgm:{name}>(.*?)</hdrgm:{name}>", 1)
        listed = F.transform(F.regexp_extract_all(block, F.lit(r"<rdf:li[^>]*>([^<]*)</rdf:li>"), F.lit(1)), number)
        one = F.when(attribute != "", F.array(number(attribute)))
        return F.coalesce(one, F.when(F.size(listed) > 0, listed), F.array(F.lit(GAIN_DEFAULTS[name])))

    fields = {n: values(n) for n in GAIN_DEFAULTS}
    whole = [F.forall(v, lambda x: x.isNotNull()) & F.size(v).isin(1, 3) for v in fields.values()]
    ok = F.contains(xmp, F.lit("hdrgm:")) & F.forall(fields["Gamma"], lambda g: g > 0)
    for w in whole:
        ok = ok & w
    return F.when(ok, F.struct(*[v.alias(n) for n, v in fields.items()], (F.lower(F.regexp_extract(xmp, r'hdrgm:BaseRenditionIsHDR="([^"]*)"', 1)) == "true").alias("base_is_hdr")))


def per_channel(values: Column) -> Column:
    """One value for all of blue, green and red, or red, green and blue reversed."""
    return F.when(F.size(values) == 3, F.reverse(values)).otherwise(F.array_repeat(F.get(values, F.lit(0)), 3))


def apply_gain(base: Column, gain: Column, headroom: Column, p: Column, channel: int) -> Column:
    """Linear light after a gain map with parameters p, one channel of an array of pixels."""
    at = lambda n: F.get(per_channel(p[n]), F.lit(channel))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (headroom - F.get(p["HDRCapacityMin"], F.lit(0))) / (F.get(p["HDRCapacityMax"], F.lit(0)) - F.get(p["HDRCapacityMin"], F.lit(0)))))
    log_gain = lambda g: at("GainMapMin") + (at("GainMapMax") - at("GainMapMin")) * F.pow(g, 1 / at("Gamma"))
    return F.zip_with(base, gain, lambda b, g: (b + at("OffsetSDR")) * F.pow(F.lit(2.0), log_gain(g) * weight) - at("OffsetHDR"))


def be(data: Column, start: Column | int, n: int, little: Column | None = None) -> Column:
    """An unsigned number of n bytes of binary data from start (0-based), big-endian unless `little`."""
    at = (F.lit(start) if isinstance(start, int) else start) + 1
    digits = F.hex(F.substring(data, at, F.lit(n)))
    big = F.conv(digits, 16, 10).cast("long")
    if little is None:
        return big
    turned = F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), "")
    return F.when(little, F.conv(turned, 16, 10).cast("long")).otherwise(big)


def picture_index(mp: Column) -> Column:
    """(size, offset) of the pictures of a multi-picture block that starts at its byte-order mark; empty below two."""
    little = F.hex(F.substring(mp, 1, 2)) == "4949"
    ifd = be(mp, 4, 4, little)
    entries = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), be(mp, ifd, 2, little) - 1)), lambda i: ifd + 2 + 12 * i)
    index = F.get(F.filter(entries, lambda e: be(mp, e, 2, little) == MP_ENTRY_TAG), F.lit(0))
    count, first = F.expr("0") + be(mp, index + 4, 4, little), be(mp, index + 8, 4, little)
    rows = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor(count / MP_ENTRY_BYTES) - 1)), lambda i: F.struct(be(mp, first + 16 * i + 4, 4, little).alias("size"), be(mp, first + 16 * i + 8, 4, little).alias("offset")))
    none = F.array().cast("array<struct<size:bigint,offset:bigint>>")
    return F.when(index.isNotNull() & (count >= 2 * MP_ENTRY_BYTES), rows).otherwise(none)


def app1(packet: Column) -> Column:
    """An XMP packet as a JPEG segment: marker, length and name; an error above 64 KiB."""
    body = F.concat(F.lit("http://ns.adobe.com/xap/1.0/").cast("binary"), F.unhex(F.lit("00")), packet.cast("binary"))
    size = F.octet_length(body) + 2
    return F.when(size <= 0xFFFF, F.concat(F.unhex(F.lit("FFE1")), F.unhex(F.lpad(F.hex(size.cast("long")), 4, "0")), body)).otherwise(F.raise_error(F.lit("the XMP packet doesn't fit one segment")))


#: The namespaces of the packets.
RDF = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'
HDRGM = 'xmlns:hdrgm="http://ns.adobe.com/hdr-gain-map/1.0/" hdrgm:Version="1.0"'
DIRECTORY = 'xmlns:Container="http://ns.google.com/photos/1.0/container/" xmlns:Item="http://ns.google.com/photos/1.0/container/item/"'


def _packet(attributes: Column, children: Column) -> Column:
    head = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF {RDF}><rdf:Description rdf:about="" '
    return F.concat(F.lit(head), attributes, F.lit(">"), children, F.lit("</rdf:Description></rdf:RDF></x:xmpmeta>"))


def gain_packet(p: Column) -> Column:
    """The XMP packet of a gain map with parameters as gain_map_parameters reads them: one value as an attribute, three
    as a list; what it writes, that reads."""
    attributes, lists = [F.lit(HDRGM)], [F.lit("")]
    for name in GAIN_DEFAULTS:
        values = F.transform(p[name], lambda v: v.cast("double").cast("string"))
        attributes.append(F.when(F.size(values) == 1, F.concat(F.lit(f' hdrgm:{name}="'), F.get(values, F.lit(0)), F.lit('"'))).otherwise(""))
        items = F.array_join(F.transform(values, lambda v: F.concat(F.lit("<rdf:li>"), v, F.lit("</rdf:li>"))), "")
        lists.append(F.when(F.size(values) > 1, F.concat(F.lit(f"<hdrgm:{name}><rdf:Seq>"), items, F.lit(f"</rdf:Seq></hdrgm:{name}>"))).otherwise(""))
    attributes.append(F.when(p["base_is_hdr"], ' hdrgm:BaseRenditionIsHDR="True"').otherwise(' hdrgm:BaseRenditionIsHDR="False"'))
    return _packet(F.concat(*attributes), F.concat(*lists))


def headroom_parameters(headroom: Column) -> Column:
    """The parameters that make a gain map mean light times 2 to the headroom times its value."""
    value = {"GainMapMin": F.lit(0.0), "GainMapMax": headroom, "Gamma": F.lit(1.0), "OffsetSDR": F.lit(0.0), "OffsetHDR": F.lit(0.0), "HDRCapacityMin": F.lit(0.0), "HDRCapacityMax": headroom}
    return F.struct(*[F.array(value[n].cast("double")).alias(n) for n in GAIN_DEFAULTS], F.lit(False).alias("base_is_hdr"))


def directory_packet(gain_bytes: Column) -> Column:
    """The XMP packet of a first picture that says how many bytes of gain map follow it."""
    item = lambda role, rest: F.concat(F.lit(f'<rdf:li rdf:parseType="Resource"><Container:Item Item:Semantic="{role}" Item:Mime="image/jpeg"'), rest, F.lit("/></rdf:li>"))
    length = F.concat(F.lit(' Item:Length="'), gain_bytes.cast("string"), F.lit('"'))
    items = F.concat(F.lit("<Container:Directory><rdf:Seq>"), item("Primary", F.lit("")), item("GainMap", length), F.lit("</rdf:Seq></Container:Directory>"))
    return _packet(F.lit(f"{DIRECTORY} {HDRGM}"), items)


def le(value: Column | int, n: int) -> Column:
    """An unsigned number as n bytes, the least first."""
    digits = F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 2 * n, "0")
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1))), ""))


def picture_block(first_bytes: Column, mark: Column, gain_bytes: Column) -> Column:
    """The multi-picture block of a first picture of first_bytes bytes and a gain map behind it; offsets count from the
    block's byte-order mark, which is at `mark` in the file."""
    entry = lambda tag, kind, count, value: F.concat(le(tag, 2), le(kind, 2), le(count, 4), value)
    data = 8 + 2 + 3 * 12 + 4
    directory = F.concat(le(3, 2), entry(0xB000, 7, 4, F.lit("0100").cast("binary")), entry(0xB001, 4, 1, le(2, 4)), entry(MP_ENTRY_TAG, 7, 2 * MP_ENTRY_BYTES, le(data, 4)), le(0, 4))
    picture = lambda flags, size, offset: F.concat(le(flags, 4), le(size, 4), le(offset, 4), le(0, 4))
    return F.concat(F.lit("II").cast("binary"), le(42, 2), le(8, 4), directory, picture(0x030000, first_bytes, F.lit(0)), picture(0, gain_bytes, first_bytes - mark))


def app2(block: Column) -> Column:
    """A multi-picture block as a JPEG segment."""
    body = F.concat(F.lit("MPF").cast("binary"), F.unhex(F.lit("00")), block)
    return F.concat(F.unhex(F.lit("FFE2")), F.unhex(F.lpad(F.hex((F.octet_length(body) + 2).cast("long")), 4, "0")), body)
