"""Facts of clips from the JSON that a prober prints, and scores of frames from a scorer's JSON, under declared schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound
from .video import frame_rate

STREAM = "struct<codec_type:string,codec_name:string,pix_fmt:string,bits_per_raw_sample:string,width:string,height:string,avg_frame_rate:string,r_frame_rate:string,bit_rate:string,color_primaries:string,color_transfer:string,color_space:string,side_data_list:array<map<string,string>>>"
PROBE = f"streams array<{STREAM}>, format struct<size:string,duration:string,bit_rate:string,tags:map<string,string>>"
FRAMES = "frames array<struct<metrics:struct<vmaf:double>>>"
#: Fixed value: the tag that pairs a clip with its photo.
PAIR_TAG = "com.apple.quicktime.content.identifier"


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0))


def clip_facts(text: Column) -> Column:
    """A struct of the facts of a clip; null for a file without a video stream and for what isn't JSON.

    A number that is absent or odd is 0; a missing depth is told from the pixel format; the profile of dynamic metadata
    counts only where the metadata is in the stream.
    """
    of = lambda p, kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    return bound(F.from_json(text, PROBE), lambda p: bound(of(p, "video"), lambda v: _facts(v, of(p, "audio"), p["format"])))


def _facts(v: Column, audio: Column, form: Column) -> Column:
    """The facts of a clip from its streams and its format."""
    sides = F.coalesce(v["side_data_list"], F.array().cast("array<map<string,string>>"))
    last = lambda found: F.try_element_at(found, F.lit(-1))
    turns = F.filter(F.transform(sides, lambda s: F.try_element_at(s, F.lit("rotation")).try_cast("double").cast("int")), lambda x: x.isNotNull())
    profiles = F.transform(F.filter(sides, lambda s: F.map_contains_key(s, "dv_profile") & (_whole(F.try_element_at(s, F.lit("rpu_present_flag"))) != 0)), lambda s: _whole(F.try_element_at(s, F.lit("dv_profile"))))
    depth = F.when(_whole(v["bits_per_raw_sample"]) > 0, _whole(v["bits_per_raw_sample"])).when(F.contains(v["pix_fmt"], F.lit("12")), 12).when(F.contains(v["pix_fmt"], F.lit("10")), 10).otherwise(8)
    tags = F.filter(F.map_entries(F.coalesce(form["tags"], F.create_map().cast("map<string,string>"))), lambda e: F.lower(e["key"]) == PAIR_TAG)
    rate = F.when(_whole(v["bit_rate"]) > 0, _whole(v["bit_rate"])).otherwise(_whole(form["bit_rate"]))
    facts = F.struct(
        _whole(form["size"]).alias("size"), F.coalesce(form["duration"].try_cast("double"), F.lit(0.0)).alias("duration"), _whole(v["width"]).alias("width"), _whole(v["height"]).alias("height"),
        frame_rate(v["avg_frame_rate"], v["r_frame_rate"]).alias("fps"), F.coalesce(v["codec_name"], F.lit("")).alias("codec"), F.coalesce(v["pix_fmt"], F.lit("")).alias("pix_fmt"), depth.cast("int").alias("bit_depth"), rate.alias("bit_rate"),
        v["color_primaries"].alias("color_primaries"), v["color_transfer"].alias("color_transfer"), v["color_space"].alias("color_space"), F.coalesce(last(turns), F.lit(0)).alias("rotation"),
        audio["codec_name"].alias("audio_codec"), last(profiles).cast("int").alias("dynamic_profile"), F.get(tags, F.lit(0))["value"].alias("pair_id"),
    )
    return F.when(v.isNotNull(), facts)


def frame_scores(text: Column) -> Column:
    """The score of each frame in order; null where there are none."""
    scores = F.transform(F.from_json(text, FRAMES)["frames"], lambda f: f["metrics"]["vmaf"])
    return F.when(F.size(scores) > 0, scores)
