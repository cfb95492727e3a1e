"""Rules about clips: what to skip, names, models, targets, and codec and mode decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Clips at or below this many bits per pixel and frame are left alone; the face target of the gate.
EFFICIENT_BITS, FACE_TARGET = 0.05, 95.0
FOUR_K_SIDE = 1800


def frame_rate(average: Column, real: Column) -> Column:
    """num/den of the average rate, else of the real one; rates that aren't positive are skipped, 0 without any."""

    def rate(text: Column) -> Column:
        halves = F.split(text, "/")
        value = F.try_divide(F.get(halves, F.lit(0)).try_cast("double"), F.coalesce(F.get(halves, F.lit(1)).try_cast("double"), F.lit(1.0)))
        return F.when(value > 0, value)

    return F.coalesce(rate(average), rate(real), F.lit(0.0))


def bits_per_pixel(bit_rate: Column, width: Column, height: Column, fps: Column) -> Column:
    return F.coalesce(F.try_divide(bit_rate.cast("double"), width * height * fps), F.lit(0.0))


def skip_reason(codec: Column, bits: Column) -> Column:
    """Why a clip isn't encoded again, null if it is; 0 bits are unknown and skip nothing."""
    return F.when(codec == "av1", "already av1").when((bits > 0) & (bits <= EFFICIENT_BITS), "already efficient")


def output_path(path: Column, folder: Column) -> Column:
    """`.mp4` in the folder, `_av1` before it where that is the input itself."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")
    plain = F.concat(folder, F.lit("/"), stem, F.lit(".mp4"))
    return F.when(plain == path, F.concat(folder, F.lit("/"), stem, F.lit("_av1.mp4"))).otherwise(plain)


def vmaf_model(width: Column, height: Column) -> Column:
    return F.when(F.least(width, height) >= FOUR_K_SIDE, "vmaf_4k").otherwise("vmaf")


def targets(gate: Column, tune: Column, faces: Column) -> tuple[Column, Column]:
    """(gate, tune) with a face: both at least FACE_TARGET, but a gate that is off (null) stays off."""
    raised = lambda t: F.when(faces > 0, F.greatest(t, F.lit(FACE_TARGET))).otherwise(t)
    return F.when(gate.isNotNull(), raised(gate)), raised(F.coalesce(tune, gate, F.lit(93.0)))


def keep_original(encoded: Column, original: Column, lossless: Column) -> Column:
    """An encoding that isn't smaller is dropped, except a lossless one."""
    return ~lossless & (encoded >= original)
