"""Box arithmetic as column expressions. A box is struct<x1,y1,x2,y2:int> with half-open pixel corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
BOXES = f"array<{BOX}>"

#: Growth of a box downwards and to each side, in heights and widths of the tight box.
ROI_GROWTH = {"face": (0.0, 0.0), "head_shoulders": (1.2, 0.3), "person": (4.0, 0.6)}
#: The bands beside a face: from and to below it in face heights, from and to outwards in widths.
HAND_DOWN, HAND_OUT = (1.0, 3.0), (0.6, 2.2)
HAND_MERGE_IOU, HAND_COVERAGE = 0.2, 0.30
CONTAINED = 0.7


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def clip(b: Column, width: Column, height: Column) -> Column:
    zero = F.lit(0)
    return box(F.greatest(zero, b["x1"]), F.greatest(zero, b["y1"]), F.least(width, b["x2"]), F.least(height, b["y2"]))


def pad_and_clip(b: Column, factor: Column | float, width: Column, height: Column) -> Column:
    """The box scaled about its centre, truncated toward zero and clipped to the frame."""
    factor = F.lit(factor) if isinstance(factor, float) else factor
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    cx, cy = b["x1"] + w / 2.0, b["y1"] + h / 2.0
    pw, ph = w * factor / 2.0, h * factor / 2.0
    return clip(box(cx - pw, cy - ph, cx + pw, cy + ph), width, height)


def expand_roi(padded: Column, tight: Column, roi: str, width: Column, height: Column) -> Column:
    """The padded box grown downwards and sideways; an unknown roi grows nothing."""
    down, side = ROI_GROWTH.get(roi, (0.0, 0.0))
    if not down and not side:
        return padded
    w, h = tight["x2"] - tight["x1"], tight["y2"] - tight["y1"]
    grown = box(padded["x1"] - w * side, padded["y1"], padded["x2"] + w * side, padded["y2"] + h * down)
    return clip(grown, width, height)


def area(b: Column) -> Column:
    return ((b["x2"] - b["x1"]).cast("long") * (b["y2"] - b["y1"]).cast("long")).cast("long")


def overlap(a: Column, b: Column) -> Column:
    """Pixels that both boxes cover."""
    w = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w.cast("long") * h.cast("long")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the boxes or their union are empty."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when((both > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def merged(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def well_formed(coordinates: Column) -> Column:
    """True for an array of four integers with x2 > x1 and y2 > y1; never null."""
    c = lambda i: F.get(coordinates, F.lit(i))
    return F.coalesce((F.size(coordinates) == 4) & (c(2) > c(0)) & (c(3) > c(1)), F.lit(False))


def hand_zones(face: Column, width: Column, height: Column) -> Column:
    """The two bands beside a face, clipped; empty ones are left out."""
    w, h = face["x2"] - face["x1"], face["y2"] - face["y1"]
    cx = (face["x1"] + face["x2"]) / 2.0
    top, bottom = face["y2"] + h * HAND_DOWN[0], face["y2"] + h * HAND_DOWN[1]
    near, far = w * HAND_OUT[0], w * HAND_OUT[1]
    both = F.array(box(cx - far, top, cx - near, bottom), box(cx + near, top, cx + far, bottom))
    clipped = F.transform(both, lambda b: clip(b, width, height))
    return F.when((w > 0) & (h > 0), F.filter(clipped, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))).otherwise(F.array().cast(BOXES))


def suppress(boxes: Column, limit: float, inclusive: bool, element: str, of=lambda e: e) -> Column:
    """Greedy suppression of an ordered array: an element is kept if its overlap with all kept ones is within limit."""
    fits = (lambda v: v <= limit) if inclusive else (lambda v: v < limit)
    step = lambda kept, e: F.when(F.forall(kept, lambda k: fits(iou(of(k), of(e)))), F.concat(kept, F.array(e))).otherwise(kept)
    return F.aggregate(boxes, F.array().cast(f"array<{element}>"), step)


def dedupe(primary: Column, extra: Column) -> Column:
    """Extras that no primary box covers by CONTAINED or more of their own area; empty extras are dropped."""
    return F.filter(extra, lambda e: (area(e) > 0) & ~F.exists(primary, lambda p: overlap(p, e) >= CONTAINED * area(e)))


def union_box(boxes: Column, width: Column, height: Column) -> Column:
    """The smallest box around all boxes, clipped; null without boxes."""
    side = lambda f, k: f(F.transform(boxes, lambda b: b[k]))
    whole = box(side(F.array_min, "x1"), side(F.array_min, "y1"), side(F.array_max, "x2"), side(F.array_max, "y2"))
    return F.when(F.size(boxes) > 0, clip(whole, width, height))


def coverage(boxes: Column, width: Column, height: Column) -> Column:
    """Summed area of the boxes over that of the frame, 0 for an empty frame."""
    total = F.aggregate(boxes, F.lit(0).cast("long"), lambda a, b: a + area(b))
    frame = width.cast("long") * height.cast("long")
    return F.when(frame > 0, total / frame).otherwise(F.lit(0.0))


def merge_overlapping(boxes: Column, limit: float, passes: Column) -> Column:
    """Boxes merged until no two overlap by limit or more.

    A pass lets each box absorb the first kept box that it overlaps; `passes` is the most passes that can change anything
    (the number of boxes), as each one that does leaves a box less. Passes behind one that left no box less do nothing.
    """

    def absorb(kept: Column, e: Column) -> Column:
        hit = F.array_position(F.transform(kept, lambda k: iou(k, e) >= limit), True).cast("int")
        joined = lambda at: F.transform(kept, lambda k, i: F.when(i + 1 == at, merged(k, e)).otherwise(k))
        return bound(hit, lambda at: F.when(at > 0, joined(at)).otherwise(F.concat(kept, F.array(e))))

    def once(a: Column, _: Column) -> Column:
        less = F.aggregate(a["boxes"], F.array().cast(BOXES), absorb)
        return F.when(a["done"], a).otherwise(F.element_at(F.transform(F.array(less), lambda x: F.struct(x.alias("boxes"), (F.size(x) == F.size(a["boxes"])).alias("done"))), 1))

    start = F.struct(boxes.cast(BOXES).alias("boxes"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), passes)), start, once)["boxes"]


def risky_regions(faces: Column, padded: Column, width: Column, height: Column, ratio: float) -> Column:
    """Padded boxes, clipped, of the faces whose short side is under ratio of the frame's; empty ones are dropped."""
    short = F.least(width, height)
    side = lambda b: F.least(b["x2"] - b["x1"], b["y2"] - b["y1"])
    small = F.filter(F.arrays_zip(faces.alias("f"), padded.alias("p")), lambda e: (side(e["f"]) > 0) & (side(e["f"]) < ratio * short))
    clipped = F.transform(small, lambda e: clip(e["p"], width, height))
    return F.filter(clipped, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]) & (short > 0))


def hand_regions(found: Column, faces: Column, width: Column, height: Column) -> Column:
    """Hands that a detector found, as they are; without any, the bands beside the faces, merged, unless they cover too much."""
    zones = F.flatten(F.transform(faces, lambda b: hand_zones(b, width, height)))
    allowed = lambda m: F.when(coverage(m, width, height) <= HAND_COVERAGE, m).otherwise(F.array().cast(BOXES))
    guessed = bound(zones, lambda z: bound(merge_overlapping(z, HAND_MERGE_IOU, F.size(z)), allowed))
    return F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(guessed)
