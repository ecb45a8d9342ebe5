"""Face geometry. A box is ``STRUCT<x1,y1,x2,y2>`` of doubles; x2/y2 are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    parts = zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))
    return F.struct(*[c.cast("double").alias(n) for c, n in parts])


def box_width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def box_height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def box_area(b: Column) -> Column:
    return box_width(b) * box_height(b)


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 when the union is empty."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    shared = wide * high
    union = box_area(a) + box_area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def shift(b: Column, dx: Column, dy: Column) -> Column:
    """Translate a box found in a crop back to its picture."""
    return make_box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def rescale(b: Column, factor: Column) -> Column:
    """Scale a box found in a resized picture."""
    return make_box(*[b[c] * factor for c in ("x1", "y1", "x2", "y2")])


def shift_landmarks(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def rescale_landmarks(points: Column, factor: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))


def margin_crop(b: Column, margin: float, width: Column, height: Column) -> Column:
    """Grow a box by a share of its size and clamp it to whole pixels; the whole frame if empty."""
    dx, dy = box_width(b) * margin, box_height(b) * margin
    zero = F.lit(0.0)
    grown = make_box(
        F.greatest(zero, F.rint(b["x1"] - dx)), F.greatest(zero, F.rint(b["y1"] - dy)),
        F.least(width, F.rint(b["x2"] + dx)), F.least(height, F.rint(b["y2"] + dy)))
    empty = (grown["x2"] <= grown["x1"]) | (grown["y2"] <= grown["y1"])
    return F.when(empty, make_box(zero, zero, width, height)).otherwise(grown)


def face_crop_box(b: Column, width: Column, height: Column) -> Column:
    """Integer crop inside the frame, at least one pixel on either side."""
    cut = lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double")  # truncation
    x1 = cut(F.greatest(F.lit(0.0), F.least(width - 1, b["x1"])))
    y1 = cut(F.greatest(F.lit(0.0), F.least(height - 1, b["y1"])))
    return make_box(x1, y1, cut(F.greatest(x1 + 1, F.least(width, b["x2"]))),
                    cut(F.greatest(y1 + 1, F.least(height, b["y2"]))))


def is_plausible(b: Column, confidence: Column, width: Column, height: Column,
                 below: float = 0.7, fraction: float = 0.5) -> Column:
    """False for a weak detection that fills more than half the frame's short side."""
    short = F.least(box_width(b), box_height(b))
    return ~((confidence < below) & (short > fraction * F.least(width, height)))


def frontality(landmarks: Column) -> Column:
    """1 for a frontal face, falling as the head turns; 0.5 without usable landmarks."""
    x = lambda i: F.get(landmarks, i)["x"]
    left, right = F.abs(x(2) - x(0)), F.abs(x(1) - x(2))
    usable = landmarks.isNotNull() & (F.size(landmarks) >= 5) & (left + right > 0)
    return F.when(usable, F.lit(1.0) - F.abs(left - right) / (left + right)).otherwise(F.lit(0.5))


def centre_distance(a: Column, aw: Column, ah: Column, b: Column, bw: Column, bh: Column) -> Column:
    """Distance of two box centres, each relative to its canvas."""
    dx = (a["x1"] + a["x2"]) / 2 / aw - (b["x1"] + b["x2"]) / 2 / bw
    dy = (a["y1"] + a["y2"]) / 2 / ah - (b["y1"] + b["y2"]) / 2 / bh
    return F.sqrt(dx * dx + dy * dy)
