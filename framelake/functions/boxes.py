"""Column functions over boxes. A box is struct<x0,y0,x1,y1: double>, absolute corners, unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(v) -> Column:
    return v.cast("double") if isinstance(v, Column) else F.lit(float(v))


def box(x0, y0, x1, y1) -> Column:
    as_double = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.struct(as_double(x0).alias("x0"), as_double(y0).alias("y0"), as_double(x1).alias("x1"), as_double(y1).alias("y1"))


def from_xywh(x, y, w, h) -> Column:
    return box(x, y, x + w, y + h)


def from_cxcywh(cx, cy, w, h) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def to_xywh(b: Column) -> Column:
    return F.struct(b["x0"].alias("x"), b["y0"].alias("y"), width(b).alias("w"), height(b).alias("h"))


def to_cxcywh(b: Column) -> Column:
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("cx"), ((b["y0"] + b["y1"]) / 2).alias("cy"), width(b).alias("w"), height(b).alias("h"))


def area(b: Column) -> Column:
    """Negative for turned boxes."""
    return width(b) * height(b)


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Column, b: Column) -> Column:
    """0 without a union."""
    both = union(a, b)
    return F.when(both > 0, intersection(a, b) / both).otherwise(F.lit(0.0))


def hull(a: Column, b: Column) -> Column:
    return (F.greatest(a["x1"], b["x1"]) - F.least(a["x0"], b["x0"])) * (F.greatest(a["y1"], b["y1"]) - F.least(a["y0"], b["y0"]))


def giou(a: Column, b: Column) -> Column:
    around = hull(a, b)
    return iou(a, b) - F.when(around > 0, (around - union(a, b)) / around).otherwise(F.lit(0.0))


def ioa(a: Column, b: Column) -> Column:
    """Intersection over the area of b, as for crowd regions."""
    return F.when(area(b) > 0, intersection(a, b) / area(b)).otherwise(F.lit(0.0))


def iom(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def clip(b: Column, w, h) -> Column:
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), _number(most))
    return box(inside(b["x0"], w), inside(b["y0"], h), inside(b["x1"], w), inside(b["y1"], h))


def scaled(b: Column, rw, rh) -> Column:
    return box(b["x0"] * rw, b["y0"] * rh, b["x1"] * rw, b["y1"] * rh)


def shifted(b: Column, dx, dy) -> Column:
    return box(b["x0"] + dx, b["y0"] + dy, b["x1"] + dx, b["y1"] + dy)


def cropped(b: Column, left, top, w, h) -> Column:
    return clip(shifted(b, -left, -top), w, h)


def flipped(b: Column, w) -> Column:
    return box(_number(w) - b["x1"], b["y0"], _number(w) - b["x0"], b["y1"])


def about_centre(b: Column, factor) -> Column:
    c = to_cxcywh(b)
    return from_cxcywh(c["cx"], c["cy"], c["w"] * factor, c["h"] * factor)


def near_boundary(b: Column, w, h, margin=0.025) -> Column:
    """The centre lies within the margin of an edge, or just at it."""
    c = to_cxcywh(b)
    x, y = c["cx"] / w, c["cy"] / h
    return (x <= margin) | (x >= 1 - margin) | (y <= margin) | (y >= 1 - margin)


def inside(b: Column, w, h, slack=0) -> Column:
    return (b["x0"] >= -slack) & (b["y0"] >= -slack) & (b["x1"] < w + slack) & (b["y1"] < h + slack)


def is_zero(b: Column) -> Column:
    """Null, or no coordinate above 0."""
    return b.isNull() | ((b["x0"] <= 0) & (b["y0"] <= 0) & (b["x1"] <= 0) & (b["y1"] <= 0))


def resize_dims(w: Column, h: Column, short: int, most: int) -> Column:
    """New width and height for a short side of `short` and a long side of at most `most`, halves rounded to even."""
    small, large = F.least(w, h).cast("double"), F.greatest(w, h).cast("double")
    target = F.when(large / small * short > most, F.bround(most * small / large)).otherwise(F.lit(float(short)))
    other = lambda side: F.when(side == small, target).otherwise(F.floor(target * side / small).cast("double"))
    return F.struct(other(w.cast("double")).alias("w"), other(h.cast("double")).alias("h"))
