"""Boxes [x1, y1, x2, y2], as structs of four doubles and column expressions on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2), strict=True)])


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def valid(b: Column) -> Column:
    """Finite, with an area."""
    finite = ~(F.isnan(b.x1) | F.isnan(b.y1) | F.isnan(b.x2) | F.isnan(b.y2))
    return F.coalesce(finite & (b.x2 > b.x1) & (b.y2 > b.y1), F.lit(False))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1) * F.greatest(F.lit(0.0), b.y2 - b.y1)


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if disjoint."""
    both = intersection(a, b)
    return F.when(both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def clamp(b: Column, width: Column, height: Column, pad: int = 0) -> Column:
    """The box with padding, within the image, rounded; null if nothing is left."""
    zero = F.lit(0.0)
    inside = lambda v, most: F.greatest(zero, F.least(most.cast("double"), v))
    x1, x2 = inside(F.least(b.x1, b.x2) - pad, width), inside(F.greatest(b.x1, b.x2) + pad, width)
    y1, y2 = inside(F.least(b.y1, b.y2) - pad, height), inside(F.greatest(b.y1, b.y2) + pad, height)
    some = (half_up(x2 - x1) > 0) & (half_up(y2 - y1) > 0)
    return F.when(some, box(half_up(x1), half_up(y1), half_up(x2), half_up(y2)))


def working_scale(width: Column, height: Column, most: int = 1600) -> Column:
    """(width, height) within `most` on either side, proportions kept."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / width, F.lit(float(most)) / height)
    size = lambda v: F.greatest(F.lit(1), half_up(v * scale)).cast("int")
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def sub_box(b: Column, text: Column, value: Column) -> Column:
    """The part of a line's box that a value takes, in proportion to its characters; the whole box
    where it takes nearly all, null where the text does not hold it (white space aside)."""
    low, val = F.lower(text), F.lower(value)
    plain = F.call_function("instr", low, val)
    flat_text, flat_value = F.regexp_replace(low, r"\s+", ""), F.regexp_replace(val, r"\s+", "")
    at = F.when(plain > 0, plain).otherwise(F.call_function("instr", flat_text, flat_value))
    total = F.when(plain > 0, F.length(low)).otherwise(F.length(flat_text))
    size = F.when(plain > 0, F.length(val)).otherwise(F.length(flat_value))
    a, z = (at - 1) / total, (at - 1 + size) / total
    width = b.x2 - b.x1
    part = box(b.x1 + width * a, b.y1, b.x1 + width * z, b.y2)
    return F.when((at > 0) & (size > 0), F.when(size / total > 0.98, b).otherwise(part))


def value_only(b: Column, line: Column, text: Column, value: Column) -> Column:
    """Whether a box can be a value's own: not a whole line's where the line is over three
    characters longer than the value (over 0.92 of the line's width)."""
    longer = F.length(text) > F.length(value) + 3
    wide = (b.x2 - b.x1) / F.nullif(line.x2 - line.x1, F.lit(0.0)) > 0.92
    return F.coalesce(~(longer & wide), F.lit(True))


def union_of(boxes: Column) -> Column:
    """The box around all boxes of an array."""
    return box(F.array_min(F.transform(boxes, lambda b: b.x1)), F.array_min(F.transform(boxes, lambda b: b.y1)), F.array_max(F.transform(boxes, lambda b: b.x2)), F.array_max(F.transform(boxes, lambda b: b.y2)))


def suppress(boxes: Column, most: int = 25, threshold: float = 0.3) -> Column:
    """Non-maximum suppression of array<struct<score, box>>: best score first, those that overlap
    a kept one by more than the threshold go, at most `most` stay."""
    order = F.reverse(F.array_sort(boxes))
    step = lambda kept, x: F.when((F.size(kept) >= most) | F.exists(kept, lambda k: iou(k.box, x.box) > threshold), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(order, F.slice(boxes, 1, 0), step)
