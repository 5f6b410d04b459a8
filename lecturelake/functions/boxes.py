"""Geometry of boxes, structs with doubles x, y (corner of least coordinates), w and h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def area(a: Column) -> Column:
    """0 where a side is negative."""
    return F.greatest(a.w, F.lit(0.0)) * F.greatest(a.h, F.lit(0.0))


def diagonal(a: Column) -> Column:
    return F.hypot(a.w, a.h)


def _span(a: Column, b: Column, at: str, size: str) -> tuple[Column, Column]:
    """Overlap (negative: distance) along an axis, and distance of the centres."""
    (p, m), (q, n) = (a[at], a[size]), (b[at], b[size])
    return F.least(p + m, q + n) - F.greatest(p, q), (p + m / 2) - (q + n / 2)


def intersection(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(_span(a, b, "x", "w")[0], zero) * F.greatest(_span(a, b, "y", "h")[0], zero)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty boxes."""
    both = intersection(a, b)
    union = a.w * a.h + b.w * b.h - both
    return F.when(union > 0, both / union).otherwise(0.0)


def share_of_smaller(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot(_span(a, b, "x", "w")[1], _span(a, b, "y", "h")[1])


def gap(a: Column, b: Column) -> Column:
    """Distance of the nearest points; 0 where the boxes touch."""
    zero = F.lit(0.0)
    return F.hypot(F.greatest(-_span(a, b, "x", "w")[0], zero), F.greatest(-_span(a, b, "y", "h")[0], zero))


def near(a: Column, b: Column) -> Column:
    """Whether two boxes overlap, one holds a fifth of the other, or they lie close for their size."""
    close = F.greatest(F.lit(0.01), 0.35 * F.least(diagonal(a), diagonal(b)))
    return (iou(a, b) > 0) | (share_of_smaller(a, b) >= 0.2) | (gap(a, b) <= close)
