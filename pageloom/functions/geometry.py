"""Boxes with the origin at the top left: columns x0, y0, x1, y1, with an optional prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))


def area(b: tuple) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: tuple, b: tuple) -> Column:
    return F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union; 0 where both are empty."""
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def center_x(b: tuple) -> Column:
    return (b[0] + b[2]) / 2


def center_y(b: tuple) -> Column:
    return (b[1] + b[3]) / 2


def overlaps_y(a: tuple, b: tuple, tolerance: float = 2.0) -> Column:
    return F.abs(center_y(a) - center_y(b)) < tolerance


def contains(b: tuple, x: Column, y: Column) -> Column:
    return (b[0] <= x) & (x <= b[2]) & (b[1] <= y) & (y <= b[3])


def vertical_gap(a: tuple, b: tuple) -> Column:
    """0 where the boxes overlap vertically."""
    return F.when(b[1] >= a[3], b[1] - a[3]).when(a[1] >= b[3], a[1] - b[3]).otherwise(0.0)
