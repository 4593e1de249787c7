"""Column functions over boxes given as four corner columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def corners(prefix: str = "", names: tuple[str, ...] = ("x1", "y1", "x2", "y2")) -> Box:
    """The corner columns, each with ``prefix`` before its name."""
    x1, y1, x2, y2 = (F.col(prefix + n) for n in names)
    return x1, y1, x2, y2


def area(box: Box) -> Column:
    return (box[2] - box[0]) * (box[3] - box[1])


def iou(a: Box, b: Box, plus_one: bool = False) -> Column:
    """Intersection over union; with ``plus_one`` sides count whole pixels. No overlap gives 0."""
    one = 1.0 if plus_one else 0.0
    side = lambda low, high: F.greatest(F.lit(0.0), high - low + one)
    both = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    whole = lambda v: (v[2] - v[0] + one) * (v[3] - v[1] + one)
    return both / (whole(a) + whole(b) - both + 1e-9)


def point_in_box(x: Column, y: Column, box: Box) -> Column:
    """Closed on all four sides."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def grown(box: Box, margin: float = 0.25) -> Box:
    """The box with ``margin`` of its size added on each side, unclipped."""
    dx, dy = (box[2] - box[0]) * margin, (box[3] - box[1]) * margin
    return box[0] - dx, box[1] - dy, box[2] + dx, box[3] + dy


def grown_pixels(box: Box, width: Column, height: Column, margin: float = 0.25) -> Box:
    """Grown by ``margin`` in all about the centre, in whole pixels within the frame.

    The corners are truncated first, and the grown corners again, towards zero.
    """
    x1, y1, x2, y2 = (c.cast("int") for c in box)
    w, h = x2 - x1, y2 - y1
    cx, cy = x1 + w / 2.0, y1 + h / 2.0
    half_w, half_h = w * (1 + margin) / 2.0, h * (1 + margin) / 2.0
    return (
        F.greatest(F.lit(0), (cx - half_w).cast("int")),
        F.greatest(F.lit(0), (cy - half_h).cast("int")),
        F.least(width.cast("int") - 1, (cx + half_w).cast("int")),
        F.least(height.cast("int") - 1, (cy + half_h).cast("int")),
    )
