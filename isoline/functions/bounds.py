"""Bounding boxes as four scalar columns, so that Parquet statistics and filter pushdown work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple  # (xmin, xmax, ymin, ymax) of columns or numbers


def _c(box: Box) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x)) for x in box]


def intersects(a: Box, b: Box) -> Column:
    """Strict: boxes that only touch do not intersect."""
    (ax, aX, ay, aY), (bx, bX, by, bY) = _c(a), _c(b)
    return (aX > bx) & (ax < bX) & (aY > by) & (ay < bY)


def within(a: Box, b: Box) -> Column:
    """Inclusive: a lies in b."""
    (ax, aX, ay, aY), (bx, bX, by, bY) = _c(a), _c(b)
    return (ax >= bx) & (aX <= bX) & (ay >= by) & (aY <= bY)


def contains_point(box: Box, x: Column, y: Column) -> Column:
    """Inclusive."""
    bx, bX, by, bY = _c(box)
    return x.between(bx, bX) & y.between(by, bY)


def intersection(a: Box, b: Box) -> list[Column]:
    """The common box, or nulls where the boxes do not intersect."""
    (ax, aX, ay, aY), (bx, bX, by, bY), ok = _c(a), _c(b), intersects(a, b)
    return [F.when(ok, v) for v in (F.greatest(ax, bx), F.least(aX, bX), F.greatest(ay, by), F.least(aY, bY))]


def resize_x(box: Box, width: Column | float) -> list[Column]:
    bx, bX, by, bY = _c(box)
    w = F.lit(width) if not isinstance(width, Column) else width
    return [(bx + bX) / 2 - w / 2, (bx + bX) / 2 + w / 2, by, bY]


def resize_y(box: Box, height: Column | float) -> list[Column]:
    bx, bX, by, bY = _c(box)
    h = F.lit(height) if not isinstance(height, Column) else height
    return [bx, bX, (by + bY) / 2 - h / 2, (by + bY) / 2 + h / 2]


def extent() -> list[Column]:
    """Aggregates over the columns xmin, xmax, ymin, ymax; nulls are ignored."""
    return [F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"), F.min("ymin").alias("ymin"), F.max("ymax").alias("ymax")]


def of_points(p: Column, q: Column) -> list[Column]:
    """The box of two corners, in any order."""
    return [F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"]), F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])]


def width(box: Box) -> Column:
    return _c(box)[1] - _c(box)[0]


def height(box: Box) -> Column:
    return _c(box)[3] - _c(box)[2]


def size(box: Box) -> Column:
    """The longer side."""
    return F.greatest(width(box), height(box))


def center(box: Box) -> Column:
    bx, bX, by, bY = _c(box)
    return F.struct(((bx + bX) / 2).alias("x"), ((by + bY) / 2).alias("y"))


def affine(box: Box, scale_x, scale_y, offset_x, offset_y) -> list[Column]:
    """The box of the two moved corners."""
    bx, bX, by, bY = _c(box)
    at = lambda x, y: F.struct((x * scale_x + offset_x).alias("x"), (y * scale_y + offset_y).alias("y"))
    return of_points(at(bx, bY), at(bX, by))


def text(box: Box) -> Column:
    """X: (xmin, xmax) Y: (ymin, ymax), whole numbers without decimals."""
    n = [F.regexp_replace(v.cast("string"), r"\.0$", "") for v in _c(box)]
    return F.concat(F.lit("X: ("), n[0], F.lit(", "), n[1], F.lit(") Y: ("), n[2], F.lit(", "), n[3], F.lit(")"))


def ring(box: Box) -> Column:
    """The box as a closed ring from its lower left corner by the upper left one."""
    bx, bX, by, bY = _c(box)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(bx, by), at(bx, bY), at(bX, bY), at(bX, by), at(bx, by))
