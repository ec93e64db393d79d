"""Vector maths on points struct<x,y>: plain arithmetic columns. A null point gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoline.functions.geometry import point


def add(p: Column, q: Column) -> Column:
    return point(p["x"] + q["x"], p["y"] + q["y"])


def subtract(p: Column, q: Column) -> Column:
    return point(p["x"] - q["x"], p["y"] - q["y"])


def scale(p: Column, k) -> Column:
    return point(p["x"] * k, p["y"] * k)


def cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - p["y"] * q["x"]


def dot(p: Column, q: Column) -> Column:
    return p["x"] * q["x"] + p["y"] * q["y"]


def norm(p: Column) -> Column:
    return F.sqrt(dot(p, p))


def distance(p: Column, q: Column) -> Column:
    return norm(subtract(p, q))


def lerp(p: Column, q: Column, t) -> Column:
    return point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)


def angle(p: Column, q: Column) -> Column:
    """Radians between two vectors; NaN where one of them is zero."""
    return F.acos(F.coalesce(F.try_divide(dot(p, q), norm(p) * norm(q)), F.when(p.isNotNull() & q.isNotNull(), F.lit(float("nan")))))


def deflection(p: Column, q: Column, r: Column) -> Column:
    """The turn at q on the way from p to r."""
    return angle(subtract(q, p), subtract(r, q))


def triangle_area(p: Column, q: Column, r: Column) -> Column:
    return F.abs(cross(subtract(q, p), subtract(r, p))) / 2


def segment_intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The common point of ab and cd, ends included; null where there is none or they are parallel."""
    r, s, ac = subtract(b, a), subtract(d, c), subtract(c, a)
    t, u = F.try_divide(cross(ac, s), cross(r, s)), F.try_divide(cross(ac, r), cross(r, s))
    return F.when(t.between(0, 1) & u.between(0, 1), lerp(a, b, t))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance of p from the segment ab; a segment without length counts as its point."""
    t = F.coalesce(F.try_divide(dot(subtract(p, a), subtract(b, a)), dot(subtract(b, a), subtract(b, a))), F.lit(0.0))
    return distance(p, lerp(a, b, F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))))


def pixel_to_geo(column: Column, row: Column, box: tuple, width: int, height: int, legacy: bool = False) -> Column:
    """The place of a pixel's upper left corner; box is xmin, xmax, ymin, ymax of the pixel edges. legacy: box is measured at the last pixel's corner."""
    w, h = (width - 1, height - 1) if legacy else (width, height)
    return point(box[0] + column * ((box[1] - box[0]) / w), box[3] - row * ((box[3] - box[2]) / h))


def geo_to_pixel(p: Column, box: tuple, width: int, height: int) -> tuple[Column, Column]:
    return (p["x"] - box[0]) * (width / (box[1] - box[0])), (box[3] - p["y"]) * (height / (box[3] - box[2]))
