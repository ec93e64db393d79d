"""Geometry over array<struct<x,y>> with higher-order functions; nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _pairs(c: Column, f) -> Column:
    """f(vertex, next vertex) for each segment."""
    n = F.size(c)
    return F.when(n < 2, F.array().cast("array<double>")).otherwise(F.zip_with(F.slice(c, 1, n - 1), F.slice(c, 2, n - 1), f))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def length(c: Column) -> Column:
    return _sum(_pairs(c, lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))))


def area(ring: Column) -> Column:
    """Shoelace; counter-clockwise is positive."""
    return _sum(_pairs(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def is_ccw(ring: Column) -> Column:
    return area(ring) > 0


def is_closed(c: Column) -> Column:
    return F.get(c, F.lit(0)) == F.element_at(c, -1)


def affine(c: Column, scale_x, scale_y, offset_x, offset_y) -> Column:
    return F.transform(c, lambda p: point(p["x"] * scale_x + offset_x, p["y"] * scale_y + offset_y))


def bounds(c: Column) -> list[Column]:
    xs, ys = F.transform(c, lambda p: p["x"]), F.transform(c, lambda p: p["y"])
    return [F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)]


def circle(x: Column, y: Column, r: Column, n: int = 24) -> Column:
    """A closed n-gon, counter-clockwise, first vertex north."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: point(x - r * F.sin((k % n) * (2 * math.pi / n)), y + r * F.cos((k % n) * (2 * math.pi / n))))


def chaikin_open(c: Column) -> Column:
    """One round of corner cutting of an open line: ends stay; fewer than three vertices stay as they are."""
    n = F.size(c)

    def cut(i: Column) -> Column:
        p, q, r = F.get(c, i - 1), F.get(c, i), F.get(c, i + 1)
        mix = lambda a, b, t: point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)
        return F.array(mix(p, q, 0.75), mix(q, r, 0.25))

    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), cut))
    return F.when(n < 3, c).otherwise(F.concat(F.slice(c, 1, 1), inner, F.slice(c, n, 1)))


def chaikin_closed(c: Column) -> Column:
    """One round of corner cutting of a closed ring, its seam included: 2n - 1 vertices, the first repeated at the end."""
    n = F.size(c)
    mix = lambda a, b, t: point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)

    def cut(i: Column) -> Column:
        p, q, r = F.get(c, F.pmod(i - 1, n - 1)), F.get(c, i), F.get(c, i + 1)
        return F.array(mix(p, q, 0.75), mix(q, r, 0.25))

    out = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), cut))
    m = F.size(out)
    return F.when(n < 4, c).otherwise(F.concat(F.slice(out, 2, m - 1), F.slice(out, 1, 1), F.slice(out, 2, 1)))


def chaikin(c: Column, rounds: int, closed: bool = False) -> Column:
    for _ in range(rounds):
        c = chaikin_closed(c) if closed else chaikin_open(c)
    return c


def point_along(c: Column, t, legacy: bool = False) -> Column:
    """The point at the share t of a line's length. legacy: the first segment that ends at or before that length is extended instead."""
    state = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("struct<x:double,y:double>").alias("at"))
    goal = length(c) * t

    def step(a: Column, i: Column) -> Column:
        p, q = F.get(c, i), F.get(c, i + 1)
        seg = F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
        k = F.coalesce(F.try_divide(goal - a["run"], seg), F.lit(0.0))
        here = (a["run"] + seg <= goal) if legacy else (a["run"] + seg >= goal)
        found = F.when(a["at"].isNull() & here, point(p["x"] + (q["x"] - p["x"]) * k, p["y"] + (q["y"] - p["y"]) * k)).otherwise(a["at"])
        return F.struct((a["run"] + seg).alias("run"), found.alias("at"))

    found = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), state, step)["at"]
    return F.when(F.size(c) > 1, F.coalesce(found, F.element_at(c, -1))).otherwise(F.get(c, F.lit(0)))


def midpoint(c: Column) -> Column:
    return point_along(c, 0.5)


def centroid(ring: Column) -> Column:
    """Centroid of the area; a ring without area gives its first vertex."""
    k = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    six = area(ring) * 6
    x = F.try_divide(_sum(_pairs(ring, lambda p, q: (p["x"] + q["x"]) * k(p, q))), six)
    y = F.try_divide(_sum(_pairs(ring, lambda p, q: (p["y"] + q["y"]) * k(p, q))), six)
    return F.when(x.isNull(), F.get(ring, F.lit(0))).otherwise(point(x, y))


def offset_line(c: Column, d) -> Column:
    """Each segment moved to its right by d, unjoined: the moved start and the moved end of every segment. Segments without length are left out; d = 0 changes nothing."""
    d = d if isinstance(d, Column) else F.lit(float(d))
    kept = F.filter(c, lambda p, i: (i == 0) | (p != F.get(c, i - 1)))

    def moved(p: Column, q: Column) -> Column:
        k = F.try_divide(d, F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"])))
        dx, dy = (q["y"] - p["y"]) * k, (p["x"] - q["x"]) * k
        return F.array(point(p["x"] + dx, p["y"] + dy), point(q["x"] + dx, q["y"] + dy))

    m = F.size(kept)
    return F.when((m < 2) | (d == 0), c).otherwise(F.flatten(F.zip_with(F.slice(kept, 1, F.greatest(m - 1, F.lit(0))), F.slice(kept, 2, F.greatest(m - 1, F.lit(0))), moved)))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule."""
    crossings = _pairs(ring, lambda p, q: F.when(((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]), 1.0).otherwise(0.0))
    return _sum(crossings) % 2 == 1


def signed_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of (x, y) from a ring's outline, positive inside (even-odd)."""
    def seg(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.least(F.greatest(F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        ex, ey = x - p["x"] - dx * t, y - p["y"] - dy * t
        return F.sqrt(ex * ex + ey * ey)

    return F.array_min(_pairs(ring, seg)) * F.when(contains(ring, x, y), 1.0).otherwise(-1.0)


def svg_path(c: Column, decimals: int = 3) -> Column:
    """M x y L x y ..., with Z after the last vertex where the line is closed."""
    at = F.transform(c, lambda p: F.format_string(f"%.{decimals}f %.{decimals}f", p["x"], p["y"]))
    body = F.concat(F.lit("M "), F.array_join(at, " L "))
    return F.when(F.size(c) == 0, F.lit("")).otherwise(F.concat(body, F.when(is_closed(c) & (F.size(c) > 1), F.lit(" Z")).otherwise(F.lit(""))))
