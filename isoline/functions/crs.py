"""Reference systems: 4326 and 4269 (taken as equal, which is right to about a metre), 3857, all UTM zones, the British grid, and two world projections.

The world projections are on the sphere of RADIUS, by the published formulas (Snyder, USGS Professional Paper 1395). Robinson's table is read
linearly between its parallels, so it may differ by some hundred metres from implementations with another interpolation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoline.functions.transverse import AIRY, TO_OSGB36, WGS84, TransverseMercator, shifted, then

#: Fixed value: the semi-major axis used by 3857.
RADIUS = 6378137.0
#: Own numbers of two systems that have an ESRI number, not an EPSG one.
VAN_DER_GRINTEN, ROBINSON = 54029, 54030
#: Robinson's length of parallel and distance from the equator at 0, 5, ..., 90 degrees.
ROBINSON_X = (1.0, 0.9986, 0.9954, 0.99, 0.9822, 0.973, 0.96, 0.9427, 0.9216, 0.8962, 0.8679, 0.835, 0.7986, 0.7597, 0.7186, 0.6732, 0.6213, 0.5722, 0.5322)
ROBINSON_Y = (0.0, 0.062, 0.124, 0.186, 0.248, 0.31, 0.372, 0.434, 0.4958, 0.5571, 0.6176, 0.6769, 0.7346, 0.7903, 0.8435, 0.8936, 0.9394, 0.9761, 1.0)
#: name and area of use (xmin, xmax, ymin, ymax in degrees) of each system
KNOWN = {
    4326: ("WGS 84", (-180, 180, -90, 90)),
    4269: ("NAD83", (-172.54, -47.74, 23.81, 86.46)),
    3857: ("WGS 84 / Pseudo-Mercator", (-180, 180, -85.06, 85.06)),
    VAN_DER_GRINTEN: ("World Van der Grinten I", (-180, 180, -90, 90)),
    ROBINSON: ("World Robinson", (-180, 180, -90, 90)),
}


def srid(text: str) -> int:
    """The number of EPSG:n or ESRI:n, or of the name of a known system."""
    kind, _, n = text.partition(":")
    found = int(n) if kind.upper() in ("EPSG", "ESRI") and n.isdigit() else next((k for k, (name, _) in KNOWN.items() if name == text), None)
    if found is None or not is_known(found):
        raise ValueError(f"unknown reference system {text}")
    return found


BRITISH = 27700


def _pair(place: Column) -> tuple[Column, Column]:
    return place["x"], place["y"]


def is_known(number: int) -> bool:
    """Also makes UTM zones (326zz north, 327zz south) and the British grid known when they are first asked for."""
    if number in KNOWN:
        return True
    zone, half = number % 100, number // 100
    if half in (326, 327) and 1 <= zone <= 60:
        grid, west = TransverseMercator(6 * zone - 183, northing=10_000_000.0 * (half == 327)), 6 * zone - 186
        add_system(number, f"WGS 84 / UTM zone {zone}{'N' if half == 326 else 'S'}", (west, west + 6, *((0, 84) if half == 326 else (-80, 0))), lambda x, y: _pair(grid.forward(x, y)), lambda x, y: _pair(grid.back(x, y)))
    elif number == BRITISH:
        grid = TransverseMercator(-2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0, AIRY)
        add_system(number, "OSGB36 / British National Grid", (-9, 2.01, 49.75, 61.01), lambda x, y: _pair(then(shifted(x, y, WGS84, AIRY, TO_OSGB36), grid.forward)), lambda x, y: _pair(then(grid.back(x, y), lambda u, v: shifted(u, v, AIRY, WGS84, TO_OSGB36, back=True))))
    return number in KNOWN


def _table(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), k.cast("int") + 1)


def _robinson(x: Column, y: Column) -> tuple[Column, Column]:
    k = F.least(F.floor(F.abs(y) / 5), F.lit(17))
    f = F.abs(y) / 5 - k
    px, py = (_table(t, k) + (_table(t, k + 1) - _table(t, k)) * f for t in (ROBINSON_X, ROBINSON_Y))
    return F.radians(x) * px * (0.8487 * RADIUS), F.signum(y) * py * (1.3523 * RADIUS)


def _robinson_back(x: Column, y: Column) -> tuple[Column, Column]:
    p = F.abs(y) / (1.3523 * RADIUS)
    k = F.least(F.size(F.filter(F.array(*map(F.lit, ROBINSON_Y)), lambda v: v <= p)) - 1, F.lit(17))
    f = (p - _table(ROBINSON_Y, k)) / (_table(ROBINSON_Y, k + 1) - _table(ROBINSON_Y, k))
    px = _table(ROBINSON_X, k) + (_table(ROBINSON_X, k + 1) - _table(ROBINSON_X, k)) * f
    return F.degrees(x / (px * (0.8487 * RADIUS))), F.signum(y) * (k + f) * 5


def _van_der_grinten(x: Column, y: Column) -> tuple[Column, Column]:
    lam, r = F.radians(x), math.pi * RADIUS
    s = F.least(F.abs(y) / 90, F.lit(1.0))
    c = F.sqrt(1 - s * s)
    a = F.abs(F.try_divide(F.lit(math.pi), lam) - lam / math.pi) / 2
    g = F.try_divide(c, s + c - 1)
    p, q = g * (F.try_divide(F.lit(2.0), s) - 1), a * a + g
    d = p * p + a * a
    px = F.try_divide(a * (g - p * p) + F.sqrt(F.greatest(a * a * (g - p * p) * (g - p * p) - d * (g * g - p * p), F.lit(0.0))), d)
    py = F.try_divide(p * q - a * F.sqrt(F.greatest((a * a + 1) * d - q * q, F.lit(0.0))), d)
    axis = F.tan(F.asin(s) / 2)
    equator, pole, middle = y == 0, s >= 1, lam == 0
    return (
        F.when(equator, lam * RADIUS).when(pole | middle, F.lit(0.0)).otherwise(F.signum(lam) * r * px),
        F.when(equator, F.lit(0.0)).when(pole | middle, F.signum(y) * r * axis).otherwise(F.signum(y) * r * F.abs(py)),
    )


def _van_der_grinten_back(x: Column, y: Column) -> tuple[Column, Column]:
    u, v = x / (math.pi * RADIUS), y / (math.pi * RADIUS)
    w = u * u + v * v
    c1 = -F.abs(v) * (1 + w)
    c2 = c1 - 2 * v * v + u * u
    c3 = -2 * c1 + 1 + 2 * v * v + w * w
    d = v * v / c3 + (2 * c2 * c2 * c2 / (c3 * c3 * c3) - 9 * c1 * c2 / (c3 * c3)) / 27
    a1 = (c1 - c2 * c2 / (3 * c3)) / c3
    m = 2 * F.sqrt(F.greatest(-a1 / 3, F.lit(0.0)))
    t = F.acos(F.least(F.greatest(F.coalesce(F.try_divide(3 * d, a1 * m), F.lit(1.0)), F.lit(-1.0)), F.lit(1.0))) / 3
    lat = F.signum(y) * 180 * (-m * F.cos(t + math.pi / 3) - c2 / (3 * c3))
    lon = F.try_divide(180 * (w - 1 + F.sqrt(1 + 2 * (u * u - v * v) + w * w)), 2 * u)
    return F.coalesce(lon, F.when(x.isNotNull(), F.lit(0.0))), F.when(y == 0, F.lit(0.0)).otherwise(lat)


_WORLD = {VAN_DER_GRINTEN: (_van_der_grinten, _van_der_grinten_back), ROBINSON: (_robinson, _robinson_back)}


def add_system(number: int, name: str, area: tuple, forward, back) -> None:
    """Makes another system known: forward(lon, lat) and back(x, y) are column functions that give two columns."""
    KNOWN[number] = (name, area)
    _WORLD[number] = (forward, back)


def transform_xy(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    geographic = {4326, 4269}
    if not (is_known(source) and is_known(target)):
        raise ValueError(f"no transformation from {source} to {target}")
    if source == target or {source, target} <= geographic:
        return x, y
    if source in geographic and target == 3857:
        return F.radians(x) * RADIUS, F.log(F.tan(F.radians(y) / 2 + math.pi / 4)) * RADIUS
    if source == 3857 and target in geographic:
        return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)
    if source in _WORLD:
        return transform_xy(*_WORLD[source][1](x, y), 4326, target)
    if target in _WORLD:
        return _WORLD[target][0](*transform_xy(x, y, source, 4326))
    raise ValueError(f"no transformation from {source} to {target}")


def transform_points(c: Column, source: int, target: int) -> Column:
    """An array of points in another system."""
    def one(p: Column) -> Column:
        x, y = transform_xy(p["x"], p["y"], source, target)
        return F.struct(x.alias("x"), y.alias("y"))

    return c if source == target else F.transform(c, one)


def transform_parts(parts: Column, source: int, target: int) -> Column:
    return parts if source == target else F.transform(parts, lambda c: transform_points(c, source, target))


def transform_box(box: tuple, source: int, target: int, steps: int = 1) -> list[Column]:
    """xmin, xmax, ymin, ymax of the transformed box: by two corners for steps = 1, else by steps + 1 places along each side."""
    x0, x1, y0, y1 = (v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in box)
    if steps == 1:
        at = [(x0, y0), (x1, y1)]
    else:
        ways = [k / steps for k in range(steps + 1)]
        at = [q for t in ways for q in ((x0 + (x1 - x0) * t, y0), (x0 + (x1 - x0) * t, y1), (x0, y0 + (y1 - y0) * t), (x1, y0 + (y1 - y0) * t))]
    xs, ys = zip(*(transform_xy(x, y, source, target) for x, y in at), strict=True)
    return [F.least(*xs), F.greatest(*xs), F.least(*ys), F.greatest(*ys)]
