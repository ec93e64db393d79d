"""Transverse Mercator on an ellipsoid by Krueger's series (to the fourth power of the third flattening), and the shift between two datums.

Within 3,000 km of the central meridian the series is exact to well below a millimetre. Formulas as published: Karney, Journal of Geodesy 85 (2011), and
the seven-parameter shift in position-vector form (IOGP Guidance Note 7-2).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(f, **values: Column) -> Column:
    """f of a struct of the values, each computed once: without it, formulas put into formulas grow without bound."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), f)[0]


def then(place: Column, f) -> Column:
    """f(x, y) of a struct<x, y> that is computed once."""
    return F.transform(F.array(place), lambda p: f(p["x"], p["y"]))[0]


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    flattening: float

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)


# Ellipsoids, and the seven parameters (metres, seconds of arc, parts in a million) from WGS 84 to the British datum.
WGS84 = Ellipsoid(6378137.0, 1 / 298.257223563)
AIRY = Ellipsoid(6377563.396, 1 / 299.3249646)
TO_OSGB36 = (-446.448, 125.157, -542.06, -0.1502, -0.247, -0.8421, 20.4894)


@dataclass(frozen=True)
class TransverseMercator:
    """Central meridian and parallel of origin in degrees, scale along the meridian, false easting and northing."""

    lon0: float
    lat0: float = 0.0
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0
    on: Ellipsoid = WGS84

    @property
    def n(self) -> float:
        return self.on.flattening / (2 - self.on.flattening)

    @property
    def radius(self) -> float:
        """Of the circle whose quarter is as long as the meridian's, times the scale."""
        n = self.n
        return self.scale * self.on.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    def _origin(self) -> float:
        """The northing of the parallel of origin."""
        s, e = math.sin(math.radians(self.lat0)), 2 * math.sqrt(self.n) / (1 + self.n)
        x = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return self.radius * (x + sum(c * math.sin(2 * j * x) for j, c in enumerate(self._forward(), 1)))

    def _forward(self) -> tuple:
        n = self.n
        return (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)

    def _back(self) -> tuple:
        n = self.n
        return (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4)

    def forward(self, lon: Column, lat: Column) -> Column:
        """struct<x, y>."""
        e = 2 * math.sqrt(self.n) / (1 + self.n)

        def series(c: Column) -> Column:
            x, y = up, side = c["x"], c["y"]
            for j, k in enumerate(self._forward(), 1):
                up = up + k * F.sin(2 * j * x) * F.cosh(2 * j * y)
                side = side + k * F.cos(2 * j * x) * F.sinh(2 * j * y)
            return F.struct((self.easting + self.radius * side).alias("x"), (self.northing - self._origin() + self.radius * up).alias("y"))

        on_sphere = lambda a: let(lambda b: let(series, x=F.atan2(b["t"], F.cos(b["turn"])), y=F.atanh(F.sin(b["turn"]) / F.sqrt(1 + b["t"] * b["t"]))), t=F.sinh(F.atanh(a["s"]) - e * F.atanh(e * a["s"])), turn=a["turn"])
        return let(on_sphere, s=F.sin(F.radians(lat)), turn=F.radians(lon - self.lon0))

    def back(self, x: Column, y: Column) -> Column:
        """struct<x, y> of longitude and latitude."""
        n = self.n
        to_lat = (2 * n - 2 / 3 * n**2 - 2 * n**3 + 116 / 45 * n**4, 7 / 3 * n**2 - 8 / 5 * n**3 - 227 / 45 * n**4, 56 / 15 * n**3 - 136 / 35 * n**4, 4279 / 630 * n**4)

        def unseries(a: Column) -> Column:
            up, side = u, v = a["up"], a["side"]
            for j, k in enumerate(self._back(), 1):
                u = u - k * F.sin(2 * j * up) * F.cosh(2 * j * side)
                v = v - k * F.cos(2 * j * up) * F.sinh(2 * j * side)
            return let(place, u=u, v=v)

        def place(a: Column) -> Column:
            return let(latitude, conformal=F.asin(F.sin(a["u"]) / F.cosh(a["v"])), lon=self.lon0 + F.degrees(F.atan2(F.sinh(a["v"]), F.cos(a["u"]))))

        def latitude(a: Column) -> Column:
            lat = a["conformal"]
            for j, k in enumerate(to_lat, 1):
                lat = lat + k * F.sin(2 * j * a["conformal"])
            return F.struct(a["lon"].alias("x"), F.degrees(lat).alias("y"))

        return let(unseries, up=(y - self.northing + self._origin()) / self.radius, side=(x - self.easting) / self.radius)


def shifted(lon: Column, lat: Column, of: Ellipsoid, to: Ellipsoid, parameters: tuple, back: bool = False) -> Column:
    """struct<x, y>: places at height 0 on one datum's ellipsoid as places on another's. back: by the parameters with their signs turned, right to some centimetres."""
    p = [-v for v in parameters] if back else parameters
    (tx, ty, tz), (rx, ry, rz), m = p[:3], (math.radians(v / 3600) for v in p[3:6]), 1 + p[6] * 1e-6
    b = to.a * (1 - to.flattening)

    def geocentric(g: Column) -> Column:
        nu = of.a / F.sqrt(1 - of.e2 * g["s"] * g["s"])
        return let(moved, x=nu * g["c"] * F.cos(g["lon"]), y=nu * g["c"] * F.sin(g["lon"]), z=nu * (1 - of.e2) * g["s"])

    def moved(g: Column) -> Column:
        x, y, z = g["x"], g["y"], g["z"]
        return let(flat, x=tx + m * x - rz * y + ry * z, y=ty + rz * x + m * y - rx * z, z=tz - ry * x + rx * y + m * z)

    def flat(g: Column) -> Column:
        r = F.sqrt(g["x"] * g["x"] + g["y"] * g["y"])
        return let(lambda q: let(geographic, beta=F.atan2(q["z"] * to.a, q["r"] * b), r=q["r"], z=q["z"], lon=q["lon"]), r=r, z=g["z"], lon=F.atan2(g["y"], g["x"]))

    def geographic(g: Column) -> Column:
        # latitude from the geocentric place by Bowring's formula, exact to far below a millimetre near the ground
        lat2 = F.atan2(g["z"] + to.e2 / (1 - to.e2) * b * F.pow(F.sin(g["beta"]), 3), g["r"] - to.e2 * to.a * F.pow(F.cos(g["beta"]), 3))
        return F.struct(F.degrees(g["lon"]).alias("x"), F.degrees(lat2).alias("y"))

    return let(geocentric, s=F.sin(F.radians(lat)), c=F.cos(F.radians(lat)), lon=F.radians(lon))
