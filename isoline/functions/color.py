"""Colours as columns in 0 .. 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    sixths = F.when(d == 0, F.lit(0.0)).when(top == r, F.pmod((g - b) / F.nullif(d, F.lit(0.0)), F.lit(6.0))).when(top == g, (b - r) / F.nullif(d, F.lit(0.0)) + 2).otherwise((r - g) / F.nullif(d, F.lit(0.0)) + 4)
    return sixths / 6, F.when(top == 0, F.lit(0.0)).otherwise(d / F.nullif(top, F.lit(0.0))), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """h = 1 is h = 0."""
    sixth = F.floor(h * 6)
    f, i = h * 6 - sixth, F.pmod(sixth, F.lit(6))
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    pick = lambda *six: F.element_at(F.array(*six), i.cast("int") + 1)
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def rgb_to_hsl(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light = (top + low) / 2
    s = F.when(top == low, F.lit(0.0)).otherwise(F.try_divide(top - low, F.when(light > 0.5, 2 - top - low).otherwise(top + low)))
    return rgb_to_hsv(r, g, b)[0], s, light


def hsl_to_rgb(h: Column, s: Column, light: Column) -> tuple[Column, Column, Column]:
    """Each channel is light - a * max(-1, min(k - 3, 9 - k, 1)) with k = (n + 12 h) mod 12 and n = 0, 8, 4."""
    a = s * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 12, F.lit(12.0))
        return light - a * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return channel(0), channel(8), channel(4)


def multiply(a: tuple, b: tuple) -> list[Column]:
    return [x * y for x, y in zip(a, b, strict=True)]


def lerp(a: tuple, b: tuple, t: Column) -> list[Column]:
    return [x + (y - x) * t for x, y in zip(a, b, strict=True)]


def from_hex(text: Column) -> list[Column]:
    """Channels r, g, b, a (0 .. 255) of the first #rgb, #rgba, #rrggbb or #rrggbbaa in a text; alpha defaults to 255. Other texts, and runs of 5 or 7 digits, give nulls."""
    digits = F.regexp_extract(text, "#([0-9A-Fa-f]{3,8})", 1)
    long = F.when(F.length(digits) < 5, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    full = F.when(F.length(digits).isin(3, 4, 6, 8), F.rpad(long, 8, "f"))
    return [F.conv(F.substring(full, 1 + 2 * k, 2), 16, 10).cast("int") for k in range(4)]


def gradient_samples(spark, stops: list, n: int):
    """n colours (i, t, r, g, b) at equal distances from the first to the last stop."""
    lo, hi = min(s[0] for s in stops), max(s[0] for s in stops)
    df = spark.range(n).select(F.col("id").alias("i"), (lo + F.col("id") * ((hi - lo) / max(n - 1, 1))).alias("t"))
    return df.select("i", "t", *(c.alias(k) for c, k in zip(gradient(F.col("t"), stops), "rgb", strict=True)))


def to_hex(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """#rrggbb from channels 0 .. 255, or #rrggbbaa where alpha is below 255."""
    two = lambda c: F.lower(F.lpad(F.hex(c.cast("int")), 2, "0"))
    return F.concat(F.lit("#"), *map(two, (r, g, b)), F.lit("") if a is None else F.when(a == 255, F.lit("")).otherwise(two(a)))


def gradient(v: Column, stops: list[tuple[float, tuple[float, float, float]]]) -> list[Column]:
    """Piecewise linear colour, clamped at the ends; no stops give black."""
    stops = sorted(stops)
    out = []
    for k in range(3):
        c = F.lit(float(stops[-1][1][k])) if stops else F.lit(0.0)
        for (p, a), (q, b) in reversed(list(zip(stops, stops[1:]))):
            c = F.when(v < q, a[k] + (v - p) * ((b[k] - a[k]) / (q - p)) if q > p else F.lit(float(b[k]))).otherwise(c)
        out.append(F.when(v <= stops[0][0], F.lit(float(stops[0][1][k]))).otherwise(c) if stops else c)
    return out
