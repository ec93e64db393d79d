"""Queries on rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoline.operators import features, raster, raster_grid, raster_levels
from isoline.plans.collect import CELLS, STOPS, gradient_sql, register

SIZE = "size AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM cells)"


def _size(cells) -> tuple[int, int]:
    return tuple(cells.agg(F.max("x") + 1, F.max("y") + 1).first())


def _bands(spark, d):
    i = F.col("event_id")
    return features.read(spark, d, "events").select((i % 100).cast("int").alias("x"), F.floor(i / 100).cast("int").alias("y"), F.floor("value").cast("int").alias("v"), "user_id")


@register(f"WITH {CELLS} SELECT x, y, round((v + 7)*0.5::DOUBLE, 6) AS value FROM cells")
def raster_offset_scale(spark, d):
    c = raster.per_cell(raster.per_cell(features.raster(spark, d), raster.offset(7)), raster.scale(0.5))
    return c.select("x", "y", F.round("value", 6).alias("value"))


@register(f"WITH {CELLS}, s AS (SELECT min(v) AS m, max(v) AS t FROM cells) SELECT x, y, round(least(greatest(v, m + (t-m)*0.1::DOUBLE), t - (t-m)*0.2::DOUBLE), 6) AS value FROM cells, s")
def raster_clamp_extremes(spark, d):
    return raster.clamp_extremes(features.raster(spark, d), 0.1, 0.2).select("x", "y", F.round("value", 6).alias("value"))


def _levels_sql(table: str, n: int) -> str:
    """A table of n samples, given as SQL of k / (n - 1), read at (n + 0.5) v and interpolated."""
    return f"WITH {CELLS}, t AS (SELECT list_transform(range({n}), lambda k: {table.replace('$', f'(k/CAST({n - 1} AS DOUBLE))')}) AS q), p AS (SELECT x, y, v/500*({n} + 0.5::DOUBLE) AS p FROM cells), i AS (SELECT *, CAST(trunc(p) AS INTEGER) AS i FROM p, t) SELECT x, y, round(CASE WHEN i >= {n - 1} THEN q[{n}] ELSE q[i+1] + (q[i+2]-q[i+1])*(p-i) END, 8) AS value FROM i"


def _levelled(spark, d, values):
    f = raster_levels.apply(values)
    return raster.per_cell(features.raster(spark, d), lambda v: f(v / 500)).select("x", "y", F.round("value", 8).alias("value"))


@register(_levels_sql("floor($*4 + 0.5::DOUBLE)/4", 16))
def raster_levels_quantized(spark, d):
    return _levelled(spark, d, raster_levels.quantized(4, 16))


@register(_levels_sql("$", 32))
def raster_levels_identity(spark, d):
    return _levelled(spark, d, raster_levels.identity(32))


@register(_levels_sql("$*0.7::DOUBLE", 32))
def raster_levels_scaled(spark, d):
    return _levelled(spark, d, raster_levels.scaled(0.7, 32))


@register(_levels_sql("pow($, ln(0.3::DOUBLE)/ln(0.5::DOUBLE))", 32))
def raster_levels_midpoint(spark, d):
    return _levelled(spark, d, raster_levels.midpoint(0.3, 32))


@register(_levels_sql("greatest(0, least(1, 0.5::DOUBLE + ($ - 0.5::DOUBLE)*1.8::DOUBLE))", 32))
def raster_levels_contrast(spark, d):
    return _levelled(spark, d, raster_levels.scaled_and_clamped(0.5, 1.8, 32))



@register(f"WITH {CELLS} SELECT x - 20 AS x, y - 2 AS y, v AS value FROM cells WHERE x BETWEEN 20 AND 69 AND y BETWEEN 2 AND 7")
def raster_crop(spark, d):
    return raster_grid.crop(features.raster(spark, d), 20, 2, 50, 6).select("x", "y", "value")


_PAD = f"WITH {CELLS}, {SIZE}, g AS (SELECT CAST(a.range AS INTEGER) AS x, CAST(b.range AS INTEGER) AS y FROM range((SELECT w + 8 FROM size)) a, range((SELECT h + 5 FROM size)) b)"


@register(f"{_PAD} SELECT g.x, g.y, coalesce(v, -1) AS value FROM g LEFT JOIN cells c ON c.x = g.x - 5 AND c.y = g.y - 2")
def raster_pad_value(spark, d):
    c = features.raster(spark, d)
    return raster_grid.pad(c, _size(c), 2, 3, 3, 5, -1.0).select("x", "y", "value")


@register(f"{_PAD} SELECT g.x, g.y, v AS value FROM g, size JOIN cells c ON c.x = least(greatest(g.x - 5, 0), w - 1) AND c.y = least(greatest(g.y - 2, 0), h - 1)")
def raster_pad_edges(spark, d):
    c = features.raster(spark, d)
    return raster_grid.pad(c, _size(c), 2, 3, 3, 5).select("x", "y", "value")


@register(f"WITH {CELLS} SELECT x, y, round(coalesce(lead(v) OVER w - lag(v) OVER w, 0), 6) AS value FROM cells WINDOW w AS (PARTITION BY y ORDER BY x)")
def raster_convolve(spark, d):
    return raster.convolve(features.raster(spark, d), [-1.0, 0.0, 1.0], "x").select("x", "y", F.round("value", 6).alias("value"))


def _sharpen_sql(radius: float, amount: float) -> str:
    k = raster.gaussian_kernel(radius)
    taps = ", ".join(f"({i - len(k) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(k))
    step = lambda src, axis, other: f"SELECT c.x, c.y, sum(s.v * t.w) AS v FROM {src} c, taps t, size, {src} s WHERE s.{axis} = greatest(0, least({'size.w' if axis == 'x' else 'h'} - 1, c.{axis} + o)) AND s.{other} = c.{other} GROUP BY c.x, c.y"
    return f"WITH {CELLS}, taps(o, w) AS (VALUES {taps}), {SIZE}, f AS ({step('cells', 'x', 'y')}), g AS ({step('f', 'y', 'x')}) SELECT c.x, c.y, round((c.v - {amount}::DOUBLE*g.v)/(1 - {amount}::DOUBLE), 6) AS value FROM cells c JOIN g ON c.x = g.x AND c.y = g.y"


@register(_sharpen_sql(1.0, 0.5))
def raster_sharpen(spark, d):
    c = features.raster(spark, d)
    return raster.sharpen(c, 1.0, 0.5, *_size(c)).select("x", "y", F.round("value", 6).alias("value"))


@register("SELECT event_type AS raster_id, CAST(event_id % 100 AS INTEGER) AS x, CAST(event_id // 100 AS INTEGER) AS y, round(CASE WHEN user_id % 7 = 0 THEN -1 ELSE value - user_id END, 6) AS value FROM events")
def raster_combine(spark, d):
    """A raster for each event type, with some empty cells."""
    e = features.read(spark, d, "events").select(F.col("event_type").alias("raster_id"), (F.col("event_id") % 100).cast("int").alias("x"), F.floor(F.col("event_id") / 100).cast("int").alias("y"), "value", "user_id")
    b = e.select("raster_id", "x", "y", F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("double")).alias("value"))
    return raster.combine(e.drop("user_id"), b, lambda p, q: p - q).select("raster_id", "x", "y", F.round(F.coalesce("value", F.lit(-1.0)), 6).alias("value"))


@register(f"WITH {CELLS} SELECT x, y, CAST(least(greatest(round_even(v/500*255, 0), 0), 255) AS INTEGER) AS grey, CASE WHEN v < 50 THEN 0 ELSE 255 END AS alpha FROM (SELECT x, y, CASE WHEN v < 50 THEN -9999 ELSE v END AS v0, v FROM cells) WHERE v >= 50 UNION ALL SELECT x, y, 0, 0 FROM cells WHERE v < 50")
def raster_to_image(spark, d):
    c = features.raster(spark, d).withColumn("value", F.when(F.col("value") < 50, -9999.0).otherwise(F.col("value") / 500))
    grey, _, _, alpha = raster.to_image(F.col("value"), 255.0, -9999.0)
    return c.select("x", "y", grey.alias("grey"), alpha.alias("alpha"))


@register(f"WITH {CELLS}, b AS (SELECT x, y, CAST(floor(v) AS INTEGER) AS v FROM cells) SELECT x, y, round(CASE WHEN v % 5 = 0 THEN -9999 ELSE ((v % 256)*0.2126::DOUBLE + (v % 200)*0.7152::DOUBLE + (v % 100)*0.0722::DOUBLE)*(1/CAST(255 AS DOUBLE)) END, 6) AS value FROM b")
def raster_luminance(spark, d):
    v = F.col("v")
    return _bands(spark, d).select("x", "y", F.round(raster.to_single_band(v % 256, v % 200, v % 100, v % 5), 6).alias("value"))


@register(f"WITH {CELLS} SELECT x, y, CAST(trunc(r*255) AS INTEGER) AS r, CAST(trunc(g*255) AS INTEGER) AS g, CAST(trunc(b*255) AS INTEGER) AS b FROM (SELECT x, y, {gradient_sql(0)} AS r, {gradient_sql(1)} AS g, {gradient_sql(2)} AS b FROM (SELECT x, y, floor(v/5)/100 AS t FROM cells))".replace("round(CASE", "(CASE").replace(" END, 6)", " END)"))
def raster_gradient_map(spark, d):
    c = raster.gradient_map(F.floor(F.col("value") / 5) / F.lit(100.0), STOPS)
    return features.raster(spark, d).select("x", "y", *(k.alias(n) for k, n in zip(c, "rgb")))


@register(f"WITH {CELLS}, p AS (SELECT x, y, (CAST(floor(v) AS INTEGER) % 256)/CAST(255 AS DOUBLE) AS b, (CAST(floor(v) AS INTEGER) % 101)/CAST(255 AS DOUBLE) AS t, (CAST(floor(v) AS INTEGER) % 200)/CAST(255 AS DOUBLE) AS a FROM cells) SELECT x, y, CAST(trunc((t*a + b*0.8::DOUBLE*(1-a))*255) AS INTEGER) AS c, CAST(trunc((a + 0.8::DOUBLE*(1-a))*255) AS INTEGER) AS a FROM p")
def raster_blend_alpha(spark, d):
    v = F.col("v")
    c, _, _, a = raster.blend((v % 256, v % 256, v % 256, F.lit(204.0)), (v % 101, v % 101, v % 101, v % 200))
    return _bands(spark, d).select("x", "y", c.alias("c"), a.alias("a"))


@register(f"WITH {CELLS}, p AS (SELECT x, y, (CAST(floor(v) AS INTEGER) % 256)/CAST(255 AS DOUBLE) AS b, (CAST(floor(v) AS INTEGER) % 101)/CAST(255 AS DOUBLE) AS t FROM cells) SELECT x, y, CAST(trunc((1 - (1-b)*(1-t))*255) AS INTEGER) AS c FROM p")
def raster_blend_screen(spark, d):
    """A mode given as a function."""
    v = F.col("v")
    c, *_ = raster.blend((v % 256, v % 256, v % 256, F.lit(255.0)), (v % 101, v % 101, v % 101, F.lit(255.0)), lambda b, t: 1 - (1 - b) * (1 - t))
    return _bands(spark, d).select("x", "y", c.alias("c"))


@register(f"WITH {CELLS} SELECT x, y, v AS value FROM cells WHERE NOT (x BETWEEN 50 AND 59 AND y BETWEEN 2 AND 4) UNION ALL SELECT x + 40, y + 1, v FROM cells WHERE x BETWEEN 10 AND 19 AND y BETWEEN 1 AND 3")
def raster_mosaic(spark, d):
    c = features.raster(spark, d)
    return raster_grid.mosaic([(c, 0, 0), (raster_grid.crop(c, 10, 1, 10, 3), 50, 2)]).select("x", "y", "value")


@register(f"WITH {CELLS} SELECT CAST(x // 4 AS INTEGER) AS x, CAST(y // 4 AS INTEGER) AS y, round(avg(v), 6) AS value FROM cells GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY x // 4, y // 4"))
def raster_shrink(spark, d):
    return raster_grid.shrink(features.raster(spark, d), 4).select("x", "y", F.round("value", 6).alias("value"))


#: The raster lies at longitude 0 to 100 and latitude -40 to 40; the new grid has as many cells in spherical Mercator metres, and a margin.
_WARP = f"WITH {CELLS}, {SIZE}, e AS (SELECT w, h, -200000::DOUBLE AS x0, 11400000::DOUBLE AS x1, -5000000::DOUBLE AS y0, 5000000::DOUBLE AS y1 FROM size), g AS (SELECT CAST(a.range AS INTEGER) AS x, CAST(b.range AS INTEGER) AS y, degrees((x0 + (a.range + 0.5::DOUBLE)*((x1-x0)/w))/6378137)*(w/CAST(100 AS DOUBLE)) AS px, (40 - degrees(2*atan(exp((y1 - (b.range + 0.5::DOUBLE)*((y1-y0)/h))/6378137)) - pi()/2))*(h/CAST(80 AS DOUBLE)) AS py, w, h FROM e, range((SELECT w FROM size)) a, range((SELECT h FROM size)) b)"


def _warped(spark, d, method):
    c = features.raster(spark, d)
    w, h = _size(c)
    return raster_grid.warp(c, (0.0, 100.0, -40.0, 40.0), (w, h), 4326, (-200000.0, 11400000.0, -5000000.0, 5000000.0), (w, h), 3857, method).select("x", "y", F.round("value", 6).alias("value"))


@register(f"{_WARP} SELECT g.x, g.y, round(coalesce(v, -9999), 6) AS value FROM g LEFT JOIN cells c ON c.x = floor(px) AND c.y = floor(py)")
def raster_warp(spark, d):
    """The whole raster from degrees to spherical Mercator, nearest cell."""
    return _warped(spark, d, "nearest")


@register(f"{_WARP}, f AS (SELECT g.x, g.y, i.range AS i, j.range AS j, CASE WHEN i.range = 1 THEN px - 0.5 - floor(px - 0.5) ELSE 1 - (px - 0.5 - floor(px - 0.5)) END * CASE WHEN j.range = 1 THEN py - 0.5 - floor(py - 0.5) ELSE 1 - (py - 0.5 - floor(py - 0.5)) END AS wt, least(greatest(floor(px - 0.5) + i.range, 0), w - 1) AS cx, least(greatest(floor(py - 0.5) + j.range, 0), h - 1) AS cy, px BETWEEN 0 AND w AND py BETWEEN 0 AND h AS ok FROM g, range(2) i, range(2) j) SELECT f.x, f.y, round(CASE WHEN bool_and(ok AND v IS NOT NULL) THEN sum(v*wt) ELSE -9999 END, 6) AS value FROM f LEFT JOIN cells c ON c.x = cx AND c.y = cy GROUP BY f.x, f.y")
def raster_warp_bilinear(spark, d):
    return _warped(spark, d, "bilinear")


_TAP = "CASE WHEN abs({0}) < 1e-12 THEN 1 WHEN abs({0}) < 3 THEN (sin(pi()*{0})/(pi()*{0}))*(sin(pi()*{0}/3)/(pi()*{0}/3)) ELSE 0 END"


@register(f"{_WARP}, f AS (SELECT g.x, g.y, px - 0.5 - floor(px - 0.5) - i.range AS dx, py - 0.5 - floor(py - 0.5) - j.range AS dy, least(greatest(floor(px - 0.5) + i.range, 0), w - 1) AS cx, least(greatest(floor(py - 0.5) + j.range, 0), h - 1) AS cy, px BETWEEN 0 AND w AND py BETWEEN 0 AND h AS ok FROM g, range(-2, 4) i, range(-2, 4) j), k AS (SELECT *, ({_TAP.format('dx')})*({_TAP.format('dy')}) AS wt FROM f) SELECT k.x, k.y, round(CASE WHEN bool_and(ok AND v IS NOT NULL) THEN sum(v*wt)/sum(wt) ELSE -9999 END, 6) AS value FROM k LEFT JOIN cells c ON c.x = cx AND c.y = cy GROUP BY k.x, k.y")
def raster_warp_lanczos(spark, d):
    return _warped(spark, d, "lanczos")


@register(f"WITH {CELLS}, q AS (SELECT a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM cells a JOIN cells b ON b.x = a.x+1 AND b.y = a.y JOIN cells c ON c.x = a.x AND c.y = a.y+1 JOIN cells d ON d.x = a.x+1 AND d.y = a.y+1), t AS (SELECT least(a,b,c) AS lo, greatest(a,b,c) AS hi FROM q UNION ALL SELECT least(b,c,d), greatest(b,c,d) FROM q) SELECT CAST(e AS DOUBLE) AS elev, CAST(count(*) AS BIGINT) AS n FROM t, (SELECT range*100 AS e FROM range(7)) WHERE e > lo AND e <= hi GROUP BY e")
def raster_contours(spark, d):
    s = raster_grid.contour_segments(features.raster(spark, d), 100.0)
    return s.groupBy("elev").agg(F.count("*").alias("n"))
