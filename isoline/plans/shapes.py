"""Queries on vector features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from isoline.functions import algorithms, color, coords, crs, geometry, regions, text
from isoline.operators import dissolve, features, joins
from isoline.plans.collect import BOX, BXS, LNS, PTS, STOPS, gradient_sql, register
from isoline.render import canvas, labels, meets, svg
from isoline.sources import hyphenation, tiles
from isoline.sources.features import finish
from isoline.sources.graticule import graticule
from isoline.sources.steps import Steps
from isoline.sources.store import shared_folder, write_file

RINGS = "r AS (SELECT s_suppkey, CAST(s_suppkey*31 % 300 AS DOUBLE) AS x, CAST(s_suppkey*17 % 120 AS DOUBLE) AS y, CAST(s_nationkey+1 AS DOUBLE) AS w, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS h FROM supplier)"
RGB = "c AS (SELECT p_partkey, (p_partkey % 11)/CAST(10 AS DOUBLE) AS r, (p_partkey % 7)/CAST(6 AS DOUBLE) AS g, p_size/CAST(50 AS DOUBLE) AS b FROM part), k AS (SELECT *, greatest(r,g,b) AS t, least(r,g,b) AS m FROM c)"
#: A few patterns, enough to show the operator; lists of whole languages are read from files of the user's.
PATTERNS = ("1na", "n2at", "1tio", "2io", "1ti", "1ka", "l1l", "r1t", "n1t")


def _rgb(spark, d):
    k = F.col("p_partkey")
    return features.read(spark, d, "part").select("p_partkey", ((k % 11) / F.lit(10.0)).alias("r"), ((k % 7) / F.lit(6.0)).alias("g"), (F.col("p_size") / F.lit(50.0)).alias("b"))


def _point(x: float, y: float):
    return geometry.point(F.lit(x), F.lit(y))


@register(f"WITH {PTS} SELECT event_id, round(lon*3 - lat*4, 6) AS crossed, round(lon*4 + lat*3, 6) AS dotted, round(sqrt((lon-4)*(lon-4) + (lat-3)*(lat-3)), 6) AS distance, round(lon + (4-lon)*0.25::DOUBLE, 6) AS lx, round(abs((4-lon)*(10-lat) - (10-lon)*(3-lat))/2, 6) AS area FROM pts")
def vector_math(spark, d):
    p, q = geometry.point(F.col("lon"), F.col("lat")), _point(4.0, 3.0)
    return features.points(spark, d).select("event_id", F.round(coords.cross(p, q), 6).alias("crossed"), F.round(coords.dot(p, q), 6).alias("dotted"), F.round(coords.distance(p, q), 6).alias("distance"), F.round(coords.lerp(p, q, 0.25)["x"], 6).alias("lx"), F.round(coords.triangle_area(p, q, _point(10.0, 10.0)), 6).alias("area"))


@register(f"WITH {PTS}, t AS (SELECT event_id, lon, lat, least(greatest(((lon+50)*100 + (lat+20)*50)/CAST(12500 AS DOUBLE), 0), 1) AS t FROM pts) SELECT event_id, round(sqrt((lon+50-100*t)*(lon+50-100*t) + (lat+20-50*t)*(lat+20-50*t)), 6) AS distance FROM t")
def segment_distance(spark, d):
    p = geometry.point(F.col("lon"), F.col("lat"))
    return features.points(spark, d).select("event_id", F.round(coords.segment_distance(p, _point(-50.0, -20.0), _point(50.0, 30.0)), 6).alias("distance"))


@register(f"WITH {BXS}, t AS (SELECT p_partkey, xmin, ymin, xmax-xmin AS rx, ymax-ymin AS ry FROM bxs), u AS (SELECT *, (-180-xmin)*CAST(20 AS DOUBLE) - (-10-ymin)*CAST(360 AS DOUBLE) AS a, rx*20 - ry*360 AS den, (-180-xmin)*ry - (-10-ymin)*rx AS b FROM t) SELECT p_partkey, round(xmin + rx*a/den, 6) AS x, round(ymin + ry*a/den, 6) AS y FROM u WHERE den <> 0 AND a/den BETWEEN 0 AND 1 AND b/den BETWEEN 0 AND 1")
def segment_crossings(spark, d):
    at = coords.segment_intersection(geometry.point(F.col("xmin"), F.col("ymin")), geometry.point(F.col("xmax"), F.col("ymax")), _point(-180.0, -10.0), _point(180.0, 10.0))
    return features.boxes(spark, d).select("p_partkey", at.alias("p")).where("p is not null").select("p_partkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@register(f"WITH {LNS}, s AS (SELECT l_orderkey, n, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)), l AS (SELECT *, sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) AS len FROM s WHERE nx IS NOT NULL), c AS (SELECT *, sum(len) OVER (PARTITION BY l_orderkey ORDER BY n) AS upto, sum(len) OVER (PARTITION BY l_orderkey)/2 AS goal FROM l), f AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS k FROM c WHERE upto >= goal - 1e-9) SELECT l_orderkey, round(x + (nx-x)*CASE WHEN len = 0 THEN 0 ELSE (goal-upto+len)/len END, 5) + 0.0::DOUBLE AS mx, round(y + (ny-y)*CASE WHEN len = 0 THEN 0 ELSE (goal-upto+len)/len END, 5) + 0.0::DOUBLE AS my FROM f WHERE k = 1")
def line_midpoint(spark, d):
    m = features.lines(spark, d).select("l_orderkey", geometry.midpoint(F.col("c")).alias("p"))
    return m.select("l_orderkey", (F.round("p.x", 5) + F.lit(0.0)).alias("mx"), (F.round("p.y", 5) + F.lit(0.0)).alias("my"))


@register(f"WITH {LNS}, s AS (SELECT l_orderkey, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM v WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)), o AS (SELECT *, (ny-y)*0.5::DOUBLE/sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) AS dx, (x-nx)*0.5::DOUBLE/sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) AS dy FROM s WHERE nx <> x OR ny <> y) SELECT l_orderkey, CAST(2*count(*) AS BIGINT) AS n, round(sum(x + nx + 2*dx), 5) AS sx, round(sum(y + ny + 2*dy), 5) + 0.0::DOUBLE AS sy FROM o GROUP BY l_orderkey")
def line_offset(spark, d):
    o = features.lines(spark, d).where(F.size(F.array_distinct("c")) > 1).select("l_orderkey", geometry.offset_line(F.col("c"), 0.5).alias("c"))
    return o.select("l_orderkey", F.size("c").cast("bigint").alias("n"), F.round(F.aggregate("c", F.lit(0.0), lambda a, p: a + p["x"]), 5).alias("sx"), (F.round(F.aggregate("c", F.lit(0.0), lambda a, p: a + p["y"]), 5) + F.lit(0.0)).alias("sy"))


@register(f"WITH {RINGS} SELECT s_suppkey, CAST(9 AS BIGINT) AS n, round(w*h*7/8, 6) AS area FROM r")
def ring_chaikin(spark, d):
    s = features.rings(spark, d).select("s_suppkey", geometry.chaikin_closed(F.col("c")).alias("c"))
    return s.select("s_suppkey", F.size("c").cast("bigint").alias("n"), F.round(geometry.area(F.col("c")), 6).alias("area"))


@register(f"WITH {RINGS} SELECT s_suppkey, round(x + w/2, 6) AS cx, round(y + h/2, 6) AS cy, round(least(w/4, h/2), 6) AS distance FROM r")
def ring_centroid_distance(spark, d):
    c = F.col("c")
    at = geometry.centroid(c)
    x0, x1, y0, y1 = geometry.bounds(c)
    return features.rings(spark, d).select("s_suppkey", F.round(at["x"], 6).alias("cx"), F.round(at["y"], 6).alias("cy"), F.round(geometry.signed_distance(c, x0 + (x1 - x0) / 4, (y0 + y1) / 2), 6).alias("distance"))


@register(f"WITH {RINGS} SELECT s_suppkey, round(x + w/2, 6) AS px, round(y + h/2, 6) AS py, round(least(w, h)/2, 6) AS distance FROM r")
def ring_pole(spark, d):
    p = features.spread(features.rings(spark, d)).select("s_suppkey", algorithms.pole_of_inaccessibility(F.array("c")).alias("p"))
    return p.select("s_suppkey", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), F.round("p.distance", 6).alias("distance"))


@register("SELECT c_custkey, round(12*sin(2*pi()/24)*(c_nationkey+1)*(c_nationkey+1), 6) AS area, CAST(25 AS BIGINT) AS n FROM customer")
def point_buffer(spark, d):
    c = features.read(spark, d, "customer").select("c_custkey", geometry.circle(F.col("c_custkey") % 360, F.col("c_custkey") % 170, F.col("c_nationkey") + 1).alias("c"))
    return c.select("c_custkey", F.round(geometry.area(F.col("c")), 6).alias("area"), F.size("c").cast("bigint").alias("n"))


_POINTS = "s AS (SELECT l_orderkey, list({'x': x, 'y': y} ORDER BY n) AS p FROM v GROUP BY l_orderkey HAVING count(*) >= 2)"
_LENGTH = "list_sum(list_transform(range(1, len(q)), lambda i: sqrt((q[i+1].x-q[i].x)*(q[i+1].x-q[i].x) + (q[i+1].y-q[i].y)*(q[i+1].y-q[i].y))))"


@register(f"WITH RECURSIVE {LNS}, {_POINTS}, g AS (SELECT l_orderkey, p, 1::BIGINT AS a, len(p)::BIGINT AS b FROM s UNION ALL SELECT l_orderkey, p, unnest([a, m]), unnest([m, b]) FROM (SELECT *, a + list_position(off, list_max(off)) AS m FROM (SELECT l_orderkey, p, a, b, list_transform(range(a + 1, b), lambda i: round(sqrt(pow(p[i].x - p[a].x - greatest(0, least(1, ((p[i].x-p[a].x)*(p[b].x-p[a].x) + (p[i].y-p[a].y)*(p[b].y-p[a].y))/nullif(pow(p[b].x-p[a].x, 2) + pow(p[b].y-p[a].y, 2), 0)))*(p[b].x-p[a].x), 2) + pow(p[i].y - p[a].y - greatest(0, least(1, ((p[i].x-p[a].x)*(p[b].x-p[a].x) + (p[i].y-p[a].y)*(p[b].y-p[a].y))/nullif(pow(p[b].x-p[a].x, 2) + pow(p[b].y-p[a].y, 2), 0)))*(p[b].y-p[a].y), 2)), 9)) AS off FROM g WHERE b - a > 1) WHERE list_max(off) > 2.1234567)), w AS (SELECT DISTINCT l_orderkey, p, unnest([a, b]) AS k FROM g), k AS (SELECT l_orderkey, list(p[k] ORDER BY k) AS q FROM w GROUP BY l_orderkey) SELECT l_orderkey, CAST(len(q) AS BIGINT) AS n, round({_LENGTH}, 6) AS length FROM k")
def line_simplify(spark, d):
    """Splitting at the vertex farthest from the chord, down to a tolerance that no whole-numbered vertex meets exactly."""
    s = features.lines(spark, d).select("l_orderkey", algorithms.douglas_peucker(F.col("c"), tolerance=2.1234567).alias("q"))
    return s.select("l_orderkey", F.size("q").cast("bigint").alias("n"), F.round(geometry.length(F.col("q")), 6).alias("length"))


@register(f"WITH RECURSIVE {LNS}, {_POINTS}, g AS (SELECT l_orderkey, p FROM s UNION ALL SELECT l_orderkey, list_concat(p[1:k], p[k+2:]) FROM (SELECT l_orderkey, p, list_position(t, list_min(t)) AS k FROM (SELECT l_orderkey, p, list_transform(range(2, len(p)), lambda i: abs((p[i].x-p[i-1].x)*(p[i+1].y-p[i-1].y) - (p[i+1].x-p[i-1].x)*(p[i].y-p[i-1].y))/2) AS t FROM g WHERE len(p) > 4))) SELECT l_orderkey, CAST(len(q) AS BIGINT) AS n, round({_LENGTH}, 6) AS length FROM (SELECT l_orderkey, p AS q FROM g WHERE len(p) <= 4)")
def line_simplify_by_area(spark, d):
    """Removal of the smallest triangle, down to four vertices."""
    s = features.lines(spark, d).select("l_orderkey", algorithms.visvalingam_whyatt(F.col("c"), 4).alias("q"))
    return s.select("l_orderkey", F.size("q").cast("bigint").alias("n"), F.round(geometry.length(F.col("q")), 6).alias("length"))


@register(f"WITH {LNS} SELECT l_orderkey, min(x) AS first_x, max(x) AS last_x, true AS smooth, true AS shorter FROM v GROUP BY l_orderkey HAVING count(*) >= 2")
def line_smooth_adaptive(spark, d):
    """Invariants: ends stay, no turn is above twice the limit, and cutting corners never lengthens a line."""
    s = features.lines(spark, d).select("l_orderkey", "c", algorithms.chaikin_adaptive(F.col("c"), 20.0).alias("q"))
    n = F.size("q")
    turn = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.when(n < 3, F.lit(0.0)).otherwise(F.coalesce(F.nanvl(coords.deflection(F.get("q", i - 1), F.get("q", i), F.get("q", i + 1)), F.lit(0.0)), F.lit(0.0))))
    return s.select("l_orderkey", F.col("q")[0]["x"].alias("first_x"), F.element_at("q", -1)["x"].alias("last_x"), (F.array_max(turn) <= math.radians(40) + 1e-6).alias("smooth"), (geometry.length(F.col("q")) <= geometry.length(F.col("c")) + 1e-9).alias("shorter"))


@register(f"WITH {LNS} SELECT l_orderkey, 'M ' || string_agg(printf('%.3f %.3f', x, y), ' L ' ORDER BY n) || CASE WHEN first(x ORDER BY n) = last(x ORDER BY n) AND first(y ORDER BY n) = last(y ORDER BY n) THEN ' Z' ELSE '' END AS path FROM v GROUP BY l_orderkey HAVING count(*) >= 2")
def svg_paths(spark, d):
    return features.lines(spark, d).select("l_orderkey", geometry.svg_path(F.col("c")).alias("path"))


@register(f"WITH {PTS}, {BXS} SELECT event_id FROM pts WHERE NOT EXISTS (SELECT 1 FROM bxs WHERE lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax)")
def points_outside_boxes(spark, d):
    return joins.points_in_boxes(features.points(spark, d).select("event_id", "lon", "lat"), features.boxes(spark, d), "lon", "lat", BOX, how="left_anti", dense=20_000).select("event_id")


def _world_sql(body: str) -> str:
    return f"WITH {PTS}, t AS (SELECT event_id, radians(lon) AS l, lat, abs(lat)/90 AS s FROM pts), {body}"


@register(_world_sql(f"k AS (SELECT *, CAST(least(floor(abs(lat)/5), 17) AS INTEGER) AS k, {list(crs.ROBINSON_X)}::DOUBLE[] AS xs, {list(crs.ROBINSON_Y)}::DOUBLE[] AS ys FROM t), f AS (SELECT *, abs(lat)/5 - k AS f FROM k) SELECT event_id, round(l*(xs[k+1] + (xs[k+2]-xs[k+1])*f)*(0.8487::DOUBLE*6378137), 3) + 0.0::DOUBLE AS rx, round(sign(lat)*(ys[k+1] + (ys[k+2]-ys[k+1])*f)*(1.3523::DOUBLE*6378137), 3) + 0.0::DOUBLE AS ry FROM f"))
def robinson(spark, d):
    x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, crs.ROBINSON)
    return features.points(spark, d).select("event_id", (F.round(x, 3) + F.lit(0.0)).alias("rx"), (F.round(y, 3) + F.lit(0.0)).alias("ry"))


@register(f"WITH {PTS}, t AS (SELECT event_id, lon, lat, abs(radians(lon)) AS l, asin(abs(2*radians(lat)/pi())) AS th FROM pts), g AS (SELECT *, abs(pi()/nullif(l, 0) - l/pi())/2 AS a, cos(th)/nullif(sin(th) + cos(th) - 1, 0) AS g FROM t), p AS (SELECT *, g*(2/nullif(sin(th), 0) - 1) AS p, a*a + g AS q FROM g) SELECT event_id, round(sign(lon)*6378137*CASE WHEN lat = 0 THEN l WHEN lon = 0 THEN 0 ELSE pi()*(a*(g-p*p) + sqrt(greatest(0, a*a*(g-p*p)*(g-p*p) - (p*p+a*a)*(g*g-p*p))))/(p*p+a*a) END, 1) + 0.0::DOUBLE AS vx, round(sign(lat)*6378137*CASE WHEN lat = 0 THEN 0 WHEN lon = 0 THEN pi()*tan(th/2) ELSE pi()*abs(p*q - a*sqrt(greatest(0, (a*a+1)*(p*p+a*a) - q*q)))/(p*p+a*a) END, 1) + 0.0::DOUBLE AS vy FROM p")
def van_der_grinten(spark, d):
    x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, crs.VAN_DER_GRINTEN)
    return features.points(spark, d).select("event_id", (F.round(x, 1) + F.lit(0.0)).alias("vx"), (F.round(y, 1) + F.lit(0.0)).alias("vy"))


@register(f"WITH {PTS} SELECT event_id, round(lon, 6) + 0.0::DOUBLE AS lon, round(lat, 6) + 0.0::DOUBLE AS lat FROM pts")
def van_der_grinten_round_trip(spark, d):
    """There and back again: the SQL is the input."""
    v = crs.VAN_DER_GRINTEN
    x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, v)
    a, b = crs.transform_xy(F.col("vx"), F.col("vy"), v, 4326)
    return features.points(spark, d).select("event_id", x.alias("vx"), y.alias("vy")).select("event_id", (F.round(a, 6) + F.lit(0.0)).alias("lon"), (F.round(b, 6) + F.lit(0.0)).alias("lat"))


@register(f"WITH {BXS} SELECT p_partkey, round(6378137*radians(xmin), 3) + 0.0::DOUBLE AS x0, round(6378137*radians(xmax), 3) + 0.0::DOUBLE AS x1, round(6378137*ln(tan(pi()/4 + radians(ymin)/2)), 3) + 0.0::DOUBLE AS y0, round(6378137*ln(tan(pi()/4 + radians(least(ymax, 89))/2)), 3) + 0.0::DOUBLE AS y1 FROM bxs")
def bbox_transform(spark, d):
    """Boxes that reach the pole, where the projection has no value, are cut at 89 degrees."""
    out = crs.transform_box(("xmin", "xmax", "ymin", F.least(F.col("ymax"), F.lit(89.0))), 4326, 3857)
    return features.boxes(spark, d).select("p_partkey", *((F.round(v, 3) + F.lit(0.0)).alias(n) for v, n in zip(out, ("x0", "x1", "y0", "y1"), strict=True)))


@register(f"WITH {RGB} SELECT p_partkey, round((CASE WHEN t = m THEN 0 WHEN t = r THEN CASE WHEN g < b THEN (g-b)/(t-m) + 6 ELSE (g-b)/(t-m) END WHEN t = g THEN (b-r)/(t-m) + 2 ELSE (r-g)/(t-m) + 4 END)/6, 6) AS h, round(CASE WHEN t = m THEN 0 WHEN (t+m)/2 > 0.5 THEN (t-m)/(2-t-m) ELSE (t-m)/(t+m) END, 6) AS s, round((t+m)/2, 6) AS l, round(r, 6) + 0.0::DOUBLE AS r, round(g, 6) + 0.0::DOUBLE AS g, round(b, 6) + 0.0::DOUBLE AS b FROM k")
def color_hsl(spark, d):
    """HSL and back."""
    out = _rgb(spark, d)
    h, s, light = color.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))
    out = out.select("p_partkey", h.alias("h"), s.alias("s"), light.alias("l"))
    back = color.hsl_to_rgb(F.col("h"), F.col("s"), F.col("l"))
    return out.select("p_partkey", *(F.round(k, 6).alias(k) for k in "hsl"), *((F.round(v, 6) + F.lit(0.0)).alias(n) for v, n in zip(back, "rgb", strict=True)))


@register(f"WITH {RGB} SELECT p_partkey, round((CASE WHEN t = m THEN 0 WHEN t = r THEN CASE WHEN g < b THEN (g-b)/(t-m) + 6 ELSE (g-b)/(t-m) END WHEN t = g THEN (b-r)/(t-m) + 2 ELSE (r-g)/(t-m) + 4 END)/6, 6) AS h, round(t, 6) AS v, round(CASE WHEN t = 0 THEN 0 ELSE (t-m)/t END, 6) AS s, round(r, 6) + 0.0::DOUBLE AS r, round(g, 6) + 0.0::DOUBLE AS g, round(b, 6) + 0.0::DOUBLE AS b FROM k")
def color_hsv(spark, d):
    """HSV and back."""
    h, s, v = color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    out = _rgb(spark, d).select("p_partkey", h.alias("h"), s.alias("s"), v.alias("v"))
    back = color.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v"))
    return out.select("p_partkey", F.round("h", 6).alias("h"), F.round("v", 6).alias("v"), F.round("s", 6).alias("s"), *((F.round(x, 6) + F.lit(0.0)).alias(n) for x, n in zip(back, "rgb", strict=True)))


@register("SELECT p_partkey, CAST(p_size*5 AS INTEGER) AS r, CAST(p_partkey % 256 AS INTEGER) AS g, 10 AS b, 255 AS a FROM part")
def color_parse(spark, d):
    t = features.read(spark, d, "part").select("p_partkey", color.to_hex(F.col("p_size") * 5, F.col("p_partkey") % 256, F.lit(10)).alias("t"))
    return t.select("p_partkey", *(c.alias(n) for c, n in zip(color.from_hex(F.col("t")), "rgba", strict=True)))


@register(f"SELECT event_id, round(t, 6) AS t, {gradient_sql(0)} AS r, {gradient_sql(1)} AS g, {gradient_sql(2)} AS b FROM (SELECT event_id, least(20, greatest(0, CAST(floor(value/25) AS BIGINT)))*(1/CAST(20 AS DOUBLE)) AS t FROM events)")
def gradient_samples(spark, d):
    """Each event's value in the nearest of 21 colours below it."""
    samples = color.gradient_samples(spark, STOPS, 21)
    e = features.read(spark, d, "events").select("event_id", F.least(F.lit(20), F.greatest(F.lit(0), F.floor(F.col("value") / 25))).alias("i"))
    return e.join(F.broadcast(samples), "i").select("event_id", F.round("t", 6).alias("t"), *(F.round(k, 6).alias(k) for k in "rgb"))


@register("SELECT page_id, split_part(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/', -1) AS name, upper(substr(md5(url), 1, 8)) AS digest FROM pages")
def url_names(spark, d):
    return features.read(spark, d, "pages").select("page_id", text.url_file_name(F.col("url")).alias("name"), text.short_md5(F.col("url")).alias("digest"))


@register("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_attribute(spark, d):
    return features.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@register("WITH pat(letters, off, digit) AS (VALUES ('na', 0, 1), ('nat', 1, 2), ('tio', 0, 1), ('io', 0, 2), ('ti', 0, 1), ('ka', 0, 1), ('ll', 1, 1), ('rt', 1, 1), ('nt', 1, 1)), w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS k FROM part), c AS (SELECT p_partkey, k, w, unnest(range(length(w))) AS i FROM w), v AS (SELECT p_partkey, k, w, i, max(CASE WHEN substr('.' || lower(w) || '.', i + 2 - off, length(letters)) = letters THEN digit ELSE 0 END) AS digit FROM c, pat GROUP BY ALL), h AS (SELECT p_partkey, k, string_agg(CASE WHEN i BETWEEN 2 AND length(w) - 3 AND digit % 2 = 1 THEN '|' ELSE '' END || substr(w, i + 1, 1), '' ORDER BY i) AS h FROM v GROUP BY p_partkey, k) SELECT p_partkey, string_agg(h, ' ' ORDER BY k) AS name FROM h GROUP BY p_partkey".replace("GROUP BY ALL", "GROUP BY p_partkey, k, w, i"))
def hyphenate_names(spark, d):
    return features.read(spark, d, "part").select("p_partkey", algorithms.hyphenate(F.col("p_name"), PATTERNS).alias("name"))


_LISTS = {
    "en": (["1na", "2io", "1ti", "er1", "th2e", "1s2h", "o1n", ".an1", "ed."], ["the-re", "a-nd"]),
    "de": (["1ch", "ei1n", "s2ch", "1zu", "u1ng", ".ver1", "1be"], ["ni-cht"]),
    "fr": (["1tion", "me2n", "1la", "o1i", "2que.", "1\u00e9"], []),
    "es": (["1ci", "o1s", "2\u00f3n", "l2l", "1ra", "1lla"], []),
}


@register("""WITH pat(lang, letters, off, digit) AS (VALUES ('en', 'na', 0, 1), ('en', 'io', 0, 2), ('en', 'ti', 0, 1), ('en', 'er', 2, 1), ('en', 'the', 2, 2), ('en', 'sh', 0, 1), ('en', 'sh', 1, 2), ('en', 'on', 1, 1), ('en', '.an', 3, 1),
('de', 'ch', 0, 1), ('de', 'ein', 2, 1), ('de', 'sch', 1, 2), ('de', 'zu', 0, 1), ('de', 'ung', 1, 1), ('de', '.ver', 4, 1), ('de', 'be', 0, 1),
('fr', 'tion', 0, 1), ('fr', 'men', 2, 2), ('fr', 'la', 0, 1), ('fr', 'oi', 1, 1), ('fr', 'que.', 0, 2), ('fr', '\u00e9', 0, 1),
('es', 'ci', 0, 1), ('es', 'os', 1, 1), ('es', '\u00f3n', 0, 2), ('es', 'll', 1, 2), ('es', 'ra', 0, 1), ('es', 'lla', 0, 1)),
w AS (SELECT DISTINCT lang, unnest(string_split_regex(text, '[^\\p{L}]+')) AS word FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')),
p AS (SELECT lang, word, '.' || lower(word) || '.' AS t FROM w WHERE word <> ''),
c AS (SELECT lang, word, t, unnest(range(length(word))) AS i FROM p),
v AS (SELECT c.lang, word, i, max(CASE WHEN substr(t, i + 2 - off, length(letters)) = letters AND i + 2 - off >= 1 THEN digit ELSE 0 END) AS digit FROM c JOIN pat ON pat.lang = c.lang GROUP BY c.lang, word, i),
h AS (SELECT lang, word, string_agg(CASE WHEN i BETWEEN 2 AND length(word) - 3 AND digit % 2 = 1 THEN '|' ELSE '' END || substr(word, i + 1, 1), '' ORDER BY i) AS parted FROM v GROUP BY lang, word)
SELECT lang, word, CASE WHEN lang = 'en' AND lower(word) = 'there' THEN word[1:3] || '|' || word[4:] WHEN lang = 'en' AND lower(word) = 'and' THEN word[1:1] || '|' || word[2:] WHEN lang = 'de' AND lower(word) = 'nicht' THEN word[1:2] || '|' || word[3:] ELSE parted END AS parted FROM h""")
def hyphenate_documents(spark, d):
    """Every word of the documents by the lists of its language, which are read from a folder of files."""
    folder = shared_folder(spark)
    for language, lists in _LISTS.items():
        for kind, lines in zip(("pat", "hyp"), lists, strict=True):
            write_file(f"{folder}/hyph-{language}.{kind}.txt", "\n".join(lines).encode())
    lists = hyphenation.read_hyphenation(spark, folder)
    words = features.read(spark, d, "documents").where(F.col("lang").isin(*_LISTS)).select("lang", F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where("word <> ''").distinct()
    return words.select("lang", "word", hyphenation.hyphenate_by(F.col("word"), F.col("lang"), lists).alias("parted"))


@register(f"WITH {BXS}, g AS (SELECT 'Latitude' AS name, -90 + 5*range::DOUBLE AS place, -25::DOUBLE AS low, 20::DOUBLE AS high FROM range(21) UNION ALL SELECT 'Longitude', -180 + 10*range::DOUBLE, -12.5::DOUBLE, 10::DOUBLE FROM range(21)), m AS (SELECT name, place, p_partkey FROM g JOIN bxs ON CASE WHEN name = 'Latitude' THEN ymin < place AND place < ymax AND xmin < high AND low < xmax ELSE xmin < place AND place < xmax AND ymin < high AND low < ymax END) SELECT name, printf('%.3f', place) AS value, CAST(10 AS BIGINT) AS n, low, CAST((SELECT count(*) FROM m WHERE m.name = g.name AND m.place = g.place) AS BIGINT) AS boxes FROM g")
def graticule_lines(spark, d):
    """Parallels and meridians, and how many parts' boxes each crosses."""
    g = graticule(spark, (-20, 20, -10, 10), 10, 5, segments=2)
    t = F.col("tags")[0]
    lines = g.select("feature_id", t["key"].alias("name"), t["value"].alias("value"), F.size(F.col("parts")[0]).cast("bigint").alias("n"), F.when(t["key"] == "Latitude", F.col("xmin")).otherwise(F.col("ymin")).alias("low"), *(F.col(c).alias(f"g_{c}") for c in ("xmin", "xmax", "ymin", "ymax")))
    crossed = joins.bbox_join(lines, features.boxes(spark, d), ("g_xmin", "g_xmax", "g_ymin", "g_ymax"), ("xmin", "xmax", "ymin", "ymax"))
    found = crossed.groupBy("feature_id").agg(F.count("*").alias("boxes"))
    return lines.join(found, "feature_id", "left").select("name", "value", "n", "low", F.coalesce("boxes", F.lit(0)).cast("bigint").alias("boxes"))


@register(f"WITH {BXS} SELECT CASE WHEN tx < 0 AND ty >= 0 THEN printf('n%02dw%03d', CAST(ty+1 AS INTEGER), CAST(-tx AS INTEGER)) ELSE 'unnamed' END AS tile, CAST(count(*) AS BIGINT) AS n FROM (SELECT tx, unnest(range(CAST(floor(ymin) AS BIGINT), CAST(ceil(ymax) AS BIGINT))) AS ty FROM (SELECT *, unnest(range(CAST(floor(xmin) AS BIGINT), CAST(ceil(xmax) AS BIGINT))) AS tx FROM bxs)) GROUP BY 1")
def tile_names(spark, d):
    return tiles.cover(features.boxes(spark, d)).groupBy(F.coalesce(tiles.usgs_name(F.col("tx"), F.col("ty")), F.lit("unnamed")).alias("tile")).agg(F.count("*").alias("n"))


@register(f"WITH {PTS} SELECT event_id, round((lon+180)*(1000/CAST(360 AS DOUBLE)), 6) AS cx, round((lat+90)*(1000/CAST(360 AS DOUBLE)) + 250, 6) AS cy FROM pts")
def canvas_center(spark, d):
    f = canvas.fit((-180, 180, -90, 90), 1000, 1000, "center")
    return features.points(spark, d).select("event_id", F.round(F.col("lon") * f.scale_x + f.offset_x, 6).alias("cx"), F.round(F.col("lat") * f.scale_y + f.offset_y, 6).alias("cy"))


#: What the boxes of a part's label are computed from.
_PART = ["cx", "cy", "w", "h"]


def _labels_of_parts(spark, d):
    """One map a brand, a label a part: (map_id, seq, and the columns that its places are computed from)."""
    p = features.boxes(spark, d).join(features.read(spark, d, "part").select("p_partkey", "p_brand", "p_name"), "p_partkey")
    w, h = labels.text_size(F.col("p_name"), 1.0)
    return p.select(F.col("p_brand").alias("map_id"), F.col("p_partkey").alias("seq"), ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"), w.alias("w"), h.alias("h"))


def _placed_and_checked(offers, same, boxes):
    """Places labels (map_id, seq and the columns `same`, which boxes is a function of), and counts what is wrong by map: (map_id, n, overlaps, unjust).

    Labels of one place and choice passed over the same boxes, so these are met once with the placed labels: for the first label that passed them over. Only
    boxes that this one should not have passed over are met for every label.
    """
    steps = Steps(offers.sparkSession)
    found = steps.keep(offers.join(labels.place(offers, boxes=boxes, same=same).select("seq", "choice"), "seq"))
    box = ("x0", "x1", "y0", "y1")
    taken = steps.keep(found.where("choice >= 0").select("map_id", "seq", F.get(boxes, F.col("choice")).alias("b")).select("map_id", "seq", *(F.col(f"b.{s}").alias(s) for s in box)))
    rivals = taken.select(F.col("map_id").alias("a_map"), F.col("seq").alias("a_key"), *(F.col(s).alias(f"a{s}") for s in box))
    overlaps = joins.bbox_join(taken, rivals, box, tuple(f"a{s}" for s in box), 4.0, same=("map_id", "a_map")).where("seq <> a_key").groupBy("map_id").agg(F.count("*").alias("overlaps"))
    alike = steps.keep(found.groupBy("map_id", *same, "choice").agg(F.count("*").alias("labels"), F.min("seq").alias("first")))
    passed = F.when(F.col("choice") < 0, boxes).otherwise(F.slice(boxes, 1, F.greatest("choice", F.lit(0))))
    doubtful = steps.keep(meets.passed_over(alike.where("choice <> 0"), passed, taken).distinct())
    n = alike.groupBy("map_id").agg(F.sum("labels").alias("n"))
    out = n.join(overlaps, "map_id", "left")
    if doubtful.isEmpty():
        out = out.withColumn("unjust", F.lit(0))
    else:
        over = found.withColumn("b", F.explode(passed)).select("map_id", "seq", *(F.col(f"b.{s}").alias(s) for s in box))
        unjust = over.join(doubtful, ["map_id", *box]).where("rival is null or rival >= seq").groupBy("map_id").agg(F.count("*").alias("unjust"))
        out = out.join(unjust, "map_id", "left")
    return out.select("map_id", "n", F.coalesce("overlaps", F.lit(0)).cast("bigint").alias("overlaps"), F.coalesce("unjust", F.lit(0)).cast("bigint").alias("unjust"))


@register("SELECT 1 AS map_id, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS unjust FROM events")
def label_placement_one_map(spark, d):
    """All events in one map, a box each with eight places."""
    boxes = labels.candidates(F.col("lon"), F.col("lat"), F.lit(1.5), F.lit(0.5), F.lit(0.1), True)
    return _placed_and_checked(features.points(spark, d).select(F.lit(1).alias("map_id"), F.col("event_id").alias("seq"), "lon", "lat"), ["lon", "lat"], boxes)


@register("SELECT p_brand AS map_id, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS overlaps, CAST(0 AS BIGINT) AS unjust FROM part GROUP BY p_brand")
def label_placement(spark, d):
    """First fit, held to what defines it: placed labels do not overlap, and each place that a label passed over overlaps a label placed before it."""
    boxes = labels.candidates(*map(F.col, _PART), F.lit(0.3), False)
    return _placed_and_checked(_labels_of_parts(spark, d), _PART, boxes)


@register()
def draw_map(spark, d):
    tags = F.array(F.struct(F.lit("name").alias("key"), F.col("s_suppkey").cast("string").alias("value")))
    rings = finish(features.rings(spark, d).select(F.col("s_suppkey").alias("feature_id"), F.lit("polygon").alias("geom_type"), F.array("c").alias("parts"), tags.alias("tags")))
    m = svg.Map((0, 330, 0, 130), 1000, 500, layers=[svg.Layer("areas", "rings", svg.Style(fill="#ffeecc", stroke="#000000")), svg.Layer("names", "rings", svg.Style(symbol_radius=1.5, fill="#ff0000", label_tag="name", label_size=8))])
    return svg.draw(m, {"rings": (rings, 4326)})


_KRUEGER = "WITH $PTS, k AS (SELECT 1/298.257223563::DOUBLE AS f), c AS (SELECT f/(2-f) AS n FROM k), g AS (SELECT event_id, radians((lon + 180)/60 - 3) AS d, radians(abs(lat)/85*84) AS p, n, 2*sqrt(n)/(1+n) AS e FROM pts, c), h AS (SELECT *, sinh(atanh(sin(p)) - e*atanh(e*sin(p))) AS t FROM g), x AS (SELECT event_id, n, atan2(t, cos(d)) AS u, atanh(sin(d)/sqrt(1+t*t)) AS v FROM h), s AS (SELECT event_id, n, u, v, [n/2 - n*n*2/3 + n*n*n*5/16 + n*n*n*n*41/180, n*n*13/48 - n*n*n*3/5 + n*n*n*n*557/1440, n*n*n*61/240 - n*n*n*n*103/140, n*n*n*n*49561/161280] AS a FROM x)".replace("$PTS", PTS)


def _in_zone(spark, d):
    """All events, their places drawn together to zone 33."""
    return features.points(spark, d).select("event_id", ((F.col("lon") + 180) / 60 + 12).alias("lon"), (F.abs("lat") / 85 * 84).alias("lat"))


@register(f"{_KRUEGER}, o AS (SELECT event_id, 0.9996::DOUBLE*6378137/(1+n)*(1 + n*n/4 + n*n*n*n/64) AS r, u + a[1]*sin(2*u)*cosh(2*v) + a[2]*sin(4*u)*cosh(4*v) + a[3]*sin(6*u)*cosh(6*v) + a[4]*sin(8*u)*cosh(8*v) AS north, v + a[1]*cos(2*u)*sinh(2*v) + a[2]*cos(4*u)*sinh(4*v) + a[3]*cos(6*u)*sinh(6*v) + a[4]*cos(8*u)*sinh(8*v) AS east FROM s) SELECT event_id, round(500000 + r*east, 3) + 0.0::DOUBLE AS e, round(r*north, 3) + 0.0::DOUBLE AS n FROM o")
def utm_zone(spark, d):
    x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, crs.srid("EPSG:32633"))
    return _in_zone(spark, d).select("event_id", (F.round(x, 3) + F.lit(0.0)).alias("e"), (F.round(y, 3) + F.lit(0.0)).alias("n"))


@register(f"WITH {PTS} SELECT event_id, round((lon+180)/60 + 12, 7) + 0.0::DOUBLE AS lon, round(abs(lat)/85*84, 7) + 0.0::DOUBLE AS lat, round((lon+180)/60 - 6, 5) + 0.0::DOUBLE AS b_lon, round(50 + abs(lat)/10, 5) + 0.0::DOUBLE AS b_lat FROM pts")
def grids_round_trip(spark, d):
    """UTM and the British grid (a datum shift and its turned signs, right to centimetres) there and back: the SQL is the input."""
    back = lambda x, y, n: crs.transform_xy(*crs.transform_xy(x, y, 4326, n), n, 4326)
    p = features.points(spark, d).select("event_id", ((F.col("lon") + 180) / 60).alias("u"), F.abs("lat").alias("v"))
    x, y = back(F.col("u") + 12, F.col("v") / 85 * 84, 32633)
    bx, by = back(F.col("u") - 6, 50 + F.col("v") / 10, crs.BRITISH)
    near = lambda c, want: F.when(F.abs(c - want) < 1e-6, want).otherwise(c)  # noqa: E731  a tenth of a metre
    return p.select("event_id", *((F.round(c, n) + F.lit(0.0)).alias(k) for c, n, k in ((x, 7, "lon"), (y, 7, "lat"), (near(bx, F.col("u") - 6), 5, "b_lon"), (near(by, 50 + F.col("v") / 10), 5, "b_lat"))))


def _area(parts):
    return F.round(F.aggregate(F.transform(parts, geometry.area), F.lit(0.0), lambda a, v: a + v), 3)


@register(f"WITH {RINGS} SELECT s_suppkey, round(w*h + 2*(w+h)*0.5::DOUBLE + 0.25::DOUBLE*12*sin(pi()/12), 3) AS grown, CASE WHEN least(w,h) > 1 THEN round((w-1)*(h-1), 3) ELSE 0 END AS shrunk FROM r")
def ring_offset(spark, d):
    r = features.spread(features.rings(spark, d)).select("s_suppkey", regions.offset_polygon(F.array("c"), 0.5).alias("a"), regions.offset_polygon(F.array("c"), -0.5).alias("b"))
    return r.select("s_suppkey", _area(F.col("a")).alias("grown"), F.coalesce(_area(F.col("b")), F.lit(0.0)).alias("shrunk"))


@register(f"WITH {RINGS} SELECT s_suppkey, round(w + 0.25::DOUBLE*12*sin(pi()/12), 3) AS area FROM r")
def segment_buffer(spark, d):
    r = features.spread(features.rings(spark, d)).select("s_suppkey", regions.buffer_line(F.array(F.slice("c", 1, 2)), 0.5).alias("p"))
    return r.select("s_suppkey", _area(F.col("p")).alias("area"))


@register("SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS area FROM (SELECT DISTINCT s_nationkey, i, unnest(range(y, y + h)) AS j FROM (SELECT s_nationkey, y, h, unnest(range(x, x + w)) AS i FROM (SELECT s_nationkey, s_suppkey*31 % 300 AS x, s_suppkey*17 % 120 AS y, s_nationkey+1 AS w, s_suppkey % 7 + 1 AS h FROM supplier))) GROUP BY s_nationkey")
def rings_dissolved(spark, d):
    """The SQL counts the unit squares of the whole-numbered rectangles."""
    r = features.rings(spark, d).join(features.read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    out = dissolve.dissolve_rings(r.select("s_nationkey", F.array("c").alias("parts")), "s_nationkey", "parts")
    return out.groupBy("s_nationkey").agg(F.round(F.sum(geometry.area("ring")), 3).alias("area"))
