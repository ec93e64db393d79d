"""Queries on bounds, kinds, predicates, vectors, colours, text and units."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from isoline.functions import bounds as B
from isoline.functions import color, coords, crs, geometry, query, text, wkt
from isoline.functions import tags as T
from isoline.operators import features, raster
from isoline.plans.collect import BOX, BXS, CELLS, LNS, PTS, register
from isoline.render import canvas, svg
from isoline.sources import features as S
from isoline.sources import cache, osm, world
from isoline.sources.store import shared_folder

_P = lambda x, y: geometry.point(F.lit(float(x)), F.lit(float(y)))


def _box_features(spark, d, spread=False):
    """Boxes as polygons; spread: by many tasks, from a file of one."""
    b = features.spread(features.boxes(spark, d)) if spread else features.boxes(spark, d)
    tags = F.array(F.struct(F.lit("k").alias("key"), F.col("p_partkey").cast("string").alias("value")))
    return S.finish(b.select(F.col("p_partkey").cast("bigint").alias("feature_id"), F.lit("polygon").alias("geom_type"), F.array(B.ring(BOX)).alias("parts"), tags.alias("tags")))


def _line_features(spark, d):
    ln = features.lines(spark, d)
    return S.finish(ln.select(F.col("l_orderkey").cast("bigint").alias("feature_id"), F.lit("line").alias("geom_type"), F.array("c").alias("parts"), F.array().alias("tags")))


@register(f"WITH {BXS} SELECT p_partkey, xmax-xmin AS width, ymax-ymin AS height, greatest(xmax-xmin, ymax-ymin) AS size, (xmin+xmax)/2 AS cx, (ymin+ymax)/2 AS cy, xmin*2+1 AS x0, xmax*2+1 AS x1, 3-ymax AS y0, 3-ymin AS y1, 'X: (' || CAST(CAST(xmin AS BIGINT) AS VARCHAR) || ', ' || CAST(CAST(xmax AS BIGINT) AS VARCHAR) || ') Y: (' || CAST(CAST(ymin AS BIGINT) AS VARCHAR) || ', ' || regexp_replace(CAST(ymax AS VARCHAR), '\\.0$', '') || ')' AS label FROM bxs".replace("\\\\", "\\"))
def bbox_measures(spark, d):
    c, a = B.center(BOX), B.affine(BOX, 2.0, -1.0, 1.0, 3.0)
    return features.boxes(spark, d).select("p_partkey", B.width(BOX).alias("width"), B.height(BOX).alias("height"), B.size(BOX).alias("size"), c["x"].alias("cx"), c["y"].alias("cy"), *(v.alias(n) for v, n in zip(a, ("x0", "x1", "y0", "y1"), strict=True)), B.text(BOX).alias("label"))


@register(f"WITH {PTS} SELECT event_id, least(lon, 10.0::DOUBLE) AS xmin, greatest(lon, 10.0::DOUBLE) AS xmax, least(lat, -5.0::DOUBLE) AS ymin, greatest(lat, -5.0::DOUBLE) AS ymax FROM pts")
def bbox_of_points(spark, d):
    b = B.of_points(geometry.point(F.col("lon"), F.col("lat")), _P(10, -5))
    return features.points(spark, d).select("event_id", *(v.alias(n) for v, n in zip(b, BOX, strict=True)))


@register("SELECT kind, CAST(n AS BIGINT) AS n FROM (VALUES ('point', (SELECT count(*) FROM supplier)), ('line', (SELECT 2*count(*) FROM supplier)), ('polygon', (SELECT count(*) FROM supplier)), ('shape', (SELECT 3*count(*) FROM supplier))) v(kind, n)")
def features_of_type(spark, d):
    """A point, a line and a polygon for each supplier; a query for lines also finds polygons."""
    r, k = features.rings(spark, d), F.col("s_suppkey").cast("bigint").alias("feature_id")
    tags = F.array().alias("tags")
    every = r.select(k, F.lit("polygon").alias("geom_type"), F.array("c").alias("parts"), tags).unionByName(r.select(k, F.lit("line").alias("geom_type"), F.array(F.slice("c", 1, 3)).alias("parts"), tags)).unionByName(r.select(k, F.lit("point").alias("geom_type"), F.array(F.slice("c", 1, 1)).alias("parts"), tags))
    every, out = S.finish(every), None
    for kind in S.KINDS:
        one = S.of_type(every, kind).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register(f"WITH {BXS} SELECT CAST(p_partkey AS BIGINT) AS feature_id, 'line' AS as_line, 'polygon' AS as_polygon, 'multipolygon' AS as_multi, round(2*(xmax-xmin) + 2*(ymax-ymin), 6) AS around FROM bxs")
def features_converted(spark, d):
    """A box as a polygon, as the line around it, and back."""
    lines = S.as_lines(_box_features(spark, d))
    back = S.as_polygons(lines.withColumnRenamed("geom_type", "was").withColumn("geom_type", F.col("was")))
    multi = S.as_multi(back.withColumnRenamed("geom_type", "poly").withColumn("geom_type", F.col("poly")))
    return multi.select("feature_id", F.col("was").alias("as_line"), F.col("poly").alias("as_polygon"), F.col("geom_type").alias("as_multi"), F.round(geometry.length(F.col("parts")[0]), 6).alias("around"))


@register(f"WITH {LNS}, b AS (SELECT l_orderkey, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS n FROM v GROUP BY l_orderkey HAVING count(*) >= 2) SELECT CAST(l_orderkey % 10 AS BIGINT) AS k, 'multiline' AS geom_type, CAST(count(*) AS BIGINT) AS parts, CAST(sum(n) AS BIGINT) AS vertices FROM b GROUP BY 1")
def features_collected(spark, d):
    c = S.collect(_line_features(spark, d).withColumn("k", F.col("feature_id") % 10), "k")
    return c.select("k", "geom_type", F.size("parts").cast("bigint").alias("parts"), F.size(F.flatten("parts")).cast("bigint").alias("vertices"))


@register(f"WITH {LNS} SELECT CAST(l_orderkey AS BIGINT) AS feature_id, round(min(2*x - y), 6) AS xmin, round(max(2*x - y), 6) AS xmax, round(min(y + 3), 6) AS ymin, round(max(y + 3), 6) AS ymax FROM v GROUP BY l_orderkey HAVING count(*) >= 2")
def features_mapped(spark, d):
    m = S.map_points(_line_features(spark, d), lambda x, y: (2 * x - y, y + 3))
    return m.select("feature_id", *(F.round(c, 6).alias(c) for c in BOX))


@register(f"WITH {LNS} SELECT CAST(l_orderkey AS BIGINT) AS feature_id, round(radians(min(x))*6378137, 3) AS xmin, round(radians(max(x))*6378137, 3) AS xmax, round(ln(tan(pi()/4 + radians(min(y))/2))*6378137, 3) + 0.0::DOUBLE AS ymin, round(ln(tan(pi()/4 + radians(max(y))/2))*6378137, 3) + 0.0::DOUBLE AS ymax FROM v GROUP BY l_orderkey HAVING count(*) >= 2 AND max(x) > 15 AND min(x) < 50 AND max(y) > 2 AND min(y) < 30")
def features_in_system(spark, d):
    """The common contract of sources: a box in degrees, the result in another system."""
    m = S.get_data(_line_features(spark, d), wkt.srid_of("EPSG:4326"), (15, 50, 2, 30), wkt.srid_of(wkt.to_wkt(3857)))
    return m.select("feature_id", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in BOX))


@register(f"WITH {PTS} SELECT event_id, [4326, 4269, 3857, 54029, 54030, 32631, 27700][event_id % 7 + 1] AS srid, ['WGS 84', 'NAD83', 'WGS 84 / Pseudo-Mercator', 'World Van der Grinten I', 'World Robinson', 'WGS 84 / UTM zone 31N', 'OSGB36 / British National Grid'][event_id % 7 + 1] AS name, round(lon/60, 4) + 0.0::DOUBLE AS lon, round(51 + lat/60, 4) + 0.0::DOUBLE AS lat FROM pts")
def reference_systems(spark, d):
    """Events drawn together about 0 east, 51 north, each into one of the systems, by its number, its name or its text, and back."""
    p = features.points(spark, d).select("event_id", (F.col("lon") / 60).alias("lon"), (51 + F.col("lat") / 60).alias("lat"))
    out = None
    for k, srid in enumerate((4326, 4269, 3857, crs.VAN_DER_GRINTEN, crs.ROBINSON, 32631, crs.BRITISH)):
        by_number = wkt.srid_of(f"EPSG:{srid}")
        by_text, name = wkt.srid_of(wkt.to_wkt(by_number)), crs.KNOWN[by_number][0]
        x, y = crs.transform_xy(F.col("lon"), F.col("lat"), 4326, by_text)
        there = p.where(F.col("event_id") % 7 == k).select("event_id", x.alias("x"), y.alias("y"))
        lon, lat = crs.transform_xy(F.col("x"), F.col("y"), wkt.srid_of(name), 4326)
        one = there.select("event_id", F.lit(by_text).alias("srid"), F.lit(name).alias("name"), (F.round(lon, 4) + F.lit(0.0)).alias("lon"), (F.round(lat, 4) + F.lit(0.0)).alias("lat"))
        out = one if out is None else out.unionByName(one)
    return out


@register(f"WITH {PTS} SELECT event_id FROM pts WHERE (event_type = 'click' OR event_type = 'view') AND user_id <> 3 AND lon BETWEEN -100 AND 50 AND lat BETWEEN -20 AND 60")
def predicate_filter(spark, d):
    p = query.tag_among("type", ["click", "view"]) & query.tag_is_not("user", "3") & query.tag_exists("user") & query.inside((-100, 50, -20, 60))
    return features.points(spark, d).where(p.column("tags", F.col("lon"), F.col("lat"))).select("event_id")


@register(f"WITH {PTS}, b AS (SELECT event_type, user_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM pts GROUP BY event_type, user_id) SELECT event_type, user_id, '[out:xml];\n' || kind || '[\"type\"=\"' || event_type || '\"][\"user\"!=\"' || user_id || '\"](' || format('{{:g}},{{:g}},{{:g}},{{:g}}', y0, x0, y1, x1) || ');\nout body' || take || ';' AS text FROM b, (VALUES ('node', ''), ('way', ' 5'), ('nwr', '')) AS k(kind, take)")
def query_texts(spark, d):
    """For each kind of event and user: what would ask a server for such features of other users, within the box of the user's own."""
    def texts(frames):
        for f in frames:
            rows = []
            for kind, user, *box in f.itertuples(index=False):
                p = query.tag_is("type", kind) & query.tag_is_not("user", str(user)) & query.inside(box)
                rows += [(kind, user, p.text("point")), (kind, user, p.text("polygon", take=5)), (kind, user, p.text("shape"))]
            yield pd.DataFrame(rows, columns=["event_type", "user_id", "text"])

    p = features.points(spark, d).select(T.tag("tags", "type").alias("event_type"), T.tag("tags", "user").cast("bigint").alias("user_id"), "lon", "lat")
    boxes = p.groupBy("event_type", "user_id").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    return boxes.mapInPandas(texts, "event_type string, user_id bigint, text string")


@register(f"WITH {PTS} SELECT event_id, round(acos((lon*3 + lat*4)/(sqrt(lon*lon + lat*lat)*5)), 6) AS angle, round(acos(greatest(-1, least(1, ((lon-1)*(10-lon) + (lat-2)*(20-lat))/(sqrt((lon-1)*(lon-1) + (lat-2)*(lat-2))*sqrt((10-lon)*(10-lon) + (20-lat)*(20-lat)))))), 5) AS turn FROM pts WHERE (lon <> 0 OR lat <> 0) AND (lon <> 1 OR lat <> 2) AND (lon <> 10 OR lat <> 20)")
def vector_angles(spark, d):
    p = geometry.point(F.col("lon"), F.col("lat"))
    some = features.points(spark, d).where("(lon <> 0 or lat <> 0) and (lon <> 1 or lat <> 2) and (lon <> 10 or lat <> 20)")
    return some.select("event_id", F.round(coords.angle(p, _P(3, 4)), 6).alias("angle"), F.round(coords.deflection(_P(1, 2), p, _P(10, 20)), 5).alias("turn"))


@register(f"WITH {CELLS} SELECT x, y, round(-10 + x*(60/CAST(100 AS DOUBLE)), 6) AS lon, round(50 - y*(30/CAST(200 AS DOUBLE)), 6) AS lat, round(CAST(x AS DOUBLE), 6) AS px, round(CAST(y AS DOUBLE), 6) + 0.0::DOUBLE AS py FROM cells")
def raster_places(spark, d):
    """Pixels to degrees and back."""
    box = (-10.0, 50.0, 20.0, 50.0)
    at = coords.pixel_to_geo(F.col("x"), F.col("y"), box, 100, 200)
    px, py = coords.geo_to_pixel(F.col("p"), box, 100, 200)
    return features.raster(spark, d).select("x", "y", at.alias("p")).select("x", "y", F.round("p.x", 6).alias("lon"), F.round("p.y", 6).alias("lat"), F.round(px, 6).alias("px"), (F.round(py, 6) + F.lit(0.0)).alias("py"))


_RGB = "c AS (SELECT p_partkey, (p_partkey % 11)/CAST(10 AS DOUBLE) AS r, (p_partkey % 7)/CAST(6 AS DOUBLE) AS g, p_size/CAST(50 AS DOUBLE) AS b FROM part)"


def _rgb(spark, d):
    k = F.col("p_partkey")
    return features.read(spark, d, "part").select("p_partkey", ((k % 11) / F.lit(10.0)).alias("r"), ((k % 7) / F.lit(6.0)).alias("g"), (F.col("p_size") / F.lit(50.0)).alias("b"))


@register(f"WITH {_RGB} SELECT p_partkey, round(r*0.5::DOUBLE, 6) AS mr, round(g*0.25::DOUBLE, 6) AS mg, round(b*1.0::DOUBLE, 6) AS mb, round(r + (0.5::DOUBLE-r)*0.3::DOUBLE, 6) AS lr, round(g + (0.25::DOUBLE-g)*0.3::DOUBLE, 6) AS lg, round(b + (1-b)*0.3::DOUBLE, 6) AS lb FROM c")
def color_mixed(spark, d):
    c, o = tuple(F.col(k) for k in "rgb"), tuple(map(F.lit, (0.5, 0.25, 1.0)))
    return _rgb(spark, d).select("p_partkey", *(F.round(v, 6).alias(f"m{k}") for v, k in zip(color.multiply(c, o), "rgb", strict=True)), *(F.round(v, 6).alias(f"l{k}") for v, k in zip(color.lerp(c, o, F.lit(0.3)), "rgb", strict=True)))


@register("SELECT p_partkey, '#' || printf('%02x', CAST(p_size*5 AS INTEGER)) || '0a14' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE printf('%02x', CAST(p_partkey % 255 AS INTEGER)) END AS hex, CAST(p_size*5 AS INTEGER) AS r, 10 AS g, 20 AS b, CAST(CASE WHEN p_partkey % 3 = 0 THEN 255 ELSE p_partkey % 255 END AS INTEGER) AS a, CAST((p_partkey % 16)*17 AS INTEGER) AS sr, CAST((p_partkey % 5)*17 AS INTEGER) AS sa FROM part")
def color_codes(spark, d):
    """With and without alpha, in six, eight, three and four digits, within other text."""
    k = F.col("p_partkey")
    alpha = F.when(k % 3 == 0, F.lit(255)).otherwise(k % 255)
    t = features.read(spark, d, "part").select("p_partkey", color.to_hex(F.col("p_size") * 5, F.lit(10), F.lit(20), alpha).alias("hex"), F.concat(F.lit(" #"), F.lower(F.hex(k % 16)), F.lit("0F"), F.hex(k % 5), F.lit(" ")).alias("short"))
    full, four = color.from_hex(F.concat(F.lit("fill: "), F.col("hex"), F.lit(";"))), color.from_hex(F.col("short"))
    return t.select("p_partkey", "hex", *(v.alias(n) for v, n in zip(full, "rgba", strict=True)), four[0].alias("sr"), four[3].alias("sa"))


@register("SELECT page_id, CASE WHEN ends_with(url, '0') THEN left(url, length(url) - 1) ELSE url END AS trimmed, printf('%.3f', page_id/CAST(7 AS DOUBLE)) AS f3, 'page' || CAST(page_id AS VARCHAR) || '_small.html' AS named FROM pages")
def text_helpers(spark, d):
    return features.read(spark, d, "pages").select("page_id", text.trim_suffix(F.col("url"), "0").alias("trimmed"), text.fixed(F.col("page_id") / F.lit(7.0)).alias("f3"), text.append_to_file_name(F.concat(F.lit("page"), F.col("page_id"), F.lit(".html")), "_small").alias("named"))


@register(f"WITH {CELLS}, b AS (SELECT x, y, CAST(floor(v) AS INTEGER) AS v FROM cells) SELECT x, y, round((v % 256)/CAST(255 AS DOUBLE), 6) AS sr, round((v % 101)/CAST(255 AS DOUBLE), 6) AS sg, v % 256 AS r, least(255, CAST(trunc((v % 101)/CAST(255 AS DOUBLE)*3*255) AS INTEGER)) AS g, 255 AS a FROM b")
def raster_channels(spark, d):
    """Bytes as channels 0 .. 1, changed and merged again; what is too bright is cut."""
    v = F.floor("value").cast("int")
    c = features.raster(spark, d).select("x", "y", (v % 256).alias("p"), (v % 101).alias("q"))
    s = raster.split_channels(F.col("p"), F.col("q"), F.col("q"), F.lit(255))
    m = raster.merge_channels(s[0], s[1] * 3, s[2])
    return c.select("x", "y", F.round(s[0], 6).alias("sr"), F.round(s[1], 6).alias("sg"), m[0].alias("r"), m[1].alias("g"), m[3].alias("a"))


@register("SELECT CAST(r AS DOUBLE) AS radius, CAST(2*ceil(r) + 1 AS BIGINT) AS taps, round(1/sum(w), 9) AS middle, 1.0::DOUBLE AS total FROM (SELECT r, exp(-(k*k)/(2*(r/2.5::DOUBLE)*(r/2.5::DOUBLE))) AS w FROM (SELECT r, unnest(range(-CAST(ceil(r) AS BIGINT), CAST(ceil(r) AS BIGINT) + 1)) AS k FROM (SELECT DISTINCT p_size*4 AS r FROM part))) GROUP BY r")
def blur_kernels(spark, d):
    """The kernel of each radius that the parts' sizes give."""
    def kernels(frames):
        for f in frames:
            found = [(r, raster.gaussian_kernel(r)) for r in f["r"]]
            yield pd.DataFrame([(r, len(k), round(max(k), 9), round(sum(k), 9)) for r, k in found], columns=["radius", "taps", "middle", "total"])

    return features.read(spark, d, "part").select((F.col("p_size") * 4).cast("double").alias("r")).distinct().mapInPandas(kernels, "radius double, taps bigint, middle double, total double")


@register(f"WITH {CELLS}, u AS (SELECT x, y, CASE WHEN v < 100 THEN NULL ELSE v END AS v FROM cells), t(o, w) AS (SELECT k, exp(-(k*k)/(2*0.4::DOUBLE*0.4::DOUBLE)) FROM (SELECT unnest([-1, 0, 1]) AS k)), size AS (SELECT max(x) AS xm, max(y) AS ym FROM cells), s AS (SELECT c.x, c.y, c.v, sum(n.v*a.w*b.w) AS top, sum(CASE WHEN n.v IS NOT NULL THEN a.w*b.w END) AS low FROM u c, t a, t b, size JOIN u n ON n.x = greatest(0, least(xm, c.x + a.o)) AND n.y = greatest(0, least(ym, c.y + b.o)) GROUP BY c.x, c.y, c.v) SELECT x, y, round(CASE WHEN v IS NULL THEN -9999 ELSE top/low END, 6) AS value FROM s")
def raster_blur_nodata(spark, d):
    """Values below 100 are no-data: they give nothing and stay."""
    c = features.raster(spark, d).withColumn("value", F.when(F.col("value") < 100, -9999.0).otherwise(F.col("value")))
    w, h = c.agg(F.max("x") + 1, F.max("y") + 1).first()
    return raster.gaussian_blur(c, 1.0, w, h, -9999.0).select("x", "y", F.round("value", 6).alias("value"))


def _wide_blur_sql(radius: int) -> str:
    """Along rows and columns of the raster with its edges repeated, by prefix sums of nothing: each cell joins its taps."""
    taps = f"taps(o, w) AS (SELECT k, e/sum(e) OVER () FROM (SELECT k, exp(-(k*k)/(2*({radius}/2.5::DOUBLE)*({radius}/2.5::DOUBLE))) AS e FROM (SELECT unnest(range(-{radius}, {radius} + 1)) AS k)))"
    step = lambda src, axis, other, most: f"SELECT c.x, c.y, sum(s.v*t.w) AS v FROM {src} c, taps t, size JOIN {src} s ON s.{axis} = greatest(0, least({most}, c.{axis} + t.o)) AND s.{other} = c.{other} GROUP BY c.x, c.y"
    return f"WITH {CELLS}, {taps}, size AS (SELECT max(x) AS xm, max(y) AS ym FROM cells), h AS ({step('cells', 'x', 'y', 'xm')}), g AS ({step('h', 'y', 'x', 'ym')}) SELECT x, y, round(v, 6) AS value FROM g"


def _blurred(spark, d, radius):
    c = features.raster(spark, d)
    w, h = c.agg(F.max("x") + 1, F.max("y") + 1).first()
    return raster.gaussian_blur(c, radius, w, h).select("x", "y", F.round("value", 6).alias("value"))


@register(_wide_blur_sql(1))
def raster_blur_1(spark, d):
    return _blurred(spark, d, 1)


@register(_wide_blur_sql(5))
def raster_blur_5(spark, d):
    return _blurred(spark, d, 5)


@register(_wide_blur_sql(20))
def raster_blur_wide(spark, d):
    """By tiles with a halo."""
    return _blurred(spark, d, 20)


@register(_wide_blur_sql(200))
def raster_blur_200(spark, d):
    return _blurred(spark, d, 200)


@register(f"WITH {PTS}, s(strategy, sx, sy, ox, oy) AS (VALUES ('stretch', 1000/360.0::DOUBLE, 800/180.0::DOUBLE, 500.0::DOUBLE, 400.0::DOUBLE), ('center', 1000/360.0::DOUBLE, 1000/360.0::DOUBLE, 500.0::DOUBLE, 400.0::DOUBLE), ('crop', 800/180.0::DOUBLE, 800/180.0::DOUBLE, 500.0::DOUBLE, 400.0::DOUBLE), ('extend', 1000/360.0::DOUBLE, 1000/360.0::DOUBLE, 500.0::DOUBLE, 400.0::DOUBLE)) SELECT strategy, event_id, round(lon*sx + ox, 6) AS cx, round(lat*sy + oy, 6) AS cy FROM pts, s")
def canvas_strategies(spark, d):
    """Degrees of the whole world on a canvas of 1000 by 800."""
    out = None
    for name in ("stretch", "center", "crop", "extend"):
        f = canvas.fit((-180, 180, -90, 90), 1000, 800, name)
        one = features.points(spark, d).select(F.lit(name).alias("strategy"), "event_id", F.round(F.col("lon") * f.scale_x + f.offset_x, 6).alias("cx"), F.round(F.col("lat") * f.scale_y + f.offset_y, 6).alias("cy"))
        out = one if out is None else out.unionByName(one)
    return out


@register("SELECT p_partkey, round(p_size*72.0::DOUBLE, 6) AS points, round(p_size*90.0::DOUBLE/25.4::DOUBLE, 6) AS pixels, round(p_size*0.8::DOUBLE/72, 6) AS inches FROM part")
def unit_conversion(spark, d):
    n = features.read(spark, d, "part")
    per = lambda a, b: canvas.convert(1.0, a, b)
    return n.select("p_partkey", F.round(F.col("p_size") * per("inch", "point"), 6).alias("points"), F.round(F.col("p_size") * per("mm", "pixel"), 6).alias("pixels"), F.round(F.col("p_size") * per("pixel", "inch"), 6).alias("inches"))


_RINGS = "r AS (SELECT s_suppkey, CAST(s_suppkey*31 % 300 AS DOUBLE) AS x, CAST(s_suppkey*17 % 120 AS DOUBLE) AS y, CAST(s_nationkey+1 AS DOUBLE) AS w, CAST(s_suppkey % 7 + 1 AS DOUBLE) AS h FROM supplier)"


@register(f"WITH {_RINGS}, k AS (SELECT *, 1000/330.0::DOUBLE AS s, (500 - 130*1000/330.0::DOUBLE)/2 AS o FROM r), c AS (SELECT s_suppkey, x*s AS a, (x+w)*s AS b, 500 - (y*s + o) AS c, 500 - ((y+h)*s + o) AS d FROM k) SELECT CAST(s_suppkey AS BIGINT) AS feature_id, '<path d=\"' || printf('M %.3f %.3f L %.3f %.3f L %.3f %.3f L %.3f %.3f L %.3f %.3f Z', a, c, b, c, b, d, a, d, a, c) || '\" fill=\"#ffeecc\" fill-rule=\"evenodd\" stroke=\"#000000\" stroke-width=\"1\" stroke-linecap=\"butt\" stroke-linejoin=\"miter\"/>' AS svg FROM c")
def draw_areas(spark, d):
    tags = F.array(F.struct(F.lit("name").alias("key"), F.col("s_suppkey").cast("string").alias("value")))
    rings = S.finish(features.rings(spark, d).select(F.col("s_suppkey").cast("bigint").alias("feature_id"), F.lit("polygon").alias("geom_type"), F.array("c").alias("parts"), tags.alias("tags")))
    m = svg.Map((0, 330, 0, 130), 1000, 500, layers=[svg.Layer("areas", "rings", svg.Style(fill="#ffeecc", stroke="#000000"))])
    return svg.draw(m, {"rings": (rings, 4326)}).select("feature_id", "svg")


@register("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_suppkey % 2 = 0 AS polygon FROM supplier")
def closed_ways(spark, d):
    """A closed way is a polygon if a tag says so."""
    tags = F.array(F.struct(F.when(F.col("s_suppkey") % 2 == 0, "building").otherwise("highway").alias("key"), F.lit("yes").alias("value")))
    return features.rings(spark, d).select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), osm.is_polygon(F.col("c"), tags).alias("polygon"))


@register(f"WITH {BXS}, m AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'land' WHEN 1 THEN 'lakes' WHEN 2 THEN 'admin_0_countries' ELSE 'populated_places' END AS name, CASE WHEN p_partkey % 4 < 2 THEN 'physical' ELSE 'cultural' END AS kind, CASE WHEN xmax-xmin > 30 THEN '110m' WHEN xmax-xmin > 8 THEN '50m' ELSE '10m' END AS detail FROM bxs) SELECT p_partkey, kind, 'https://naciscdn.org/naturalearth/' || detail || '/' || kind || '/ne_' || detail || '_' || name || '.zip' AS url FROM m")
def world_vectors(spark, d):
    """The file of the catalogue that suits each part's box."""
    b = features.boxes(spark, d).select("p_partkey", F.element_at(F.array(*map(F.lit, ("land", "lakes", "admin_0_countries", "populated_places"))), (F.col("p_partkey") % 4 + 1).cast("int")).alias("name"), F.concat(world.scale_for(B.width(BOX)), F.lit("m")).alias("detail"))
    return b.join(F.broadcast(world.catalogue(spark)), ["name", "detail"]).select("p_partkey", "kind", "url")


@register(f"WITH {BXS}, m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'HYP' WHEN 1 THEN 'SR' ELSE 'GRAY' END AS style, CASE p_partkey % 3 WHEN 0 THEN '_SR_W' WHEN 1 THEN '' ELSE '_SR_OB' END AS layers, CASE WHEN xmax-xmin > 30 THEN '50M' WHEN xmax-xmin > 8 THEN 'LR' ELSE 'HR' END AS size FROM bxs) SELECT p_partkey, 'https://naciscdn.org/naturalearth/' || CASE size WHEN '50M' THEN '50m' ELSE '10m' END || '/raster/' || style || '_' || size || layers || '.zip' AS url FROM m")
def world_rasters(spark, d):
    """The raster file that suits each part's box."""
    size = F.element_at(F.create_map(*(F.lit(x) for x in (110, "50M", 50, "LR", 10, "HR"))), world.scale_for(B.width(BOX)))
    b = features.boxes(spark, d).select("p_partkey", F.element_at(F.array(*map(F.lit, ("HYP_SR_W", "SR", "GRAY_SR_OB"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("name"), size.alias("detail"))
    return b.join(F.broadcast(world.catalogue(spark).where("kind = 'raster'")), ["name", "detail"]).select("p_partkey", "url")


@register("SELECT page_id, CASE WHEN page_id % 3 = 1 AND length(url) % 5 > 0 THEN 'cached' WHEN page_id % 3 = 1 THEN 'known absent' WHEN length(url) % 5 > 0 THEN 'fetched' ELSE 'absent' END AS state, CASE WHEN length(url) % 5 > 0 THEN CAST(octet_length(encode(url)) AS BIGINT) ELSE -1 END AS bytes FROM pages")
def cache_states(spark, d):
    """Addresses of pages through the cache at three times; those whose length is divisible by five have no file. What was got first is too old the third time."""
    pages = features.read(spark, d, "pages").select(F.col("page_id").cast("string").alias("name"), "url")
    store = cache.FileCache(spark, shared_folder(spark))
    fetch = lambda url: url.encode() if len(url) % 5 else None
    for third, now in ((0, 0.0), (1, 60.0)):
        store.get(pages.where(F.col("name").cast("bigint") % 3 == third), fetch, now=now)
    got = store.get(pages, fetch, max_age_s=70.0, absent_age_s=50.0, now=100.0)
    return got.select(F.col("name").cast("bigint").alias("page_id"), "state", F.coalesce("bytes", F.lit(-1)).cast("bigint").alias("bytes"))


@register("SELECT event_id FROM events WHERE event_type = 'view' AND user_id % 2 = 0")
def tag_contains_pair(spark, d):
    """The exact pair, whatever else the key holds: each event also has a second tag `type`."""
    p = features.points(spark, d)
    more = F.concat("tags", F.array(F.struct(F.lit("type").alias("key"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("value")), F.struct(F.lit("parity").alias("key"), (T.tag("tags", "user").cast("bigint") % 2).cast("string").alias("value"))))
    return p.withColumn("tags", more).where(T.contains_pair("tags", "type", "view") & T.contains_pair("tags", "parity", "0")).select("event_id")
