"""Queries that write files of the supplied tables' features and read them back: the SQL knows nothing of the files."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from isoline.functions import bounds as B
from isoline.functions import geometry
from isoline.functions import tags as T
from isoline.operators import contour_lines, features, raster
from isoline.plans.collect import BOX, BXS, CELLS, LNS, PTS, register
from isoline.plans.helpers import _box_features, _line_features
from isoline.render import png, svg
from isoline.sources import datasource, rasters, tiff, tiles
from isoline.sources.features import finish
from isoline.sources.files import existing, read_vector, shared_folder, write_file
from isoline.sources.geojson import read_geojson, to_geojson
from isoline.sources.kml import read_kml
from isoline.sources.osm import INCOMPLETE
from isoline.sources.shapefile import read_shapefile
from isoline.streaming import boxes


def _write_xml(lines, root: str, path: str) -> None:
    """Each part a document of its own."""
    def run(frames):
        yield pd.DataFrame({"value": [f'<?xml version="1.0" encoding="UTF-8"?><{root}>']})
        yield from frames
        yield pd.DataFrame({"value": [f"</{root}>"]})

    lines.mapInPandas(run, "value string").write.text(path)


@register(f"WITH {BXS}, {LNS} SELECT 'polygon' AS geom_type, CAST(p_partkey AS VARCHAR) AS k, CAST(5 AS BIGINT) AS vertices, xmin, xmax, ymin, ymax FROM bxs UNION ALL SELECT 'line', '', CAST(count(*) AS BIGINT), min(x), max(x), min(y), max(y) FROM v GROUP BY l_orderkey HAVING count(*) >= 2")
def geojson_round_trip(spark, d):
    path = f"{shared_folder(spark)}/features.geojson"
    to_geojson(_box_features(spark, d).unionByName(_line_features(spark, d))).write.text(path)
    return read_geojson(spark, path, lines=True).select("geom_type", F.coalesce(T.tag("tags", "k"), F.lit("")).alias("k"), F.size(F.flatten("parts")).cast("bigint").alias("vertices"), *BOX)


@register(f"WITH {BXS} SELECT CAST(p_partkey AS VARCHAR) AS k, xmin, xmax, ymin, ymax FROM bxs WHERE xmax > -20 AND xmin < 60 AND ymax > -30 AND ymin < 40")
def geojson_source_in_box(spark, d):
    """Through the data source, whose reader gets the box."""
    path = f"{shared_folder(spark)}/features.geojson"
    to_geojson(_box_features(spark, d, True)).write.text(path)
    datasource.register(spark)
    return spark.read.format("isoline_geojson").option("range_bytes", 20_000).load(path).where(B.intersects(BOX, (-20, 60, -30, 40))).select(T.tag("tags", "k").alias("k"), *BOX)


@register("SELECT CAST(2*k AS VARCHAR) AS name, CAST(count(*) AS BIGINT) AS polygons, CAST(sum(p.rings) AS BIGINT) AS rings FROM (SELECT s_suppkey AS k, unnest([2, 1]) AS rings FROM supplier) p GROUP BY k")
def geojson_multipolygons(spark, d):
    """Two outer rings, the first with a hole: written as one MultiPolygon, read as two polygons."""
    def square(x, y, s, ccw):
        at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
        zero, side = F.lit(0.0), F.lit(float(s))
        ring = [at(zero, zero), at(side, zero), at(side, side), at(zero, side), at(zero, zero)]
        return F.array(*(ring if ccw else ring[::-1]))

    k = F.col("s_suppkey").cast("double")
    parts = F.array(square(k + 2, k + 2, 2, False), square(k, k, 6, True), square(k + 10, k, 3, True))
    tags = F.array(F.struct(F.lit("name").alias("key"), (F.col("s_suppkey") * 2).cast("string").alias("value")))
    f = finish(features.read(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("feature_id"), F.lit("multipolygon").alias("geom_type"), parts.alias("parts"), tags.alias("tags")))
    path = f"{shared_folder(spark)}/features.geojson"
    to_geojson(f).write.text(path)
    return read_geojson(spark, path, lines=True).groupBy(T.tag("tags", "name").alias("name")).agg(F.count("*").alias("polygons"), F.sum(F.size("parts")).alias("rings"))


@register("""WITH n AS (SELECT c_custkey AS id, c_nationkey, c_custkey % 360 - 180 AS lon, c_custkey*7 % 170 - 85 AS lat FROM customer), o AS (SELECT o_orderkey, o_orderstatus, (SELECT max(id) FROM n) AS m, o_custkey AS a FROM orders),
w AS (SELECT o_orderkey, o_orderstatus, unnest([CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE a END, a % m + 1, (a + 1) % m + 1]) AS ref FROM o)
SELECT 'point' AS geom_type, CAST(id AS BIGINT) AS feature_id, CAST(c_nationkey AS VARCHAR) AS tag, CAST(1 AS BIGINT) AS n, CAST(lon AS DOUBLE) AS xmin, CAST(lat AS DOUBLE) AS ymin, false AS incomplete, 0::DOUBLE AS area FROM n WHERE c_nationkey % 2 = 0
UNION ALL SELECT 'line', o_orderkey, o_orderstatus, count(*), min(lon), min(lat), o_orderkey % 7 = 0, 0 FROM w JOIN n ON ref = id GROUP BY o_orderkey, o_orderstatus
UNION ALL SELECT 'multipolygon', s_suppkey, CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 10 END, s_suppkey % 300 - 150, s_suppkey*7 % 120 - 60, s_suppkey % 3 = 0, CASE WHEN s_suppkey % 3 = 0 THEN 36 ELSE 32 END FROM supplier""")
def osm_round_trip(spark, d):
    """Customers as nodes, some with a tag; each order as a way over three of them, one in seven without its first node; each supplier as a relation of an
    outer ring (either way round, some given by its places) and an inner one (one in three is not there). Written as OSM XML, read in one scan."""
    n = features.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", (F.col("c_custkey") % 360 - 180).alias("lon"), (F.col("c_custkey") * 7 % 170 - 85).alias("lat"))
    most = n.agg(F.max("id")).first()[0]
    tag = lambda k, v: F.concat(F.lit(f'<tag k="{k}" v="'), v.cast("string"), F.lit('"/>'))
    nodes = n.select(F.concat(F.lit('<node id="'), "id", F.lit('" lat="'), "lat", F.lit('" lon="'), "lon", F.lit('">'), F.when(F.col("c_nationkey") % 2 == 0, tag("nation", F.col("c_nationkey"))).otherwise(tag("note", F.lit("x"))), F.lit("</node>")).alias("value"))
    refs = lambda *r: F.array_join(F.transform(F.array(*r), lambda r: F.concat(F.lit('<nd ref="'), r, F.lit('"/>'))), "")
    a = F.col("o_custkey")
    first = F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(a)
    ways = features.read(spark, d, "orders").select(F.concat(F.lit('<way id="'), "o_orderkey", F.lit('">'), refs(first, a % most + 1, (a + 1) % most + 1), tag("status", F.col("o_orderstatus")), F.lit("</way>")).alias("value"))

    k = F.col("s_suppkey")
    x, y, base = k % 300 - 150, k * 7 % 120 - 60, k * 10 + 100_000_000
    corners = [(x + a + s * i, y + a + s * j) for a, s in ((0, 6), (2, 2)) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
    supplier = features.read(spark, d, "supplier").select("s_suppkey")
    rings = supplier.select(F.explode(F.array(*(F.concat(F.lit('<node id="'), base + i, F.lit('" lat="'), v, F.lit('" lon="'), u, F.lit('"/>')) for i, (u, v) in enumerate(corners)))).alias("value"))
    turned = F.when(k % 2 == 1, refs(*(base + i for i in (0, 1, 2, 3, 0)))).otherwise(refs(*(base + i for i in (0, 3, 2, 1, 0))))
    outer = supplier.where(k % 3 != 2).select(F.concat(F.lit('<way id="'), base, F.lit('">'), turned, F.lit("</way>")).alias("value"))
    inner = supplier.where(k % 3 != 0).select(F.concat(F.lit('<way id="'), base + 1, F.lit('">'), refs(*(base + i for i in (4, 5, 6, 7, 4))), F.lit("</way>")).alias("value"))
    places = F.concat(*(F.concat(F.lit('<nd lat="'), corners[i][1], F.lit('" lon="'), corners[i][0], F.lit('"/>')) for i in (0, 3, 2, 1, 0)))
    member = lambda role, ref, nd: F.concat(F.lit('<member type="way" ref="'), ref, F.lit(f'" role="{role}">'), nd, F.lit("</member>"))
    relations = supplier.select(F.concat(F.lit('<relation id="'), k, F.lit('">'), member("outer", base, F.when(k % 3 == 2, places).otherwise("")), member("inner", base + 1, F.lit("")), tag("type", F.lit("multipolygon")), tag("name", k), F.lit("</relation>")).alias("value"))
    path = f"{shared_folder(spark)}/map.osm"
    _write_xml(nodes.unionByName(rings).unionByName(ways).unionByName(outer).unionByName(inner).unionByName(relations), "osm", path)
    found = read_vector(spark, path)
    size = F.when(F.col("geom_type") == "multipolygon", F.round(F.aggregate("parts", F.lit(0.0), lambda s, c: s + geometry.area(c)), 6)).otherwise(0.0)
    name = F.coalesce(*(T.tag("tags", t) for t in ("nation", "status", "name")))
    return found.select("geom_type", "feature_id", name.alias("tag"), F.size(F.flatten("parts")).cast("bigint").alias("n"), "xmin", "ymin", F.coalesce(T.tag("tags", INCOMPLETE[0]) == INCOMPLETE[1], F.lit(False)).alias("incomplete"), size.alias("area"))


@register("SELECT CAST(s_suppkey AS VARCHAR) AS name, 'polygon' AS geom_type, CAST(s_nationkey AS VARCHAR) AS nation, CAST(s_suppkey*31 % 300 AS DOUBLE) AS xmin, CAST(s_suppkey*17 % 120 AS DOUBLE) AS ymin, CAST((s_nationkey + 1)*(s_suppkey % 7 + 1) AS DOUBLE) AS area FROM supplier")
def kml_round_trip(spark, d):
    from isoline.functions.geometry import area

    r = features.rings(spark, d).join(features.read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    at = F.array_join(F.transform("c", lambda p: F.concat(p["x"].cast("string"), F.lit(","), p["y"].cast("string"))), " ")
    body = F.concat(F.lit("<Placemark><name>"), "s_suppkey", F.lit('</name><ExtendedData><Data name="nation"><value>'), "s_nationkey", F.lit("</value></Data></ExtendedData><Polygon><outerBoundaryIs><LinearRing><coordinates>"), at, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    path = f"{shared_folder(spark)}/places.kml"
    _write_xml(r.select(body.alias("value")), "kml", path)
    return read_kml(spark, path).select(T.tag("tags", "name").alias("name"), "geom_type", T.tag("tags", "nation").alias("nation"), "xmin", "ymin", area(F.col("parts")[0]).alias("area"))


def _shapefile(frame: pd.DataFrame) -> tuple[bytes, bytes]:
    """Points and a numeric field ID as .shp and .dbf: a test's writer, not a sink."""
    n = len(frame)
    shp = np.zeros(n, [("no", ">i4"), ("words", ">i4"), ("kind", "<i4"), ("x", "<f8"), ("y", "<f8")])
    shp["no"], shp["words"], shp["kind"], shp["x"], shp["y"] = np.arange(1, n + 1), 10, 1, frame["lon"], frame["lat"]
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + shp.nbytes // 2) + struct.pack("<ii8d", 1000, 1, *([0.0] * 8))
    field = b"ID".ljust(11, b"\0") + b"N" + bytes(4) + bytes([12, 0]) + bytes(14)
    dbf = np.char.rjust(frame["event_id"].to_numpy().astype("S12"), 13)  # a blank: not deleted
    return head + shp.tobytes(), struct.pack("<B3BIHH20x", 3, 100, 1, 1, n, 65, 13) + field + b"\r" + dbf.tobytes() + b"\x1a"


#: Events of a Shapefile at most, by the range of their ids: a file is one task's work.
SHAPES = 200_000


@register(f"WITH {PTS} SELECT CAST(event_id AS VARCHAR) AS id, lon AS xmin, lat AS ymin FROM pts")
def shapefile_round_trip(spark, d):
    """A Shapefile for each seventh of the events of a range of ids."""
    folder, span = shared_folder(spark), 7 * SHAPES

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        k, block = int(frame["event_id"].iloc[0] % 7), int(frame["event_id"].iloc[0] // span)
        for ext, data in zip(("shp", "dbf"), _shapefile(frame), strict=True):
            write_file(f"{folder}/part{k}-{block}.{ext}", data)
        return pd.DataFrame({"k": [k]})

    features.points(spark, d).select("event_id", "lon", "lat").groupBy(F.col("event_id") % 7, F.floor(F.col("event_id") / span)).applyInPandas(run, "k int").count()
    return read_shapefile(spark, folder).select(T.tag("tags", "ID").alias("id"), "xmin", "ymin")


@register(f"WITH {BXS}, t AS (SELECT DISTINCT CAST(floor(xmin) AS BIGINT) AS tx, CAST(floor(ymin) AS BIGINT) AS ty FROM bxs) SELECT CAST(tx + 180 AS BIGINT) AS c, CAST(89 - ty AS BIGINT) AS r, CAST(4 AS BIGINT) AS n, 4*((tx + 180)*90 + ty + 90)::DOUBLE AS total FROM t WHERE tx BETWEEN -100 AND 99 AND ty BETWEEN -40 AND 39")
def tiles_read(spark, d):
    """Height files of the tiles at the corners of all boxes, read by a box: each tile's inner cells hold its number."""
    folder = shared_folder(spark)
    b = features.boxes(spark, d).select(F.floor("xmin").alias("tx"), F.floor("ymin").alias("ty")).distinct().withColumn("name", tiles.srtm_name(F.col("tx"), F.col("ty")))

    def run(frames):
        for frame in frames:
            for tx, ty, name in zip(frame["tx"], frame["ty"], frame["name"]):
                a = np.full((3, 3), -1, ">i2")
                a[:2, :2] = (tx + 180) * 90 + ty + 90
                write_file(f"{folder}/{name}.hgt", a.tobytes())
            yield frame[["name"]]

    b.mapInPandas(run, "name string").count()
    cells = tiles.read_tiles(spark, folder, (-100.0, 100.0, -40.0, 40.0), 3)
    inner = cells.where("value >= 0").groupBy((F.floor(F.col("x") / 2) + 80).alias("c"), (F.floor(F.col("y") / 2) + 50).alias("r"))
    return inner.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@register(f"WITH {CELLS} SELECT x, y, CAST(least(greatest(round_even(v/500*255, 0), 0), 255) AS DOUBLE) AS red, CASE WHEN v < 50 THEN 0 ELSE 255 END::DOUBLE AS alpha FROM cells WHERE v >= 50 UNION ALL SELECT x, y, 0, 0 FROM cells WHERE v < 50")
def png_round_trip(spark, d):
    """A raster as a PNG file, read as bands."""
    folder = shared_folder(spark)
    c = features.raster(spark, d).withColumn("value", F.when(F.col("value") < 50, -9999.0).otherwise(F.col("value") / 500))
    r, g, b, a = raster.to_image(F.col("value"), 255.0, -9999.0)
    png.write_png(c.select("raster_id", "x", "y", r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a")), folder).count()
    bands = rasters.read_raster(spark, [f"{folder}/{n}" for n in existing(spark, folder)])
    return bands.groupBy("x", "y").agg(F.max(F.when(F.col("band") == 1, F.col("value"))).alias("red"), F.max(F.when(F.col("band") == 4, F.col("value"))).alias("alpha"))


@register(f"WITH {CELLS} SELECT c AS raster_id, x, y, v AS value FROM cells, (VALUES ('none'), ('lzw'), ('deflate'), ('packbits')) AS t(c)")
def tiff_round_trip(spark, d):
    """The cells as tiled TIFF files of every compression, two of them with a predictor, read by blocks."""
    folder, c = shared_folder(spark), features.raster(spark, d)
    for name, predictor in (("none", 1), ("lzw", 3), ("deflate", 3), ("packbits", 1)):
        tiff.write_tiff(c.withColumn("raster_id", F.lit(name)), folder, compression=name, region=512, tile=64, predictor=predictor).count()
    found = tiff.placed_cells(spark, folder)
    return found.select(F.substring_index("raster_id", "-", 1).alias("raster_id"), "x", "y", "value")


@register(f"WITH {CELLS} SELECT x, y, v AS value FROM cells WHERE x BETWEEN 20 AND 61 AND y BETWEEN 3 AND 40")
def tiff_in_box(spark, d):
    """The box is pushed to the reader, which leaves blocks outside of it unread."""
    folder = shared_folder(spark)
    tiff.write_tiff(features.raster(spark, d), folder, region=256, tile=16).count()
    return tiff.placed_cells(spark, folder).where("x between 20 and 61 and y between 3 and 40").select("x", "y", "value")


@register("SELECT 'r' AS raster_id, 4 AS bands, CAST(max(event_id % 100) + 1 AS INTEGER) AS width, CAST(max(event_id // 100) + 1 AS INTEGER) AS height, CAST(min(CAST(floor(value) AS INTEGER) % 200) AS DOUBLE) AS vmin, 255.0::DOUBLE AS vmax FROM events")
def raster_summary(spark, d):
    folder = shared_folder(spark)
    c = features.raster(spark, d).withColumn("v", F.floor("value").cast("int") % 200)
    png.write_png(c.select("raster_id", "x", "y", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"), F.lit(255).alias("a")), folder).count()
    return rasters.raster_meta(rasters.read_raster(spark, [f"{folder}/{n}" for n in existing(spark, folder)]))


@register(f"WITH {CELLS}, t AS (SELECT DISTINCT x // 16 AS tx, y // 16 AS ty FROM cells), z AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM cells) SELECT CAST(ty*16*w + tx*16 AS BIGINT) AS feature_id, printf('<image x=\"%.3f\" y=\"%.3f\" width=\"%.3f\" height=\"%.3f\"', tx*16*4::DOUBLE, ty*16*2::DOUBLE, least(16, w - tx*16)*4::DOUBLE, least(16, h - ty*16)*2::DOUBLE) AS head FROM t, z")
def draw_raster(spark, d):
    """A raster layer in tiles of 16 cells, the map being the raster's own box at 4 by 2 units a cell."""
    c = features.raster(spark, d)
    w, h = c.agg(F.max("x") + 1, F.max("y") + 1).first()
    m = svg.Map((0, w, 0, h), 4 * w, 2 * h, strategy="stretch")
    cells = c.select("raster_id", "x", "y", *(F.lit(9).alias(k) for k in "rgb"), F.lit(255).alias("a"))
    return svg.raster_layer(m, cells, (0, w, 0, h), w, h, 0, 16).select("feature_id", F.substring_index("svg", " preserveAspectRatio", 1).alias("head"))


@register("SELECT layer_no, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([0, 1]) AS layer_no FROM supplier) GROUP BY layer_no")
def layers_written(spark, d):
    """A folder of drawing commands for each layer."""
    rings = finish(features.rings(spark, d).select(F.col("s_suppkey").cast("bigint").alias("feature_id"), F.lit("polygon").alias("geom_type"), F.array("c").alias("parts"), F.array().alias("tags")))
    m = svg.Map((0, 330, 0, 130), 1000, 500, layers=[svg.Layer("a", "r", svg.Style(fill="#ffeecc")), svg.Layer("b", "r", svg.Style(stroke="#000000"))])
    path = f"{shared_folder(spark)}/layers"
    svg.write_layers(svg.draw(m, {"r": (rings, 4326)}), path)
    return spark.read.text(path).groupBy("layer_no").agg(F.count("*").alias("n"))


_TRIANGLES = f"WITH {CELLS}, q AS (SELECT a.x, a.y, a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM cells a JOIN cells b ON b.x = a.x+1 AND b.y = a.y JOIN cells c ON c.x = a.x AND c.y = a.y+1 JOIN cells d ON d.x = a.x+1 AND d.y = a.y+1), t AS (SELECT x AS px, y AS py, a AS p, x+1 AS qx, y AS qy, b AS q, x AS rx, y+1 AS ry, c AS r FROM q UNION ALL SELECT x+1, y, b, x+1, y+1, d, x, y+1, c FROM q), e AS (SELECT *, k*100 AS e FROM t, (SELECT unnest(range(0, 7)) AS k)), f AS (SELECT e, list_filter([CASE WHEN (p >= e) <> (q >= e) THEN [px + (qx-px)*(e-p)/(q-p), py + (qy-py)*(e-p)/(q-p)] END, CASE WHEN (q >= e) <> (r >= e) THEN [qx + (rx-qx)*(e-q)/(r-q), qy + (ry-qy)*(e-q)/(r-q)] END, CASE WHEN (r >= e) <> (p >= e) THEN [rx + (px-rx)*(e-r)/(p-r), ry + (py-ry)*(e-r)/(p-r)] END], lambda z: z IS NOT NULL) AS z FROM e)"


@register(f"{_TRIANGLES} SELECT CAST(e AS DOUBLE) AS elev, CAST(count(*) AS BIGINT) AS segments, round(sum(sqrt((z[2][1]-z[1][1])*(z[2][1]-z[1][1]) + (z[2][2]-z[1][2])*(z[2][2]-z[1][2]))), 4) AS length, true AS ends_on_edge FROM f WHERE len(z) = 2 AND z[1] <> z[2] GROUP BY e")
def raster_contour_lines(spark, d):
    """Stitched lines have all segments and their length, and an open line ends at the raster's edge."""
    from isoline.functions.geometry import length

    c = features.raster(spark, d)
    w, h = c.agg(F.max("x"), F.max("y")).first()
    lines = contour_lines.contour_features(contour_lines.contour_lines(c, 100.0, tile=64))
    p = F.col("parts")[0]
    edge = lambda q: (q["x"] < 1e-6) | (q["y"] < 1e-6) | (q["x"] > w - 1e-6) | (q["y"] > h - 1 - 1e-6)  # noqa: E731  the last row may be short
    near = lambda a, b: (F.abs(a["x"] - b["x"]) < 1e-6) & (F.abs(a["y"] - b["y"]) < 1e-6)
    ok = near(p[0], F.element_at(p, -1)) | (edge(p[0]) & edge(F.element_at(p, -1)))
    return lines.groupBy(T.tag("tags", "ELEV").cast("double").alias("elev")).agg(F.sum(F.size(p) - 1).alias("segments"), F.round(F.sum(length(p)), 4).alias("length"), F.bool_and(ok).alias("ends_on_edge"))


@register(f"WITH {PTS}, {BXS}, t AS (SELECT event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(event_id % 240 AS INTEGER)) AS ts FROM events) SELECT CAST(epoch(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS day, p_partkey, CAST(count(*) AS BIGINT) AS n FROM pts JOIN t USING (event_id) JOIN bxs ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax GROUP BY 1, 2")
def stream_counts_in_boxes(spark, d):
    """Events as a stream of files, counted in boxes and days; a last file far in the future closes every window and is in no box."""
    folder = shared_folder(spark)
    p = features.points(spark, d).select("event_id", "lon", "lat", F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") % 240 * 3600).alias("ts"))
    p.write.parquet(f"{folder}/in/a")
    p.limit(1).select("event_id", F.lit(999.0).alias("lon"), F.lit(999.0).alias("lat"), F.timestamp_seconds(F.lit(4102444800)).alias("ts")).write.parquet(f"{folder}/in/b")
    stream = spark.readStream.schema(p.schema).parquet(f"{folder}/in/*")
    closed = boxes.run_available(boxes.counts_at_places(stream, "ts", "1 day", "1 hour"), f"{folder}/counts", spark)
    return boxes.counts_in_boxes(closed, features.boxes(spark, d), "p_partkey").select(F.unix_timestamp("window_start").alias("day"), "p_partkey", "n")
