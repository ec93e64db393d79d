"""Readers against small hand-made files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.functions.geometry import area
from isoline.sources import tiles
from isoline.sources.features import get_data
from isoline.sources.files import read_vector
from isoline.sources.geojson import read_geojson, to_geojson
from isoline.sources.graticule import graticule
from isoline.sources.rasters import raster_meta, read_raster

OSM = """<?xml version="1.0" encoding="UTF-8"?>
<osm version="0.6">
<node id="1" lat="0" lon="0"><tag k="amenity" v="cafe"/><tag k="note" v="x"/><tag k="amenity" v="bar"/></node>
<node id="2" lat="0" lon="4"><tag k="source:x" v="y"/></node>
<node id="3" lat="4" lon="4"/><node id="4" lat="4" lon="0"/>
<node id="5" lat="1" lon="1"/><node id="6" lat="1" lon="2"/><node id="7" lat="2" lon="2"/>
<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><tag k="highway" v="path"/><tag k="tiger:a" v="1"/></way>
<way id="11"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="1"/><tag k="building" v="yes"/></way>
<way id="12"><nd ref="5"/><nd ref="6"/><nd ref="7"/><nd ref="5"/><tag k="highway" v="service"/></way>
<way id="13"><nd ref="1"/><nd ref="99"/><nd ref="3"/><tag k="barrier" v="wall"/></way>
<relation id="20"><member type="way" ref="11" role="outer"/><member type="way" ref="12" role="inner"/><tag k="type" v="multipolygon"/><tag k="natural" v="water"/></relation>
<relation id="21"><member type="way" ref="10" role="outer"/><tag k="type" v="multipolygon"/></relation>
<relation id="22"><member type="way" ref="11" role="outer"/><tag k="type" v="route"/></relation>
</osm>"""

GEOJSON = """{"type":"FeatureCollection","features":[
{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2,9]},"properties":{"a":"x","b":true,"c":null,"d":{"e":1},"n":3}},
{"type":"Feature","geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4]]},"properties":null},
{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[3,4]]},"properties":{}},
{"type":"Feature","geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]},"properties":{}},
{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]],[[2,1],[3,2],[3,1],[2,1]]]},"properties":{}},
{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4],[0,0]]],[[[10,0],[14,0],[14,4],[10,0]]]]},"properties":{"k":"v"}},
{"type":"Feature","geometry":{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[7,8]},{"type":"LineString","coordinates":[[0,0],[1,0]]}]},"properties":{}},
{"type":"Feature","geometry":null,"properties":{}}]}"""

KML = """<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Placemark><name>p</name><ExtendedData><Data name="type"><value>lake</value></Data></ExtendedData><Polygon>
<outerBoundaryIs><LinearRing><coordinates>0,0,5 0,4 4,4 0,0</coordinates></LinearRing></outerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>1,2 2,3 1,3 1,2</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
<Placemark><name>q</name><MultiGeometry><Point><coordinates>1,2</coordinates></Point><LineString><coordinates>0,0
3,4</coordinates></LineString></MultiGeometry></Placemark><Placemark><name>none</name></Placemark></Document></kml>"""


def rows(df):
    return sorted(((r.geom_type, r.feature_id, [[tuple(p) for p in c] for c in r.parts], [tuple(t) for t in r.tags]) for r in df.collect()), key=str)


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text(OSM)
    found = {(k, i): (p, t) for k, i, p, t in rows(read_vector(spark, str(tmp_path / "a.osm")))}
    assert set(found) == {("point", 1), ("line", 10), ("polygon", 11), ("line", 12), ("line", 13), ("multipolygon", 20)}
    assert found["point", 1] == ([[(0.0, 0.0)]], [("amenity", "cafe"), ("amenity", "bar")])
    assert found["line", 13][0] == [[(0.0, 0.0), (4.0, 4.0)]]
    assert found["line", 13][1] == [("barrier", "wall"), ("isoline:incomplete", "yes")] and all(t[0] != "isoline:incomplete" for k, (_, tags) in found.items() if k != ("line", 13) for t in tags)
    outer, inner = found["multipolygon", 20][0]
    assert outer == [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    assert inner == [(1.0, 1.0), (2.0, 2.0), (2.0, 1.0), (1.0, 1.0)]  # was counter-clockwise


def test_geojson(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(GEOJSON)
    df = read_vector(spark, str(tmp_path / "a.geojson"))
    found = rows(df)
    assert sorted(k for k, *_ in found) == ["line", "line", "multiline", "multipoint", "multipolygon", "point", "point", "polygon", "polygon"]
    assert (("a", "x"), ("b", "True"), ("n", "3")) == tuple(t for t in next(t for *_, t in found if t and t[0][0] == "a") if t[0] in "abn")
    assert get_data(df, box_wgs84=(9, 20, -1, 5)).count() == 1
    to_geojson(df).write.text(str(tmp_path / "out"))
    again = rows(read_geojson(spark, str(tmp_path / "out"), lines=True))
    assert sorted(str((k, p)) for k, _, p, _ in again) == sorted(str((k, p)) for k, _, p, _ in found)


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    df = read_vector(spark, str(tmp_path / "a.kml"))
    found = {k: (p, t) for k, _, p, t in rows(df)}
    assert set(found) == {"multipolygon", "point", "line"}
    assert ("type", "lake") in found["multipolygon"][1] and ("name", "p") in found["multipolygon"][1]
    signs = df.where("geom_type = 'multipolygon'").select(F.transform("parts", lambda c: F.signum(area(c))).alias("s")).first().s
    assert signs == [1.0, -1.0]


def shp(kind, bodies):
    out = b"".join(struct.pack(">ii", k + 1, len(b) // 2) + b for k, b in enumerate(bodies))
    return struct.pack(">i20xi", 9994, 50 + len(out) // 2) + struct.pack("<ii64x", 1000, kind) + out


def test_shapefile(spark, tmp_path):
    line = struct.pack("<i32xiii", 3, 1, 2, 0) + struct.pack("<4d", 0, 0, 3, 4)
    ring = struct.pack("<i32xiii", 5, 1, 4, 0) + struct.pack("<8d", 0, 0, 0, 4, 4, 4, 0, 0)
    for name, kind, body in (("lines", 3, line), ("rings", 5, ring)):
        (tmp_path / f"{name}.shp").write_bytes(shp(kind, [body, struct.pack("<i", 0), body]))
    head = struct.pack("<B3xIHH20x", 3, 3, 32 + 32 + 1, 1 + 6) + struct.pack("<11sc4xB15x", b"NAME", b"C", 6) + b"\r"
    (tmp_path / "lines.dbf").write_bytes(head + b" first " + b" gone  " + b" third ")
    found = rows(read_vector(spark, str(tmp_path / "lines.shp")))
    assert [(k, i, t) for k, i, _, t in found] == [("line", 0, [("NAME", "first")]), ("line", 2, [("NAME", "third")])]
    ringed = rows(read_vector(spark, str(tmp_path / "rings.shp")))
    assert ringed[0][0] == "polygon" and ringed[0][2] == [[(0.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]] and ringed[0][3] == []


def test_unsupported(spark):
    with pytest.raises(ValueError):
        read_vector(spark, "a.xyz")


def test_graticule(spark):
    df = graticule(spark, (-20, 20, -10, 10), 10, 5, segments=2)
    lat = [float(t[0][1]) for _, _, _, t in rows(df) if t[0][0] == "Latitude"]
    assert min(lat) == -90 and max(lat) == 10
    first = df.where("geom_type = 'line' and tags[0].key = 'Latitude'").first().parts[0]
    assert first[0].x == -25 and first[-1].x == 20


def test_tiles(spark):
    boxes = spark.createDataFrame([(-4.5, -4.1, 55.8, 55.95, "g"), (-73.3, -69.56, 41.14, 42.53, "m")], "xmin double, xmax double, ymin double, ymax double, k string")
    t = tiles.cover(boxes)
    assert [r.n for r in t.where("k = 'g'").select(tiles.srtm_name(F.col("tx"), F.col("ty")).alias("n")).collect()] == ["N55W005"]
    names = sorted(r.n for r in t.where("k = 'm'").select(tiles.usgs_name(F.col("tx"), F.col("ty")).alias("n")).collect())
    assert len(names) == 10 and names[0] == "n42w070" and names[-1] == "n43w074"


def test_rasters(spark, tmp_path):
    a = np.arange(9, dtype=">i2").reshape(3, 3)
    (tmp_path / "N00E000.hgt").write_bytes(a.tobytes())
    np.save(tmp_path / "b.npy", np.arange(6, dtype="f4").reshape(2, 3))
    (tmp_path / "c.ppm").write_bytes(b"P6\n# x\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    tags = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (279, 4, 1, 4)]
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0"
    (tmp_path / "d.tif").write_bytes(b"II*\0" + struct.pack("<I", 12) + bytes([9, 8, 7, 6]) + ifd)
    df = read_raster(spark, str(tmp_path / "*"))
    meta = {r.raster_id: tuple(r)[1:] for r in raster_meta(df).collect()}
    assert meta == {"N00E000": (1, 3, 3, 0.0, 8.0), "b": (1, 3, 2, 0.0, 5.0), "c": (3, 2, 1, 1.0, 6.0), "d": (1, 2, 2, 6.0, 9.0)}
    (tmp_path / "e.jp2").write_bytes(b"x")
    with pytest.raises(Exception, match="not supported"):
        read_raster(spark, str(tmp_path / "e.jp2")).count()
