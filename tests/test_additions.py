"""Joins of boxes of all sizes, the data source, PNG, well-known text, predicates, blurs and contour lines on small cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.functions import crs, query, wkt
from isoline.operators import contour_lines, joins, raster
from isoline.render import png, svg
from isoline.sources import cache, datasource, hyphenation, world
from isoline.sources.features import finish, get_data
from isoline.sources.geojson import to_geojson

RNG = np.random.default_rng(31)


def boxes(spark, n, prefix):
    side = np.exp(RNG.uniform(-3, 6, n))
    x, y = RNG.uniform(-180, 180, (2, n))
    rows = [(i, float(a), float(a + s), float(b), float(b + s * RNG.uniform(0.1, 1))) for i, (a, b, s) in enumerate(zip(x, y, side))]
    return rows, spark.createDataFrame(rows, f"{prefix}k int, {prefix}x0 double, {prefix}x1 double, {prefix}y0 double, {prefix}y1 double")


def test_boxes_of_all_sizes(spark):
    (ra, a), (rb, b) = boxes(spark, 120, "a"), boxes(spark, 120, "b")
    want = {(p[0], q[0]) for p in ra for q in rb if p[2] > q[1] and p[1] < q[2] and p[4] > q[3] and p[3] < q[4]}
    got = [(r.ak, r.bk) for r in joins.bbox_join(a, b, ("ax0", "ax1", "ay0", "ay1"), ("bx0", "bx1", "by0", "by1"), 0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # a world-wide box on a fine grid lies in nine cells of its level at most
    one = spark.createDataFrame([(0, -180.0, 180.0, -90.0, 90.0)], "k int, x0 double, x1 double, y0 double, y1 double")
    box = ("x0", "x1", "y0", "y1")
    assert joins._cells(one, box, 0.001, "__r", joins._grid([(one, box)], 0.001)[1], own_only=True).count() <= 9
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(RNG.uniform(-180, 180, (300, 2)))]
    p = spark.createDataFrame(points, "id int, lon double, lat double")
    inside = {(i, q[0]) for i, x, y in points for q in rb if q[1] <= x <= q[2] and q[3] <= y <= q[4]}
    args = ("lon", "lat", ("bx0", "bx1", "by0", "by1"), 0.5)
    assert {(r.id, r.bk) for r in joins.points_in_boxes(p, b, *args).collect()} == inside
    assert {r.id for r in joins.points_in_boxes(p, b, *args, "left_anti").collect()} == {i for i, _, _ in points} - {i for i, _ in inside}
    assert sorted(r.id for r in joins.points_in_boxes(p, b, *args, "left_semi").collect()) == sorted({i for i, _ in inside})
    assert {(r.id, r.bk) for r in joins.points_in_boxes(p, b, *args, "left").collect()} == inside | {(i, None) for i, _, _ in points if i not in {j for j, _ in inside}}


def test_data_source_splits_and_pushes(spark, tmp_path):
    rows = [(i, "point", [[(float(i % 50), float(i // 50))]], [("k", str(i))]) for i in range(500)]
    f = finish(spark.createDataFrame(rows, "feature_id bigint, geom_type string, parts array<array<struct<x:double,y:double>>>, tags array<struct<key:string,value:string>>"))
    to_geojson(f).coalesce(2).write.text(f"{tmp_path}/g")
    datasource.register(spark)
    found = spark.read.format("isoline_geojson").option("range_bytes", 700).load(f"file://{tmp_path}/g")
    assert found.count() == 500 and found.rdd.getNumPartitions() > 20
    some = found.where("xmax > 10 and xmin < 20 and ymin >= 3")
    assert {r.tags[0].value for r in some.collect()} == {str(i) for i in range(500) if 10 < i % 50 < 20 and i // 50 >= 3}
    reader = datasource.GeoJsonReader(f"file://{tmp_path}/g", 1 << 20)
    assert len(list(reader.pushFilters([datasource.GreaterThan(("xmax",), 10.0), datasource.EqualTo(("tags",), 1)]))) == 2 and [c[0] for c in reader.checks] == ["xmax"]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(1 for i in range(500) if i % 50 > 10)


def test_png_filters():
    """Every filter of the format, written by hand, decodes to the same image."""
    import struct
    import zlib

    a = RNG.integers(0, 256, (10, 7, 3)).astype(np.int64)
    lines = []
    for y in range(10):
        kind, row = y % 5, a[y]
        left = np.vstack([np.zeros((1, 3), np.int64), row[:-1]])
        up = a[y - 1] if y else np.zeros((7, 3), np.int64)
        corner = np.vstack([np.zeros((1, 3), np.int64), up[:-1]])
        p = left + up - corner
        da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0 * left, left, up, (left + up) // 2, np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
    data = png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 2, 0, 0, 0)) + png._chunk(b"IDAT", zlib.compress(b"".join(lines))) + png._chunk(b"IEND", b"")
    assert (np.moveaxis(png.decode(data), 0, 2) == a).all()
    b = RNG.integers(0, 256, (5, 4, 4)).astype(np.uint8)
    assert (np.moveaxis(png.decode(png.encode(b)), 0, 2) == b).all()
    with pytest.raises(ValueError):
        png.decode(b"GIF89a")


def test_well_known_text(spark, tmp_path):
    for k in crs.KNOWN:
        assert wkt.from_wkt(wkt.to_wkt(k)) == k
    esri = 'PROJCS["WGS_1984_Web_Mercator_Auxiliary_Sphere",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]]]]'
    (tmp_path / "a.prj").write_text(esri)
    assert wkt.read_prj(spark, f"file://{tmp_path}/a.prj") == 3857 and wkt.srid_of("EPSG:4326") == 4326
    with pytest.raises(ValueError):
        wkt.from_wkt('GEOGCS["Mars 2000"]')
    crs.add_system(990001, "doubled", (-180, 180, -90, 90), lambda x, y: (x * 2, y * 2), lambda x, y: (x / 2, y / 2))
    try:
        x, y = crs.transform_xy(F.lit(3.0), F.lit(4.0), 4326, 990001)
        r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert (r.x, r.y) == (6, 8)
    finally:
        del crs.KNOWN[990001], crs._WORLD[990001]


def test_predicates_that_cannot_be_said():
    box = query.inside((0, 1, 0, 1))
    with pytest.raises(ValueError):
        (query.tag_exists("a") & box) | query.tag_exists("b")
    with pytest.raises(ValueError):
        query.coordinate("z", ">=", 1)
    with pytest.raises(ValueError):
        query.coordinate("x", ">=", 1).text()
    assert (query.tag_is("a", "1") & query.tag_is("a", "1")).any_of == ((("a", "1"),),)


@pytest.mark.parametrize("radius", [1, 5, 20, 200])
def test_blur_is_a_convolution(spark, radius):
    a = RNG.normal(size=(23, 41))
    cells = spark.createDataFrame([("r", x, y, float(a[y, x])) for y in range(23) for x in range(41)], "raster_id string, x int, y int, value double")
    k = np.array(raster.gaussian_kernel(radius))
    r = len(k) // 2
    want = np.pad(a, r, mode="edge")
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 1, want)
    want = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), 0, want)
    got = np.zeros_like(a)
    for c in raster.gaussian_blur(cells, radius, 41, 23).collect():
        got[c.y, c.x] = c.value
    assert got == pytest.approx(want, abs=1e-9)


def test_blur_tiles_meet(spark, monkeypatch):
    monkeypatch.setattr(raster, "TILE", 8)
    test_blur_is_a_convolution(spark, 5)


def test_contour_of_a_hill(spark):
    """A round hill gives one closed line a level, whatever the tiles."""
    rows = [("r", x, y, 100 - math.hypot(x - 20.3, y - 15.7) * 4) for x in range(41) for y in range(33)]
    cells = spark.createDataFrame(rows, "raster_id string, x int, y int, value double")
    for tile in (7, 100):
        lines = contour_lines.contour_lines(cells, 20.0, tile=tile).where("elev >= 60").collect()
        assert sorted(r.elev for r in lines) == [60, 80] and all(r.closed for r in lines)
        assert len(lines[0].points) == len(set((round(p.x, 6), round(p.y, 6)) for p in lines[0].points)) + 1


def test_labels_lie_upwards(spark):
    """The long side of a label's box lies above its place on the page: a second label fits half a height below, not above."""
    tags = lambda t: [("n", t)]
    make = lambda rows: finish(spark.createDataFrame(rows, "feature_id bigint, geom_type string, parts array<array<struct<x:double,y:double>>>, tags array<struct<key:string,value:string>>"))
    m = svg.Map((0, 100, 0, 100), 100, 100, layers=[svg.Layer("a", "s", svg.Style(label_tag="n", label_size=4))])
    f = make([(1, "point", [[(50.0, 50.0)]], tags("abcd"))])
    r = svg.draw(m, {"s": (f, 4326)}).collect()
    assert 'x="50.000" y="50.000"' in r[0].svg
    below = make([(1, "point", [[(50.0, 50.0)]], tags("abcd")), (2, "point", [[(50.0, 43.9)]], tags("abcd"))])
    above = make([(1, "point", [[(50.0, 50.0)]], tags("abcd")), (2, "point", [[(50.0, 56.1)]], tags("abcd"))])
    # below: the second box reaches up to 47.9, the first starts at 48; above: the first reaches to 54, the second starts at 54.1
    for f in (below, above):
        assert sorted(x.split('x="')[1][:6] for x in (r.svg for r in svg.draw(m, {"s": (f, 4326)}).collect())) == ["50.000", "50.000"]
    near = make([(1, "point", [[(50.0, 50.0)]], tags("abcd")), (2, "point", [[(50.0, 44.1)]], tags("abcd"))])
    got = sorted(r.svg for r in svg.draw(m, {"s": (near, 4326)}).collect())
    assert len(got) == 2 and sum('y="55.900"' in g for g in got) == 0  # it had to move


def test_cached_files(spark, tmp_path):
    store, asked = cache.FileCache(spark, f"file://{tmp_path}/store"), tmp_path / "asked"
    asked.mkdir()

    def fetch(url):
        import io
        import uuid
        import zipfile

        (asked / uuid.uuid4().hex).write_text(url)
        if "none" in url:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("d/a.shp", url.encode())
        return out.getvalue() if url.endswith(".zip") else url.encode()

    wanted = spark.createDataFrame([("a.zip", "http://x/a.zip"), ("b", "http://x/b"), ("c", "http://x/none"), ("b", "http://x/b"), (None, "http://x/d")], "name string, url string")
    states = lambda **k: {r["name"]: r["state"] for r in store.get(wanted, fetch, **k).collect()}
    assert states(now=0) == {"a.zip": "fetched", "b": "fetched", "c": "absent"} and len(list(asked.iterdir())) == 3
    assert states(now=10) == {"a.zip": "cached", "b": "cached", "c": "known absent"} and len(list(asked.iterdir())) == 3
    assert states(now=100, max_age_s=50, absent_age_s=200) == {"a.zip": "fetched", "b": "fetched", "c": "known absent"}
    assert states(now=120, max_age_s=50, absent_age_s=60) == {"a.zip": "cached", "b": "cached", "c": "absent"} and len(list(asked.iterdir())) == 6
    path = {r["name"]: r["path"] for r in store.entries().collect()}
    assert (tmp_path / "store/files/a/a.shp").read_bytes() == b"http://x/a.zip" and path["a.zip"].endswith("/files/a") and path["c"] is None
    assert store.newest("b", "", 60, now=130) == path["b"] and store.newest("b", "", 10, now=130) is None and store.newest("c", "", 1e9) is None
    assert store.get(wanted.limit(0), fetch).count() == 0


def test_world_files(spark, tmp_path):
    """A theme's Shapefile through the catalogue and the cache, with its .prj; a file that is not there raises."""
    import io
    import zipfile

    from isoline.plans.files import _shapefile
    from isoline.functions import wkt as w
    import pandas as pd

    shp, dbf = _shapefile(pd.DataFrame({"event_id": [7, 8], "lon": [500_000.0, 600_000.0], "lat": [0.0, 5e6]}))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for end, data in (("shp", shp), ("dbf", dbf), ("prj", w.to_wkt(32633).encode())):
            z.writestr(f"ne_10m_ports.{end}", data)
    data = out.getvalue()
    fetch = lambda url: data if url == "https://naciscdn.org/naturalearth/10m/cultural/ne_10m_ports.zip" else None
    found = world.read_world_vector(spark, "ports", 10, f"file://{tmp_path}/c", fetch)
    assert sorted(r.xmin for r in found.collect()) == [500_000.0, 600_000.0]  # in the file's own system, which its .prj names
    assert w.read_prj(spark, f"file://{tmp_path}/c/files/ne_10m_ports/ne_10m_ports.prj") == 32633
    assert min(round(r.xmin, 6) for r in get_data(found, 32633, target=4326).collect()) == 15.0
    with pytest.raises(FileNotFoundError):
        world.read_world_vector(spark, "roads", 10, f"file://{tmp_path}/c", fetch)
    with pytest.raises(ValueError):
        world.vector_path("ports", 110)


def test_query_texts():
    """The query language's own examples of what a predicate says."""
    box, stop = query.inside((10.7, 10.8, 59.9, 60.0)), query.tag_is("highway", "bus_stop")
    assert (query.tag_is("natural", "wetland") & box).text("shape") == '[out:xml];\nnwr["natural"="wetland"](59.9,10.7,60,10.8);\nout body;'
    assert (stop & query.tag_is_not("shelter", "no")).text("point") == '[out:xml];\nnode["highway"="bus_stop"]["shelter"!="no"];\nout body;'
    assert (query.tag_among("highway", ["motorway", "primary"]) & box).text("line") == '[out:xml];\nway(\n  ["highway"="motorway"](59.9,10.7,60,10.8);\n  ["highway"="primary"](59.9,10.7,60,10.8);\n  );\nout body;'
    assert query.tag_is("natural", "coastline").text("line", timeout=3600) == '[out:xml][timeout:3600];\nway["natural"="coastline"];\nout body;'
    assert stop.text("point", take=100) == '[out:xml];\nnode["highway"="bus_stop"];\nout body 100;'
    assert query.tag_exists("highway").text("point") == '[out:xml];\nnode["highway"];\nout body;'


def test_hyphenation_files(spark, tmp_path):
    """A folder of lists: by-language rows, exceptions, a mark at the start, remarks; a language without patterns is none."""
    (tmp_path / "hyph-en-us.pat.txt").write_bytes("\ufeffhy3ph\n% a remark\n\nhe2n\nhena4\nhen5at\n1na\nn2at\n1tio\n2io\n".encode())
    (tmp_path / "hyph-en-us.hyp.txt").write_text("ta-ble\n")
    (tmp_path / "hyph-nb.hyp.txt").write_text("ab-c\n")
    (tmp_path / "hyph-cs.pat.txt").write_text("\u010d1a\n", encoding="utf-8")
    lists = hyphenation.read_hyphenation(spark, f"file://{tmp_path}")
    assert set(lists) == {"en-us", "cs"} and lists["en-us"][1] == ["ta-ble"]
    rows = [("Hyphenation, Table!", "en-us"), ("Hyphenation", "cs"), ("ko\u010da\u010da kabinka", "cs"), (None, "cs"), ("abc", "nb"), ("abc", None)]
    got = spark.createDataFrame(rows, "t string, k string").select(hyphenation.hyphenate_by(F.col("t"), F.col("k"), lists).alias("h")).collect()
    assert [r.h for r in got] == ["Hy|phen|ation, Ta|ble!", "Hyphenation", "ko\u010d|a\u010da kabinka", None, "abc", "abc"]


def test_dense_cells_are_dealt(spark):
    """Half of the points lie in one cell: the same pairs, and no key holds many times what the others do."""
    rng = np.random.default_rng(12)
    xy = np.concatenate([rng.uniform(0, 0.9, (4000, 2)), rng.uniform(-40, 40, (4000, 2))])
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "id int, x double, y double")
    corners = rng.uniform(-40, 40, (300, 2)).tolist() + [[0.1, 0.1], [-50.0, -50.0]]
    sides = rng.uniform(0.5, 2, 300).tolist() + [0.5, 100.0]
    b = spark.createDataFrame([(k, x, x + s, y, y + s) for k, ((x, y), s) in enumerate(zip(corners, sides))], "bk int, x0 double, x1 double, y0 double, y1 double")
    box = ("x0", "x1", "y0", "y1")
    want = {(i, k) for k, ((a, c), s) in enumerate(zip(corners, sides)) for i in np.flatnonzero((xy[:, 0] >= a) & (xy[:, 0] <= a + s) & (xy[:, 1] >= c) & (xy[:, 1] <= c + s)).tolist()}
    for how in ("inner", "left"):
        got = [(r.id, r.bk) for r in joins.points_in_boxes(points, b, "x", "y", box, how=how, dense=100).collect() if r.bk is not None]
        assert len(got) == len(want) and set(got) == want
    left = joins._cells(points.toDF("id", "x", "y").withColumns({"x1": F.col("x"), "y1": F.col("y")}), ("x", "x1", "y", "y1"), 1.0, "__l", 0)
    dealt, every = joins._dealt(left, joins._cells(b, box, 1.0, "__r", 0), 100)
    most = dealt.groupBy("__lcx", "__lcy", "__lpart").count().agg(F.max("count")).first()[0]
    assert most < 200 and dealt.count() == 8000
    boxes2 = b.toDF("ak", "a0", "a1", "c0", "c1")
    pairs = lambda **k: sorted((r.ak, r.bk) for r in joins.bbox_join(boxes2, b, ("a0", "a1", "c0", "c1"), box, **k).collect())
    assert pairs(dense=3) == pairs(size=7.0) == pairs() and len(pairs()) > 600
    assert joins.bbox_join(boxes2.where("ak < 0"), b, ("a0", "a1", "c0", "c1"), box).count() == 0
