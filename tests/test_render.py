"""Canvas fit, placement, simplification, smoothing, poles, hyphenation and SVG: fixed values, invariants, brute force."""

import math
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from isoline.functions import algorithms as A
from isoline.functions import color, coords, crs, geometry
from isoline.operators import raster_levels as L
from isoline.render import canvas, labels, svg
from isoline.sources.features import finish

RNG = np.random.default_rng(12345)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def pts(*xy):
    return F.array(*(geometry.point(F.lit(float(x)), F.lit(float(y))) for x, y in xy))


def xy(points):
    return [(round(p.x, 9), round(p.y, 9)) for p in points]


TEST_POLYGON = ((1, 1), (8, -2), (7, 5), (6, 2), (5, 3), (1, 1))


def test_fit():
    for strategy in ("stretch", "center", "crop", "extend"):
        for box in ((0, 20, 0, 10), (0, 10, 0, 20)):
            f = canvas.fit(box, 100, 100, strategy)
            mid = (f.box[0] + f.box[1]) / 2 * f.scale_x + f.offset_x, (f.box[2] + f.box[3]) / 2 * f.scale_y + f.offset_y
            assert mid == pytest.approx((50, 50))
            if strategy != "stretch":
                assert f.scale_x == pytest.approx(f.scale_y)
    assert canvas.fit((0, 20, 0, 10), 100, 100, "extend").box == (0, 20, -5, 15)
    assert canvas.fit((0, 20, 0, 10), 100, 100, "crop").box == (5, 15, 0, 10)
    assert canvas.fit((0, 20, 0, 10), 100, 100, "center").offset_y == 25
    assert canvas.convert(25.4, "mm", "pixel") == pytest.approx(90)


def test_first_fit_against_brute_force():
    c, s = RNG.uniform(0, 1000, (400, 2)), RNG.uniform((10, 5), (40, 15), (400, 2))
    boxes = [[[x, x + w, y, y + h], [x - w, x, y, y + h]] for (x, y), (w, h) in zip(c, s)]
    got, placed, want = labels.first_fit(boxes, 25), [], []
    for options in boxes:
        k = next((k for k, b in enumerate(options) if not any(b[0] < o[1] and b[1] > o[0] and b[2] < o[3] and b[3] > o[2] for o in placed)), -1)
        want.append(k)
        if k >= 0:
            placed.append(options[k])
    assert got == want and -1 in want


def test_simplify(spark):
    line = np.cumsum(RNG.normal(size=(60, 2)), axis=0)
    for f in (A.split_kept, A.small_triangles_kept):
        kept = f(line, 12, 0.0 if f is A.split_kept else math.inf)
        assert len(kept) == 12 and kept[0] == 0 and kept[-1] == 59 and kept == sorted(set(kept))
    assert A.split_kept(line, 0, 0) == list(range(60))
    kept = A.split_kept(line, 10**9, 1.5)
    for a, b in zip(kept, kept[1:]):  # all that went is near its chord
        d = line[b] - line[a]
        for p in line[a + 1 : b]:
            t = np.clip((p - line[a]) @ d / (d @ d), 0, 1)
            assert np.hypot(*(p - line[a] - t * d)) <= 1.5
    assert A.split_kept(np.array([[0, 0], [1, 0], [math.nan, math.nan], [2, 0], [3, 1], [4, 0]]), 10**9, 0.5) == [0, 1, 2, 3, 4, 5]
    assert A.small_triangles_kept(np.array([[0, 0], [1, 0.1], [2, 0], [3, 5], [4, 0.0]]), 3, 1.0) == [0, 2, 3, 4]
    r = one(spark, A.douglas_peucker(pts((0, 0), (1, 0.1), (2, 0), (3, 5)), tolerance=0.2).alias("a"), A.visvalingam_whyatt(pts((0, 0), (1, 0.1), (2, 0), (3, 5)), 3).alias("b"), A.douglas_peucker(F.lit(None).cast("array<struct<x:double,y:double>>")).alias("n"))
    assert xy(r.a) == [(0, 0), (2, 0), (3, 5)] == xy(r.b) and r.n is None


def test_simplify_ties():
    """Of vertices equally far from a chord the first is taken, and vertices on one place are one place."""
    assert A.split_kept(np.array([[22, 19], [29, 24], [45, 28], [54, 27], [71, 4.0]]), 10**9, 2.1234567) == [0, 1, 3, 4]
    assert A.split_kept(np.array([[35, 13], [40, 42], [41, 41], [58, 33], [63, 32], [65, 37.0]]), 10**9, 2.1234567) == [0, 1, 3, 4, 5]
    assert A.split_kept(np.zeros((3, 2)), 10**9, 2.1234567) == [0, 2]


def test_smoothing_of_many_lines(monkeypatch):
    """Lines smoothed together come out as each alone; one of repeated, missing or no vertices holds up none."""
    monkeypatch.setattr(A, "VERTICES", 40)
    rows = [RNG.normal(size=(n, 2)) * 10 for n in RNG.integers(0, 9, 60)] + [np.array([[0, 0], [1, 1], [1, 1], [0, 0.0]]), np.array([[0, 0], [math.nan, 1], [1, 5], [0, 0.0]])]
    x, y = (pd.Series([None, *(r[:, k] for r in rows), None], dtype=object) for k in (0, 1))
    got = A._smoothed(x, y, math.radians(20))
    assert got[0] is None and got[-1] is None
    for r, q in zip(rows, got[1:-1], strict=True):
        assert np.array_equal(A.smooth_points(r, False, math.radians(20)).ravel(), q, equal_nan=True)


def test_smoothing(spark):
    ring = np.array(TEST_POLYGON, float)
    for closed in (False, True):
        p = A.smooth_points(ring, closed, math.radians(10))
        d = np.diff(np.concatenate([p, p[1:2]]) if closed else p, axis=0)
        turn = np.arccos(np.clip((d[1:] * d[:-1]).sum(axis=1) / (np.hypot(*d[1:].T) * np.hypot(*d[:-1].T)), -1, 1))
        assert turn.max() <= math.radians(20) + 1e-9 and (p[0] == p[-1]).all()
    r = one(spark, geometry.chaikin_closed(pts(*TEST_POLYGON)).alias("c"), geometry.chaikin(pts((0, 0), (4, 0), (4, 4)), 2).alias("o"), A.chaikin_adaptive(pts((0, 0), (4, 0), (4, 4)), 50.0).alias("a"))
    assert len(r.c) == 11 and r.c[0] == r.c[-1] and len(r.o) == 6 and xy(r.a) == [(0, 0), (4, 0), (4, 4)]


def test_pole(spark):
    square = pts((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    hole = pts((1, 1), (1, 9), (5, 9), (5, 1), (1, 1))
    r = one(spark, A.pole_of_inaccessibility(F.array(square)).alias("a"), A.pole_of_inaccessibility(F.array(square, hole), 0.01).alias("b"), geometry.signed_distance(square, F.lit(2.0), F.lit(5.0)).alias("d"), geometry.centroid(square).alias("c"))
    assert tuple(r.a) == pytest.approx((5, 5, 5)) and r.b.distance == pytest.approx(2.5, abs=0.02) and r.b.x > 5
    assert r.d == 2 and tuple(r.c) == (5, 5)


def test_vectors(spark):
    p = lambda x, y: geometry.point(F.lit(float(x)), F.lit(float(y)))
    r = one(
        spark,
        coords.segment_intersection(p(1, 1), p(4, 3), p(1, 2), p(6, 3)).alias("a"), coords.segment_intersection(p(1, 1), p(6, 3), p(1, 2), p(6, 4)).alias("b"), coords.segment_intersection(p(1, 3), p(6, 4), p(1, 1), p(6, 3)).alias("c"),
        coords.segment_distance(p(0, 2), p(1, 0), p(5, 0)).alias("d"), coords.segment_distance(p(3, 4), p(0, 0), p(0, 0)).alias("e"), coords.angle(p(1, 0), p(0, 2)).alias("f"), coords.angle(p(0, 0), p(0, 2)).alias("g"), coords.triangle_area(p(0, 0), p(4, 0), p(0, 3)).alias("h"),
        geometry.point_along(pts((0, 0), (4, 0), (4, 4)), 0.75).alias("i"), geometry.midpoint(pts((0, 0), (4, 0))).alias("j"), geometry.offset_line(pts((0, 0), (4, 0), (4, 0), (4, 4)), 1.0).alias("k"), geometry.point_along(pts((0, 0), (4, 0)), 0.5, True).alias("l"),
    )
    assert tuple(r.a) == pytest.approx((3.142857142857143, 2.4285714285714284)) and r.b is None and r.c is None
    assert r.d == pytest.approx(math.sqrt(5)) and r.e == 5 and r.f == pytest.approx(math.pi / 2) and math.isnan(r.g) and r.h == 6
    assert tuple(r.i) == (4, 2) and tuple(r.j) == (2, 0) and xy(r.k) == [(0, -1), (4, -1), (5, 0), (5, 4)] and tuple(r.l) == (4, 0)


def test_world_projections(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in (-170, -60, 0, 25, 179) for y in (-80, -30, 0, 12, 45, 85)], "x double, y double")
    for s in (crs.ROBINSON, crs.VAN_DER_GRINTEN, 3857):
        u, v = crs.transform_xy(F.col("x"), F.col("y"), 4326, s)
        a, b = crs.transform_xy(F.col("u"), F.col("v"), s, 4326)
        far = df.withColumns({"u": u, "v": v}).select(F.max(F.abs(a - F.col("x")) + F.abs(b - F.col("y"))).alias("d")).first().d
        assert far < 1e-6
    u, v = crs.transform_xy(F.lit(180.0), F.lit(90.0), 4326, crs.ROBINSON)
    r = one(spark, u.alias("u"), v.alias("v"), crs.transform_xy(F.lit(0.0), F.lit(90.0), 4326, crs.VAN_DER_GRINTEN)[1].alias("w"))
    assert r.u == pytest.approx(0.8487 * 0.5322 * math.pi * crs.RADIUS) and r.v == pytest.approx(1.3523 * crs.RADIUS) and r.w == pytest.approx(math.pi * crs.RADIUS)
    assert crs.srid("EPSG:3857") == 3857 and crs.srid("WGS 84") == 4326
    with pytest.raises(ValueError):
        crs.srid("EPSG:1")


def test_colors(spark):
    import colorsys

    df = spark.createDataFrame([tuple(map(float, c)) for c in RNG.uniform(size=(50, 3))] + [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.0, 0.0)], "r double, g double, b double")
    c = tuple(F.col(k) for k in "rgb")
    hsl, hsv = color.rgb_to_hsl(*c), color.rgb_to_hsv(*c)
    for r in df.select("r", "g", "b", F.array(*hsl).alias("hsl"), F.array(*hsv).alias("hsv"), F.array(*color.hsl_to_rgb(*hsl)).alias("p"), F.array(*color.hsv_to_rgb(*hsv)).alias("q")).collect():
        h, light, s = colorsys.rgb_to_hls(r.r, r.g, r.b)
        assert r.hsl == pytest.approx([h, s, light], abs=1e-9) and r.hsv == pytest.approx(colorsys.rgb_to_hsv(r.r, r.g, r.b), abs=1e-9)
        assert r.p == pytest.approx([r.r, r.g, r.b], abs=1e-9) and r.q == pytest.approx([r.r, r.g, r.b], abs=1e-9)
    texts = spark.createDataFrame([("#734",), ("#ABCD",), ("#c82365",), ("#c8236544",), ("123",), ("#ffee8",), ("",)], "t string")
    got = [tuple(r) for r in texts.select(*color.from_hex(F.col("t"))).collect()]
    assert got == [(0x77, 0x33, 0x44, 255), (0xAA, 0xBB, 0xCC, 0xDD), (0xC8, 0x23, 0x65, 255), (0xC8, 0x23, 0x65, 0x44)] + [(None,) * 4] * 3


def test_levels(spark):
    assert L.identity(3) == [0, 0.5, 1] and L.midpoint(0.5, 3) == [0, 0.5, 1] and L.quantized(2, 5) == [0, 0.5, 0.5, 1, 1]
    r = one(spark, *(L.apply(L.identity(256))(F.lit(v)).alias(n) for v, n in ((0.5, "a"), (-3.0, "b"), (2.0, "c"))))
    assert r.a == pytest.approx((256.5 * 0.5) / 255) and r.b == 0 and r.c == 1


def test_hyphenation(spark):
    patterns = ["hy3ph", "he2n", "hena4", "hen5at", "1na", "n2at", "1tio", "2io", "o2n"]  # of Liang's thesis
    tables = A.hyphenation_tables(patterns, ["ta-ble"])
    assert A.breaks("hyphenation", tables) == [2, 6] and A.breaks("table", tables) == [2]
    assert one(spark, A.hyphenate(F.lit("Hyphenation, table!"), patterns, ["ta-ble"]).alias("t")).t == "Hy|phen|ation, ta|ble!"


def test_svg(spark):
    rows = [(1, "polygon", [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]], [("name", "a<b")]), (2, "line", [[(0.0, 0.0), (10.0, 10.0)]], [("name", "l")]), (3, "point", [[(5.0, 5.0)]], [("name", "p")]), (4, "point", [[(500.0, 5.0)]], [("name", "far")])]
    df = finish(spark.createDataFrame(rows, "feature_id long, geom_type string, parts array<array<struct<x:double,y:double>>>, tags array<struct<key:string,value:string>>"))
    m = svg.Map((0, 10, 0, 10), 100, 100, layers=[svg.Layer("land", "s", svg.Style(fill="#ff0000"), mask="cut"), svg.Layer("cut", "s", svg.Style(stroke="#ffffff")), svg.Layer("names", "s", svg.Style(symbol_radius=1, fill="#000000", label_tag="name", label_size=4), where=F.col("geom_type") == "point")])
    text = svg.document(m, svg.draw(m, {"s": (df, 4326)}))
    root = ET.fromstring(text)
    assert [g.get("id") for g in root if g.tag.endswith("}g")] == ["land", "names"]
    assert "M 0.000 100.000 L 100.000 100.000 L 100.000 0.000 L 0.000 0.000 L 0.000 100.000 Z" in text
    assert text.count("<circle") == 1 and text.count("<text") == 1 and 'mask="url(#mask-cut)"' in text and "far" not in text
    with pytest.raises(KeyError):
        svg.draw(svg.Map((0, 1, 0, 1), 1, 1, layers=[svg.Layer("x", "none", svg.Style())]), {})


def test_drawing_finds_each_anchor_once(spark):
    """Symbols, labels and their placement read anchors that are kept: poles are not found again for each."""
    tags = F.array(F.struct(F.lit("name").alias("key"), F.col("id").cast("string").alias("value")))
    p = lambda x, y: F.struct((F.col("id") % 5 * 20.0 + x).alias("x"), F.lit(float(y)).alias("y"))
    f = finish(spark.range(40).select(F.col("id").alias("feature_id"), F.lit("polygon").alias("geom_type"), F.array(F.array(p(0, 0), p(9, 0), p(9, 9), p(0, 9), p(0, 0))).alias("parts"), tags.alias("tags")))
    m = svg.Map((0, 100, 0, 50), 1000, 500, layers=[svg.Layer("names", "f", svg.Style(symbol_radius=2.0, fill="#ff0000", label_tag="name", label_size=8))])
    drawn = svg.draw(m, {"f": (f, 4326)})
    assert drawn.where("part = 1").count() == 5
    assert "ArrowEvalPython" not in drawn.where("part > 0")._jdf.queryExecution().executedPlan().toString()
