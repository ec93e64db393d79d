"""Unions, offsets and buffers: exact areas where they are known, membership of random places elsewhere."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.functions import regions as R
from isoline.operators import dissolve


def ring(*xy):
    return np.array([*xy, xy[0]], float)


def area(rings):
    return sum(float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2 for r in rings)


SQUARE = ring((0, 0), (10, 0), (10, 10), (0, 10))
DISC = 12 * math.sin(math.pi / 12)  # the area of the polygon of 24 corners
TEST_POLYGON = ring((1, 1), (8, -2), (7, 5), (6, 2), (5, 3))


def test_union():
    other = SQUARE + [5, 5]
    assert area(R.union([SQUARE, other])) == pytest.approx(175)
    assert area(R.union([SQUARE, SQUARE])) == pytest.approx(100) and len(R.union([SQUARE])[0]) == 5
    assert [len(r) for r in R.union([SQUARE, SQUARE + [10, 0]])] == [5]  # a shared side goes
    assert len(R.union([SQUARE, SQUARE + [10, 10]])) == 2  # a shared corner does not join
    hole = ring((2, 2), (2, 8), (8, 8), (8, 2))
    assert area(R.union([SQUARE, hole])) == pytest.approx(64) and len(R.union([SQUARE, hole])) == 2
    assert area(R.union([SQUARE, hole, ring((3, 3), (4, 3), (4, 4), (3, 4))])) == pytest.approx(65)
    assert R.union([]) == []


def test_offset():
    assert area(R.offset_rings([SQUARE], 1)) == pytest.approx(140 + DISC)
    assert area(R.offset_rings([SQUARE], -1)) == pytest.approx(64)
    assert R.offset_rings([SQUARE], -5.1) == []
    sizes = [area(R.offset_rings([TEST_POLYGON], r)) for r in (-0.4, -0.2, 0, 0.2, 0.4, 0.8)]
    assert sizes == sorted(sizes) and sizes[2] == pytest.approx(abs(area([TEST_POLYGON])))
    assert R.offset_rings([TEST_POLYGON], -2) == []


def test_buffer():
    assert area(R.buffer_lines([np.array([[0, 0], [10, 0.0]])], 1)) == pytest.approx(20 + DISC)
    assert area(R.buffer_lines([np.array([[0, 0.0]]), np.array([[50, 0.0]])], 2)) == pytest.approx(8 * DISC)


def test_membership():
    rng = np.random.default_rng(7)
    shapes = []
    for _ in range(12):
        t = np.sort(rng.uniform(0, 2 * math.pi, 7))
        p = rng.uniform(0, 20, 2) + np.column_stack([np.cos(t), np.sin(t)]) * rng.uniform(2, 6)
        shapes.append(np.concatenate([p, p[:1]]))
    at = rng.uniform(-6, 26, (3000, 2))
    want = np.any([R.winding(at, R.edges_of([s])) > 0 for s in shapes], axis=0)
    got = R.winding(at, R.edges_of(R.union(shapes)))
    assert ((got > 0) == want).all() and set(got) == {0, 1}
    grown = R.winding(at, R.edges_of(R.offset_rings(R.union(shapes), 0.5))) > 0
    e = R.edges_of(R.union(shapes))
    d = e[:, 2:] - e[:, :2]
    t = np.clip(((at[:, None] - e[None, :, :2]) * d).sum(axis=2) / (d * d).sum(axis=1), 0, 1)
    far = np.hypot(*np.moveaxis(e[None, :, :2] + t[..., None] * d - at[:, None], 2, 0)).min(axis=1)
    sure = np.abs(far - 0.5) > 0.01
    assert (grown == (want | (far < 0.5)))[sure].all()


def test_columns(spark):
    rows = [(1, "a", [[tuple(map(float, p)) for p in SQUARE]]), (2, "a", [[tuple(map(float, p)) for p in SQUARE + [5, 0]]]), (3, "b", [[tuple(map(float, p)) for p in SQUARE]]), (4, "c", None)]
    df = spark.createDataFrame(rows, "id long, k string, parts array<array<struct<x:double,y:double>>>")
    size = lambda parts: None if parts is None else round(area([np.array([tuple(p) for p in c]) for c in parts]), 6)
    assert {r.k: size(r.parts) for r in dissolve.dissolve(df, "k", "parts", 4.0).collect()} == {"a": 150.0, "b": 100.0}
    r = {r.id: (size(r.o), size(r.b)) for r in df.select("id", R.offset_polygon(F.col("parts"), -1.0).alias("o"), R.buffer_line(F.col("parts"), 1.0).alias("b")).collect()}
    assert r[1][0] == 64 and r[4] == (None, None) and r[1][1] == pytest.approx(140 + DISC - 64)


def test_ring_offset_is_many_tasks(spark):
    """A small file is dealt over all cores."""
    from isoline.plans import registry

    df = registry.queries()["ring_offset"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_segment_buffer_is_many_tasks(spark):
    """A small file is dealt over all cores."""
    from isoline.plans import registry

    df = registry.queries()["segment_buffer"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_ring_pole_is_many_tasks(spark):
    """A small file is dealt over all cores."""
    from isoline.plans import registry

    df = registry.queries()["ring_pole"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
