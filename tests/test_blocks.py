"""Joins by blocks against brute force: copies, several levels, touching boxes, nulls and values that are not numbers."""

import math

import numpy as np
import pytest

from isoline.operators import blocks

BOX = ("x0", "x1", "y0", "y1")


def boxes_of(rng, n):
    at, side = rng.integers(-20, 20, (n, 2)) / 2, rng.choice([0.5, 1, 2, 4, 30], (n, 2), p=[0.4, 0.3, 0.15, 0.1, 0.05])
    out = [(k, float(x), float(x + w), float(y), float(y + h)) for k, ((x, y), (w, h)) in enumerate(zip(at, side, strict=True))]
    return out + [(n + k, *out[0][1:]) for k in range(40)] + [(-1, 1.0, 1.0, 0.0, 3.0), (-2, None, 1.0, 0.0, 1.0)]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "COPIES", 8)


def test_self_pairs(spark, small):
    rows = boxes_of(np.random.default_rng(3), 150)
    want = sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if None not in a + b and a[1] < a[2] and b[1] < b[2] and a[2] > b[1] and a[1] < b[2] and a[4] > b[3] and a[3] < b[4])
    df = spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double")
    for size in (None, 0.5):
        got = blocks.self_pairs(df, "id", BOX, size)
        assert sorted((r.a, r.b) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism  # small files are still many tasks' work
    assert blocks.self_pairs(df.where("id < -5"), "id", BOX).count() == 0


def test_totals_in_boxes(spark, small):
    rng = np.random.default_rng(4)
    rows = boxes_of(rng, 150)
    points = [(float(x), float(y), int(d), [None, math.nan, 1.5, -2.0, 7.0][v]) for x, y, d, v in zip(rng.integers(-24, 30, 400) / 2, rng.integers(-24, 30, 400) / 2, rng.integers(0, 3, 400), rng.integers(0, 5, 400))] + [(None, 1.0, 0, 1.0)]
    b = spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double")
    p = spark.createDataFrame(points, "x double, y double, day long, v double")
    key = lambda v: (v is None, v is not None and math.isnan(v), 0.0 if v is None or math.isnan(v) else v)  # noqa: E731  NaN is the greatest
    want = {}
    for k, x0, x1, y0, y1 in rows:
        for x, y, day, v in points:
            if None not in (x0, x) and x0 <= x <= x1 and y0 <= y <= y1:
                want.setdefault((k, day), []).append(v)
    got = blocks.totals_in_boxes(p, b, "x", "y", BOX, value="v", by="day").collect()
    assert len(got) == len(want)
    for r in got:
        vs = want[r.id, r.day]
        known = sorted((v for v in vs if v is not None), key=key)
        assert r.n == len(vs) and key(r.vmin) == key(known[0] if known else None) and key(r.vmax) == key(known[-1] if known else None)
    every = blocks.totals_in_boxes(p, b, "x", "y", BOX).collect()
    assert {r.id: r.n for r in every} == {k: sum(len(v) for (i, _), v in want.items() if i == k) for k, _ in want}


def test_points_in_rings_meets_places(spark, tmp_path):
    """Many points of one place are one row when rings are met, and all are counted."""
    from isoline.plans import registry

    spark.range(4160 * 5).selectExpr("id as c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).selectExpr("id as s_suppkey", "cast(4 as int) as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    df = registry.queries()["points_in_rings"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.rindex("Aggregate") > plan.index("Join")
    got, where = {r.s_suppkey: r.n for r in df.collect()}, [(k * 13 % 320 + 0.5, k * 7 % 130 + 0.5) for k in range(4160 * 5)]
    for k in range(3):
        x, y, w, h = k * 31 % 300, k * 17 % 120, 5, k % 7 + 1
        assert got.get(k, 0) == sum(x < px < x + w and y < py < y + h for px, py in where)


def test_stream_counts_keep_places_as_state(spark):
    """The stream's rows are places of windows, not pairs with boxes; the boxes meet closed windows."""
    from isoline.streaming import boxes as stream

    p = spark.createDataFrame([(k % 2 * 1.0, 1.0, 86400 * (k % 3)) for k in range(30)], "lon double, lat double, s long").selectExpr("lon", "lat", "timestamp_seconds(s) as ts")
    closed = stream.counts_at_places(p, "ts", "1 day", "1 hour")
    assert sorted((r.lon, r.n) for r in closed.collect()) == [(0.0, 5)] * 3 + [(1.0, 5)] * 3
    b = spark.createDataFrame([(7, 0.0, 1.0, 0.0, 2.0), (8, 0.5, 2.0, 1.0, 1.0), (9, 3.0, 4.0, 0.0, 1.0)], "k long, xmin double, xmax double, ymin double, ymax double")
    got = stream.counts_in_boxes(closed, b, "k").selectExpr("unix_timestamp(window_start) as s", "k", "n").collect()
    assert sorted(tuple(r) for r in got) == sorted((86400 * d, k, n) for d in range(3) for k, n in ((7, 10), (8, 5)))
