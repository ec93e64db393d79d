"""The placement queries' check counts what is wrong, label by label, although it meets labels that are alike once."""

import numpy as np
from pyspark.sql import functions as F

from isoline.operators import joins
from isoline.plans import shapes
from isoline.render import labels


def test_wrong_choices_are_counted(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [("ab"[k % 2], k, float(rng.integers(0, 6)), float(rng.integers(0, 4)), int(rng.integers(-1, 8))) for k in range(120)]
    d = spark.createDataFrame(rows, "map_id string, seq bigint, x double, y double, choice int")
    boxes = labels.candidates(F.col("x"), F.col("y"), F.lit(1.5), F.lit(0.5), F.lit(0.1), True)
    monkeypatch.setattr(labels, "place", lambda offers, boxes, same: d.select("map_id", "seq", "choice"))
    got = {r.map_id: (r.n, r.overlaps, r.unjust) for r in shapes._placed_and_checked(d.drop("choice"), ["x", "y"], boxes).collect()}
    every = d.withColumn("boxes", boxes).collect()
    meets = lambda a, b: a.x0 < b.x1 and a.x1 > b.x0 and a.y0 < b.y1 and a.y1 > b.y0
    for m in "ab":
        own = [r for r in every if r.map_id == m]
        taken = [(r.seq, r.boxes[r.choice]) for r in own if r.choice >= 0]
        overlaps = sum(meets(p, q) for i, p in taken for j, q in taken if i != j)
        unjust = sum(not any(j < r.seq and meets(b, q) for j, q in taken) for r in own for k, b in enumerate(r.boxes) if r.choice < 0 or k < r.choice)
        assert got[m] == (len(own), overlaps, unjust) and overlaps and unjust


def test_pairs_of_boxes_within_a_map(spark):
    rng = np.random.default_rng(9)
    side = lambda p, n: spark.createDataFrame([(int(k), "abc"[k % 3], *map(float, (x, x + w, y, y + h))) for k, (x, y, w, h) in enumerate(rng.uniform(0, 9, (n, 4)))], f"{p}id int, {p}map string, {p}x0 double, {p}x1 double, {p}y0 double, {p}y1 double")
    a, b = side("a", 60), side("b", 50)
    sides = [tuple(f"{p}{k}" for k in ("x0", "x1", "y0", "y1")) for p in "ab"]
    all_, own = (joins.bbox_join(a, b, *sides, 2.0, **k) for k in ({}, {"same": ("amap", "bmap")}))
    assert sorted(own.select("aid", "bid").collect()) == sorted(all_.where("amap = bmap").select("aid", "bid").collect())
