"""Placement in rounds makes the choices of first fit, one label after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.render import labels, placement

SIDES = ("x0", "x1", "y0", "y1")


def offers(spark, rows):
    box = "array<struct<x0:double,x1:double,y0:double,y1:double>>"
    return spark.createDataFrame(rows, f"map_id string, seq bigint, boxes {box}").repartition(5)


def one_after_the_other(rows):
    out = {}
    for m in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == m)
        boxes = [[b for b in r[2] or []] for r in own]
        out |= {(m, r[1]): k for r, k in zip(own, labels.first_fit(boxes, 1.0), strict=True)}
    return out


def crowd(rng, name, n, width, sizes=(1.5, 0.5), places=8):
    rows = []
    for k, seq in enumerate(rng.permutation(n).tolist()):
        x, y = rng.normal(0, width / 4, 2) if k % 2 else rng.uniform(-width, width, 2)
        w, h = sizes[0] * rng.uniform(0.5, 1.5), sizes[1]
        shifts = labels.WITH_SYMBOL[:places]
        rows.append((name, seq, [tuple(map(float, b)) for b in [(x + sx * w - w / 2, x + sx * w + w / 2, y + sy * h - h / 2, y + sy * h + h) for sx, sy in shifts]]))
    return rows


@pytest.mark.parametrize("most", [5, 60, 3000])
def test_same_choices_as_first_fit(spark, monkeypatch, most):
    monkeypatch.setattr(placement, "TILE_LABELS", most)
    rng, left = np.random.default_rng(4), []
    rows = crowd(rng, "a", 700, 12) + crowd(rng, "b", 150, 4, places=1) + crowd(rng, "c", 60, 40, (30.0, 9.0))
    rows += [("d", 2, [(0.0, 1.0, 0.0, 1.0)]), ("d", 1, [(0.0, 1.0, 0.0, 1.0)]), ("d", 3, [(1.0, 2.0, 0.0, 1.0)]), ("e", 1, []), ("e", 2, None), (None, 1, [(0.0, 1.0, 0.0, 1.0)]), (None, 2, [(0.5, 1.0, 0.0, 1.0)])]
    got = {(r.map_id, r.seq): r.choice for r in placement.place_in_rounds(offers(spark, rows), rounds=left).collect()}
    want = one_after_the_other([r for r in rows if r[0]])
    assert {k: v for k, v in got.items() if k[0]} == want and got[None, 1] == 0 and got[None, 2] == -1
    assert left[-1] == 0 and len(left) <= 12
    assert left == sorted(left, reverse=True)


def test_a_chain_over_all_tiles(spark, monkeypatch):
    """Each label waits for the one before it: the worst case still ends, with the same choices."""
    monkeypatch.setattr(placement, "TILE_LABELS", 4)
    rows = [("m", k, [(k * 1.0, k + 1.5, 0.0, 1.0)]) for k in range(60)]
    got = {r.seq: r.choice for r in labels.place(offers(spark, rows)).collect()}
    assert got == {k: 0 if k % 2 == 0 else -1 for k in range(60)}


def test_no_labels_and_other_order_columns(spark):
    assert labels.place(offers(spark, []).withColumnRenamed("seq", "rank"), "rank").columns == ["map_id", "rank", "choice"]
    assert labels.place(offers(spark, [])).count() == 0
    d = offers(spark, [("m", 1, [(0.0, 1.0, 0.0, 1.0)])]).withColumn("rank", F.lit("first"))
    assert [tuple(r) for r in labels.place(d.drop("seq"), "rank").collect()] == [("m", "first", 0)]


def test_copies_are_settled_before_the_rounds(spark):
    """Of labels with the same boxes only as many as they have places enter the rounds, in order; boxes without a size never overlap and all stay."""
    rng = np.random.default_rng(5)
    kinds = [r[2] for r in crowd(rng, "a", 30, 3)] + [[(0.0, 0.0, 0.0, 1.0)]]
    rows = [("a" if k % 3 else "b", int(seq), kinds[k % len(kinds)]) for k, seq in enumerate(rng.permutation(1500))]
    flat = placement._offered(offers(spark, rows), "seq", None, None).where("size(x0) > 0")
    assert flat.groupBy("map_id", *SIDES).count().where("size(x0) = 8").agg(F.max("count")).first()[0] == 8
    assert flat.where("size(x0) = 1").count() == sum(len(r[2]) == 1 for r in rows)
    got = {(r.map_id, r.seq): r.choice for r in labels.place(offers(spark, rows)).collect()}
    assert got == one_after_the_other(rows)


def test_boxes_as_a_function_of_columns(spark):
    rng = np.random.default_rng(6)
    rows = [("a", int(seq), float(k % 7), float(k % 5)) for k, seq in enumerate(rng.permutation(800))]
    d = spark.createDataFrame(rows, "map_id string, seq bigint, x double, y double").repartition(5)
    boxes = labels.candidates(F.col("x"), F.col("y"), F.lit(1.5), F.lit(0.5), F.lit(0.1), True)
    got = {r.seq: r.choice for r in labels.place(d, boxes=boxes, same=["x", "y"]).collect()}
    assert got == {r.seq: r.choice for r in labels.place(d.withColumn("boxes", boxes)).collect()}
    with pytest.raises(ValueError):
        labels.place(d, boxes=boxes)
