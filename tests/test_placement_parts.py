"""Where labels crowd, they enter the rounds in parts of their order, and those that placed ones leave no place do not enter."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_placement import SIDES, crowd, offers, one_after_the_other

from isoline.render import labels, meets, placement


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_refused_labels_stay_out_of_the_rounds(spark, monkeypatch, small_batches):
    monkeypatch.setattr(placement, "FIRST", 40, raising=False)
    rng = np.random.default_rng(10)
    rows = crowd(rng, "a", 1500, 8) + crowd(rng, "b", 300, 4, places=3) + crowd(rng, "c", 20, 40, (30.0, 9.0))
    rows += [("c", 100 + k, [(float(k), float(k), 0.0, 0.0)] * (1 + k % 2)) for k in range(30)] + [("e", 1, []), ("e", 2, None)]
    rows += [(None, seq, boxes) for _, seq, boxes in crowd(rng, "", 400, 3)]
    entered, tiles = [], placement._tiles

    def counted(df, shift):
        entered.append(df.where("map_id = 'a' and size(x0) > 1").count())
        return tiles(df, shift)

    monkeypatch.setattr(placement, "_tiles", counted)
    got = {(r.map_id or "none", r.seq): r.choice for r in labels.place(offers(spark, rows)).collect()}
    assert got == one_after_the_other([(m or "none", *more) for m, *more in rows])
    assert sum(k >= 0 for (m, _), k in got.items() if m == "a") > 100
    assert sum(entered) < 1500


def test_parts_with_boxes_as_a_function_of_columns(spark, monkeypatch, small_batches):
    monkeypatch.setattr(placement, "FIRST", 20, raising=False)
    rng = np.random.default_rng(11)
    rows = [("ab"[k % 2], int(seq), float(rng.uniform(0, 9)), float(rng.uniform(0, 5))) for k, seq in enumerate(rng.permutation(900))]
    d = spark.createDataFrame(rows, "map_id string, seq bigint, x double, y double").repartition(5)
    boxes = labels.candidates(F.col("x"), F.col("y"), F.lit(1.5), F.lit(0.5), F.lit(0.1), True)
    want = one_after_the_other([(r.map_id, r.seq, [tuple(b) for b in r.boxes]) for r in d.withColumn("boxes", boxes).collect()])
    for order in (F.col("seq"), F.lpad(F.col("seq").cast("string"), 4, "0")):
        got = {(r.map_id, int(r.seq)): r.choice for r in labels.place(d.withColumn("seq", order), boxes=boxes, same=["x", "y"]).collect()}
        assert got == want


def test_boxes_near_placed_ones(monkeypatch):
    monkeypatch.setattr(meets, "CHUNK", 8)
    monkeypatch.setattr(meets, "NEAR", 3)
    rng = np.random.default_rng(12)
    box = lambda n: [c for p in rng.integers(0, 20, (2, n)) for c in (p.astype(float), p + rng.integers(0, 3, n).astype(float))]
    a, b = box(100), box(40)
    want = (a[0][:, None] < b[1]) & (a[1][:, None] > b[0]) & (a[2][:, None] < b[3]) & (a[3][:, None] > b[2])
    assert (meets.overlapped(a, b) == want.any(axis=1)).all() and want.any() and len(SIDES) == len(a)
    assert sum(int(on.sum()) for _, _, on in meets.nearby(a, b)) == want.sum()
    assert not meets.overlapped(a, [np.empty(0)] * 4).any()
