"""Warping between cells by tiles against a plain loop over new cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.operators import raster_grid


def plain(values, box, to_box, to_size, reach, weight, nodata):
    h, w = values.shape
    out = {}
    for y in range(to_size[1]):
        for x in range(to_size[0]):
            px = (to_box[0] + (x + 0.5) * (to_box[1] - to_box[0]) / to_size[0] - box[0]) * w / (box[1] - box[0])
            py = (box[3] - (to_box[3] - (y + 0.5) * (to_box[3] - to_box[2]) / to_size[1])) * h / (box[3] - box[2])
            fx, fy = px - 0.5, py - 0.5
            if not (0 <= px <= w and 0 <= py <= h):
                out[x, y] = (None, nodata)
                continue
            top = low = 0.0
            for i in range(1 - reach, reach + 1):
                for j in range(1 - reach, reach + 1):
                    k = weight(fx - math.floor(fx) - i) * weight(fy - math.floor(fy) - j)
                    top += k * values[min(max(math.floor(fy) + j, 0), h - 1), min(max(math.floor(fx) + i, 0), w - 1)]
                    low += k
            out[x, y] = ("r", nodata if math.isnan(top) else round(top / low, 9))
    return out


WEIGHTS = {"bilinear": lambda d: 1 - abs(d), "lanczos": lambda d: float(np.sinc(d) * np.sinc(d / 3)) if abs(d) < 3 else 0.0}


@pytest.mark.parametrize("method", ["bilinear", "lanczos"])
def test_tiles_give_what_a_loop_gives(spark, monkeypatch, method):
    """Missing, null and no-data cells, places outside, edges, and tiles smaller than the raster."""
    monkeypatch.setattr(raster_grid, "TILE", 12)
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 100, (31, 40))
    rows = [("r", x, y, float(a[y, x])) for y in range(31) for x in range(40)]
    rows.remove(("r", 30, 20, float(a[20, 30])))
    a[20, 30] = math.nan
    for x, y, v in ((5, 5, None), (12, 11, -1.0)):
        rows[rows.index(("r", x, y, float(a[y, x])))] = ("r", x, y, v)
        a[y, x] = math.nan
    cells = spark.createDataFrame(rows, "raster_id string, x int, y int, value double")
    box, to_box, to_size = (0.0, 40.0, 0.0, 31.0), (-3.0, 44.0, -2.0, 33.0), (37, 44)
    got = raster_grid.warp(cells, box, (40, 31), 4326, to_box, to_size, 4326, method, -1.0)
    found = {(r.x, r.y): (r.raster_id, round(r.value, 9)) for r in got.collect()}
    want = plain(a, box, to_box, to_size, raster_grid.KERNELS[method][0], WEIGHTS[method], -1.0)
    assert found.keys() == want.keys() and got.count() == len(want)
    for k, (name, v) in want.items():
        assert found[k][0] == name and found[k][1] == pytest.approx(v, abs=1e-6)


def test_pairs_of_cells_are_no_rows(spark):
    """New cells meet old ones in groups of a tile: no join of cells is in the plan."""
    cells = spark.range(400).select(F.lit("r").alias("raster_id"), (F.col("id") % 20).cast("int").alias("x"), F.floor(F.col("id") / 20).cast("int").alias("y"), F.col("id").cast("double").alias("value"))
    warped = raster_grid.warp(cells, (0.0, 20.0, 0.0, 20.0), (20, 20), 4326, (0.0, 20.0, 0.0, 20.0), (20, 20), 4326, "lanczos")
    plan = warped._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan
    assert warped.count() == 400
