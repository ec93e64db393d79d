"""Unions of a key by cells against the union of all polygons at once, and lists of arcs in order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoline.functions import regions as R
from isoline.operators import chains, contour_lines, dissolve
from isoline.sources.steps import Steps

POLYGONS = "key string, parts array<array<struct<x:double,y:double>>>"


def polygon(x, y, r, n, turn=0.0):
    t = np.arange(n) * (2 * math.pi / n) + turn
    p = np.column_stack([x + r * np.cos(t), y + r * np.sin(t)])
    return np.concatenate([p, p[:1]])


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)


def rows_of(key, polygons):
    return [(key, [[tuple(map(float, p)) for p in ring] for ring in (rings if isinstance(rings, list) else [rings])]) for rings in polygons]


def area(ring):
    x, y = ring[:, 0], ring[:, 1]
    return (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2


def dissolved(spark, rows, **k):
    out = {}
    for r in dissolve.dissolve_rings(spark.createDataFrame(rows, POLYGONS).repartition(3), "key", "parts", **k).collect():
        out.setdefault(r.key, []).append(np.array([tuple(p) for p in r.ring]))
    return out


@pytest.mark.parametrize("cell", [None, 1.0, 8.0])
def test_union_by_cells(spark, cell):
    rng = np.random.default_rng(9)
    sets = {
        "discs": [polygon(*rng.uniform(-6, 6, 2), rng.uniform(0.3, 2), int(rng.integers(3, 12)), rng.uniform(0, 3)) for _ in range(40)],
        "grid": [box(x, y, 1, 1) for x in range(-3, 4) for y in range(-3, 4) if (x + y) % 2 == 0 or x > 0],  # edges on the sides of cells, corners that touch
        "hole": [[box(-5, -5, 10, 10), box(-2, -2, 4, 4)[::-1]], box(-1, -1, 2, 2)],
        "one": [box(0.25, 0.25, 0.5, 0.5)] * 100,  # more than are united at once
        None: [box(0, 0, 3, 1), box(1, -1, 1, 3)],
    }
    got = dissolved(spark, [r for k, v in sets.items() for r in rows_of(k, v)], **({} if cell is None else {"cell": cell}))
    assert set(got) == set(sets)
    for key, polygons in sets.items():
        rings = [r for p in polygons for r in (p if isinstance(p, list) else [p])]
        whole = R.union(rings)
        assert sum(map(area, got[key])) == pytest.approx(sum(map(area, whole)), abs=1e-4)
        at = rng.uniform(-9, 9, (500, 2)) + 1e-4
        assert (R.winding(at, R.edges_of(got[key])) == (R.winding(at, R.edges_of(rings)) > 0)).all()
        if key != "grid":
            assert len(got[key]) == len(whole) and sum(map(len, got[key])) == sum(map(len, whole))  # no vertex where cells were cut
    assert sorted(round(area(r), 6) for r in got["hole"]) == [-16.0, 4.0, 100.0]


def test_odd_polygons(spark):
    flat = [(0.0, 0.0), (5.0, 0.0), (0.0, 0.0)]
    rows = [("a", None), ("a", []), ("a", [flat]), ("a", [flat + [(0.0, 0.0)]]), *rows_of("b", [box(0, 0, 1, 1)])]
    assert {k: [round(area(r), 6) for r in v] for k, v in dissolved(spark, rows).items()} == {"b": [1.0]}
    assert dissolved(spark, []) == {}


def test_ranked(spark):
    """Chains and loops of all lengths, in random numbering."""
    rng, arcs, want = np.random.default_rng(2), [], []
    ids = rng.permutation(2000).tolist()
    for n in [1, 1, 2, 3, 5, 64, 65, 200]:
        for loop in (False, True):
            own = [ids.pop() for _ in range(n)]
            arcs += [(a, own[(k + 1) % n] if loop or k + 1 < n else None) for k, a in enumerate(own)]
            at = own.index(min(own)) if loop else 0
            turned = own[at:] + own[:at]
            want += [(a, turned[-1], n - k, loop) for k, a in enumerate(turned)]
    rows = chains.ranked(spark.createDataFrame(arcs, "id bigint, next bigint"), Steps(spark)).collect()
    assert sorted((r.id, r.chain, r.to_end, r.closed) for r in rows) == sorted(want)


def test_contours_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 6, (40, 50)) * 10.0  # many vertices lie on a level
    cells = spark.createDataFrame([("r", x, y, float(v[y, x])) for y in range(40) for x in range(50)], "raster_id string, x int, y int, value double")

    def found(tile):
        rows = contour_lines.contour_lines(cells, 10.0, base=5.0, tile=tile).collect()
        segments = sorted((r.elev, *sorted([(round(a.x, 6), round(a.y, 6)), (round(b.x, 6), round(b.y, 6))])) for r in rows for a, b in zip(r.points, r.points[1:]))
        ends = sorted((r.elev, round(p.x, 6), round(p.y, 6)) for r in rows if not r.closed for p in (r.points[0], r.points[-1]))
        assert all((abs(r.points[0].x - r.points[-1].x) < 1e-6 and abs(r.points[0].y - r.points[-1].y) < 1e-6) == r.closed for r in rows)
        return segments, ends, len(rows)

    whole = found(1000)
    assert found(8) == whole and found(3) == whole and len(whole[0]) > 1000


def test_contours_of_nothing(spark):
    cells = spark.createDataFrame([("r", x, 0, 1.0) for x in range(3)], "raster_id string, x int, y int, value double")
    assert contour_lines.contour_lines(cells, 10.0).count() == 0 and contour_lines.contour_lines(cells.where("x < 0"), 10.0).count() == 0
