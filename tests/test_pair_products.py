"""Pairs of a box table as products of lists of keys: each pair once, in rows that take little place in files."""

import numpy as np
import pyarrow as pa
import pytest

from isoline.operators import blocks


def expanded(rows):
    return sorted((int(o), int(i)) if first else (int(i), int(o)) for outer, inner, first in rows for o in outer for i in inner)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 40, 300])
def test_ordered_runs_give_each_pair_once(n):
    rng = np.random.default_rng(n)
    for m, top in ((1, 5), (9, 3), (30, 1000), (300, 400)):
        a, b = np.sort(rng.integers(0, top, n)), np.sort(rng.integers(0, top, m))
        rows = [r for low, high in blocks._ordered(a, b) for r in blocks._runs(low, high)]
        assert expanded(rows) == sorted((min(u, v), max(u, v)) for u in a.tolist() for v in b.tolist() if u != v)
        rows = [r for low, high in blocks._ordered_within(b) for r in blocks._runs(low, high)]
        assert expanded(rows) == sorted((u, v) for k, u in enumerate(b.tolist()) for v in b.tolist()[k + 1 :] if u != v)


@pytest.mark.parametrize("alike", [1, 3, 10_000])
def test_lists_meet_as_products(monkeypatch, alike):
    for name, value in (("COLUMNS", 8), ("ALIKE", alike), ("RUN", 8), ("KEYS", 256)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(5)

    def boxes(n, start):
        x, y, w = rng.integers(-3, 4, n) / 1.0, rng.integers(-3, 4, n) / 1.0, rng.integers(1, 9, n) / 2.0
        return [{"x0": a, "x1": a + c, "y0": b, "y1": b + c, "own": 0, "keys": (start + rng.integers(0, 200, rng.integers(1, 6))).tolist()} for a, b, c in zip(x.tolist(), y.tolist(), w.tolist())]

    kind = pa.struct([*((c, pa.float64()) for c in ("x0", "x1", "y0", "y1")), ("own", pa.int32()), ("keys", pa.list_(pa.int64()))])
    overlap = lambda u, v: u["x1"] > v["x0"] and u["x0"] < v["x1"] and u["y1"] > v["y0"] and u["y0"] < v["y1"] and np.floor(max(u["x0"], v["x0"]) / 4) == 0 and np.floor(max(u["y0"], v["y0"]) / 4) == 0
    for n, m in ((61, 50), (5, 90), (70, None)):
        a, b = boxes(n, 0), m and boxes(m, 100)
        both = [(u, v) for u in a for v in b] if b else [(u, v) for k, u in enumerate(a) for v in a[k + 1 :]]
        want = [(min(x, y), max(x, y)) for u, v in both if overlap(u, v) for x in u["keys"] for y in v["keys"] if x != y]
        if not b:
            want += [(min(x, y), max(x, y)) for u in a if overlap(u, u) for k, x in enumerate(u["keys"]) for y in u["keys"][k + 1 :] if x != y]
        left, right = (pa.array(s, kind) for s in (a, b or a))
        got = [r for batch in blocks._met_pairs(0, 0, 0, 4.0, left, right, not b) for r in zip(*batch.to_pydict().values(), strict=True)]
        assert expanded(got) == sorted(want) and all(u[0] < v[0] for u, v in ((o, i) if first else (i, o) for o, i, first in got))


def test_crowded_pairs_take_little_place(spark, tmp_path):
    """Two places, 40 widths and 12 copies of each box: 460,320 pairs, less than half a byte each."""
    df = spark.range(960).selectExpr("(id * 7919) % 960 as k", "cast(id % 2 as double) as x0", "cast(id % 2 + 2 + id % 40 as double) as x1", "0D as y0", "cast(1 + id % 40 as double) as y1")
    blocks.self_pairs(df, "k", ("x0", "x1", "y0", "y1"), 100.0).coalesce(1).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.distinct().count() == got.where("a < b").count() == got.count() == 960 * 959 // 2
    assert sum(f.stat().st_size for f in tmp_path.glob("pairs/*.parquet")) < 960 * 959 // 4
