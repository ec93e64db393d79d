"""Union of all polygons of a key by an overlay of grid cells, so that no task and no row holds a key.

1. Polygons are cut at square cells (a power of two wide, GRID steps a side; all coordinates become whole steps). Where a cell holds many, they are united
   in groups first.
2. A cell's union is found by winding numbers. What bounds it inside the cell is chained to paths; what lies on the cell's sides is kept as intervals.
3. Intervals of two neighbours cancel where both are filled: running sums over the ends of a side's intervals leave the parts that one of them fills.
4. Paths and what is left of sides meet at their ends, the one farthest to the left where several go on, and pointer doubling finds the rings.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from isoline.functions.regions import bends, boundary, turn
from isoline.operators.chains import ranked
from isoline.sources.steps import Steps

#: Steps along a cell's side; polygons of a cell that are united at once.
GRID, TOGETHER = 1 << 24, 64
_EDGES = "cx bigint, cy bigint, edges array<double>"
_FOUND = "side int, line bigint, cell bigint, low bigint, high bigint, way int, closed boolean, xs array<double>, ys array<double>"
_FOUND_ARROW = [("side", pa.int32()), ("line", pa.int64()), ("cell", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("way", pa.int32()), ("closed", pa.bool_()), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))]


def _half(ring: np.ndarray, axis: int, at: float, sign: int) -> np.ndarray:
    """The part of a ring (first vertex not repeated) on one side of a line, with edges along the line where it was cut."""
    inside = sign * (ring[:, axis] - at) >= 0
    if inside.all() or not inside.any():
        return ring if inside.all() else ring[:0]
    on = np.roll(ring, -1, axis=0)
    cross = inside != np.roll(inside, -1)
    places = np.cumsum(inside.astype(int) + cross) - (inside.astype(int) + cross)
    out = np.empty((int((inside.astype(int) + cross).sum()), 2))
    out[places[inside]] = ring[inside]
    a, b = ring[cross], on[cross]
    met = np.rint(a + ((at - a[:, axis]) / (b[:, axis] - a[:, axis]))[:, None] * (b - a))
    met[:, axis] = at
    out[(places + inside)[cross]] = met
    return out


def cut(rings: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Rings in whole steps to the edges (x, y, u, v; from the cell's corner) of each cell that they reach into."""
    out: dict = {}
    for ring in rings:
        lo, hi = ring.min(axis=0) // GRID, -(-ring.max(axis=0) // GRID)
        for cx in range(int(lo[0]), int(hi[0])):
            strip = _half(_half(ring, 0, cx * GRID, 1), 0, (cx + 1) * GRID, -1)
            for cy in range(int(lo[1]), int(hi[1])) if len(strip) > 2 else ():
                p = _half(_half(strip, 1, cy * GRID, 1), 1, (cy + 1) * GRID, -1)
                if len(p) > 2:
                    p = p - (cx * GRID, cy * GRID)
                    e = np.hstack([p, np.roll(p, -1, axis=0)])
                    out.setdefault((cx, cy), []).append(e[(e[:, :2] != e[:, 2:]).any(axis=1)])
    return {k: e for k, v in out.items() if len(e := np.concatenate(v))}


def _cut(step: float, key_type: pa.DataType):
    schema = pa.schema([("key", key_type), ("cx", pa.int64()), ("cy", pa.int64()), ("edges", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            row, cx, cy, edges = [], [], [], []
            for i, (xs, ys) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                rings = [np.rint(np.column_stack([x, y]) / step) for x, y in zip(xs or (), ys or (), strict=True) if len(x) > 3]
                rings = [r[:-1] if (r[0] == r[-1]).all() else r for r in rings]
                for (x, y), e in cut(rings).items():
                    row.append(i)
                    cx.append(x)
                    cy.append(y)
                    edges.append(e.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(edges, schema.field("edges").type)], schema=schema)

    return run


def _united(rows: pa.Table) -> np.ndarray:
    e = np.concatenate([np.asarray(x, float) for x in rows.column("edges").to_pylist()]).reshape(-1, 4)
    return boundary([e], lambda w: w > 0, 1.0)


def paths(pieces: np.ndarray) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Directed pieces inside a cell as open paths between places on its sides, and as closed ones."""
    on: dict[tuple, list[tuple]] = {}
    for x, y, u, v in pieces.tolist():
        on.setdefault((x, y), []).append((u, v))
    side = lambda p: p[0] in (0, GRID) or p[1] in (0, GRID)

    def walk(p: tuple) -> list[tuple]:
        path, way = [p], None
        while True:
            options = on[p]
            q = options[-1] if way is None or len(options) == 1 else max(options, key=lambda o: turn(way, (o[0] - p[0], o[1] - p[1])))
            options.remove(q)
            if not options:
                del on[p]
            way, p = (q[0] - p[0], q[1] - p[1]), q
            path.append(q)
            if side(q) or q == path[0] or q not in on:
                return path

    open_ = [walk(p) for p in [p for p in on if side(p)] for _ in range(len(on.get(p, ())))]
    closed = []
    while on:
        closed.append(walk(next(iter(on))))
    return open_, closed


def _bounds(key_type: pa.DataType):
    """A cell's union: intervals on its sides, and paths inside, in steps of the whole grid."""
    schema = pa.schema([("key", key_type), *_FOUND_ARROW])

    def run(rows: pa.Table) -> pa.Table:
        pieces = _united(rows)
        cx, cy = rows.column("cx")[0].as_py(), rows.column("cy")[0].as_py()
        out: dict = {k: [] for k, _ in _FOUND_ARROW}
        add = lambda **v: [out[k].append(v.get(k)) for k in out]
        along = np.zeros(len(pieces), bool)
        for axis, own, other in ((0, cx, cy), (1, cy, cx)):
            for at in (0, GRID):
                here = (pieces[:, axis] == at) & (pieces[:, axis + 2] == at)
                along |= here
                for a, b in pieces[here][:, [1 - axis, 3 - axis]].tolist():
                    add(side=axis, line=own * GRID + at, cell=other, low=min(a, b) + other * GRID, high=max(a, b) + other * GRID, way=1 if b > a else -1)
        open_, closed = paths(pieces[~along])
        for p, whole in [(p, False) for p in open_] + [(p, True) for p in closed]:
            add(closed=whole, xs=[float(x + cx * GRID) for x, _ in p], ys=[float(y + cy * GRID) for _, y in p])
        n = len(out["side"])
        return pa.Table.from_arrays([pa.repeat(rows.column("key")[0].as_py(), n).cast(key_type) if n else pa.array([], key_type), *(pa.array(out[k], t) for k, t in _FOUND_ARROW)], schema=schema)

    return run


def _partly(key_type: pa.DataType):
    schema = pa.schema([("key", key_type), ("cx", pa.int64()), ("cy", pa.int64()), ("edges", pa.list_(pa.float64()))])

    def run(rows: pa.Table) -> pa.Table:
        edges = rows.column("edges").to_pylist() if rows.num_rows == 1 else [_united(rows).astype(float).ravel()]
        one = rows.slice(0, 1)
        return pa.Table.from_arrays([*(one.column(k).combine_chunks() for k in ("key", "cx", "cy")), pa.array(edges, schema.field("edges").type)], schema=schema)

    return run


def matched(comes: list[dict], goes: list[dict]) -> list[dict]:
    """At a place where several paths meet: what comes in goes on as far to the left as it can."""
    left, pairs = list(goes), []
    for x in comes:
        if left:
            y = max(left, key=lambda y: turn((x["dx"], x["dy"]), (y["dx"], y["dy"])))
            left.remove(y)
            pairs.append({"id": x["id"], "next": y["id"]})
    return pairs


def _matched():
    @pandas_udf("array<struct<id:bigint,next:bigint>>")
    def run(comes: pd.Series, goes: pd.Series) -> pd.Series:
        return pd.Series([matched(a, b) for a, b in zip(comes, goes, strict=True)])

    return run


def _ring(step: float):
    @pandas_udf("struct<xs:array<double>,ys:array<double>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(xs, ys, strict=True):
            p = bends(np.column_stack([x, y]))
            out.append(((np.r_[p[:, 0], p[:1, 0]] * step).tolist(), (np.r_[p[:, 1], p[:1, 1]] * step).tolist()) if len(p) else (None, None))
        return pd.DataFrame(out, columns=["xs", "ys"], dtype=object)

    return run


def dissolve_rings(df: DataFrame, key: str, parts: str, cell: float | None = None) -> DataFrame:
    """(key, ring): the rings of the union of all polygons of each key, outer ones counter-clockwise. Inner rings of polygons go the other way, as winding numbers ask.

    cell: about the side of a grid cell, widened to a power of two; four times the polygons' mean width where it is not given. Places are exact to a cell's
    side by 2**24. A null key is a key; polygons without area add nothing; no polygons give no rows.
    """
    steps, out = Steps(df.sparkSession), Steps(df.sparkSession)
    side = lambda k: F.transform(parts, lambda c: c[k]).cast("array<array<double>>").alias(f"{k}s")
    polygons = df.where(F.size(parts) > 0).select(F.col(key).alias("key"), side("x"), side("y"))
    if cell is None:
        width = lambda c: F.array_max(F.flatten(c)) - F.array_min(F.flatten(c))
        cell = 4 * (polygons.agg(F.avg(F.greatest(width("xs"), width("ys")))).first()[0] or 1.0)
    if not cell > 0:
        raise ValueError("cell must be positive")
    step = 2.0 ** math.ceil(math.log2(cell)) / GRID
    key_type, kind = polygons.select("key").limit(0).toArrow().schema.field("key").type, dict(polygons.dtypes)["key"]
    pieces = steps.keep(polygons.mapInArrow(_cut(step, key_type), f"key {kind}, {_EDGES}"))
    many = pieces.groupBy("key", "cx", "cy").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER)
    same = [F.col("key").eqNullSafe(F.col("k")), F.col("cx") == F.col("x"), F.col("cy") == F.col("y")]
    dealt = pieces.join(many.toDF("k", "x", "y", "n"), same[0] & same[1] & same[2], "left").withColumn("part", F.pmod(F.xxhash64("edges"), F.ceil(F.coalesce("n", F.lit(1)) / TOGETHER)))
    fewer = dealt.select("key", "cx", "cy", "edges", "part").groupBy("key", "cx", "cy", "part").applyInArrow(_partly(key_type), f"key {kind}, {_EDGES}")
    found = steps.keep(fewer.groupBy("key", "cx", "cy").applyInArrow(_bounds(key_type), f"key {kind}, {_FOUND}"))
    # what one neighbour fills only, on every side of a cell
    ends = found.where("side is not null").select("key", "side", "line", "cell", F.explode(F.array(F.struct(F.col("low").alias("at"), F.col("way").alias("by")), F.struct(F.col("high").alias("at"), (-F.col("way")).alias("by")))).alias("e"))
    ends = ends.groupBy("key", "side", "line", "cell", "e.at").agg(F.sum("e.by").alias("by")).where("by <> 0")
    on = Window.partitionBy("key", "side", "line", "cell").orderBy("at")
    left = ends.withColumns({"filled": F.sum("by").over(on), "to": F.lead("at").over(on)}).where("filled <> 0 and to is not null")
    a, b = (F.when(F.col("filled") > 0, F.col(x)).otherwise(F.col(y)).cast("double") for x, y in (("at", "to"), ("to", "at")))
    line = F.col("line").cast("double")
    sides = left.select("key", F.when(F.col("side") == 0, F.array(line, line)).otherwise(F.array(a, b)).alias("xs"), F.when(F.col("side") == 0, F.array(a, b)).otherwise(F.array(line, line)).alias("ys"))
    open_ = found.where("not closed").select("key", "xs", "ys").unionByName(sides)
    open_ = out.keep(open_.select(F.monotonically_increasing_id().alias("id"), "*"))
    at = lambda c, k: F.element_at(c, k)
    end = lambda i, j, sign: [at("xs", i).alias("nx"), at("ys", i).alias("ny"), F.struct("id", (sign * (at("xs", i) - at("xs", j))).alias("dx"), (sign * (at("ys", i) - at("ys", j))).alias("dy")).alias("e")]
    both = open_.select("key", *end(-1, -2, 1), F.lit(True).alias("comes")).unionByName(open_.select("key", *end(1, 2, -1), F.lit(False).alias("comes")))
    nodes = steps.keep(both.groupBy("key", "nx", "ny").agg(F.collect_list(F.when(F.col("comes"), F.col("e"))).alias("comes"), F.collect_list(F.when(~F.col("comes"), F.col("e"))).alias("goes")))
    simple = nodes.where("size(comes) = 1 and size(goes) = 1").select(F.col("comes")[0]["id"].alias("id"), F.col("goes")[0]["id"].alias("next"))
    tangled = nodes.where("size(comes) > 1 or size(goes) > 1").select(F.inline(_matched()("comes", "goes")))
    arcs = open_.select("id").join(simple.unionByName(tangled), "id", "left")
    order = ranked(steps.keep(arcs), steps)
    whole = open_.join(order.where("closed"), "id").groupBy("key", "chain").agg(F.array_sort(F.collect_list(F.struct((-F.col("to_end")).alias("n"), "xs", "ys"))).alias("v"))
    bare = lambda c: F.flatten(F.transform("v", lambda v: F.slice(v[c], 1, F.size(v[c]) - 1))).alias(c)
    rings = whole.select("key", bare("xs"), bare("ys")).unionByName(found.where("closed").select("key", *(F.slice(c, 1, F.size(c) - 1).alias(c) for c in ("xs", "ys"))))
    rings = out.keep(rings.select("key", _ring(step)("xs", "ys").alias("r")).where("r.xs is not null"))
    steps.clear()
    return rings.select(F.col("key").alias(key), F.zip_with("r.xs", "r.ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("ring"))


def dissolve(df: DataFrame, key: str, parts: str, cell: float | None = None) -> DataFrame:
    """(key, parts): all rings of a key in one row, for keys whose rings fit one; `dissolve_rings` has a row for each ring."""
    return dissolve_rings(df, key, parts, cell).groupBy(key).agg(F.collect_list("ring").alias("parts"))
