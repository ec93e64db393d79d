"""Operators that change a raster's grid: crop, pad, mosaic, shrink, warp, contours. Cells are (raster_id, x, y, value), y = 0 on top.

All are projections, unions or equi joins on cell keys, or meet as tiles of bounded size: no raster is gathered anywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions.crs import transform_xy


def crop(cells: DataFrame, x: int, y: int, width: int, height: int, of: tuple[int, int] | None = None) -> DataFrame:
    """The cells of a rectangle, counted from its corner. of: the raster's size, against which the rectangle is checked."""
    if width <= 0 or height <= 0 or x < 0 or y < 0 or (of and (x + width > of[0] or y + height > of[1])):
        raise ValueError("the rectangle must lie in the raster")
    return cells.where(F.col("x").between(x, x + width - 1) & F.col("y").between(y, y + height - 1)).withColumns({"x": F.col("x") - x, "y": F.col("y") - y})


def _margin(cells: DataFrame, axis: str, size: int, before: int, after: int, value: Column) -> DataFrame:
    """Moves cells by `before` along an axis; edge cells also give the cells beyond the edge, which take `value`."""
    here = F.col(axis)
    places = lambda lo, n: F.when(F.lit(n > 0), F.sequence(F.lit(lo), F.lit(lo + max(n, 1) - 1))).otherwise(F.array().cast("array<int>"))
    low = F.when(here == 0, places(0, before)).otherwise(F.array().cast("array<int>"))
    high = F.when(here == size - 1, places(before + size, after)).otherwise(F.array().cast("array<int>"))
    all_ = F.concat(low, F.array((here + before).cast("int")), high)
    out = cells.withColumn("__to", F.explode(all_)).withColumn("value", F.when(F.col("__to").between(before, before + size - 1), F.col("value")).otherwise(value))
    return out.withColumn(axis, F.col("__to")).drop("__to")


def pad(cells: DataFrame, size: tuple[int, int], top: int, right: int, bottom: int, left: int, value: float | None = None) -> DataFrame:
    """value: fills the margin; without one, edges and corners are extended. No shuffle: edge cells give the margin's cells."""
    if min(top, right, bottom, left) < 0:
        raise ValueError("margins must not be negative")
    fill = F.col("value") if value is None else F.lit(float(value))
    return _margin(_margin(cells, "x", size[0], left, right, fill), "y", size[1], top, bottom, fill)


def mosaic(tiles: list[tuple[DataFrame, int, int]], nodata: float | None = None) -> DataFrame:
    """Several (cells, x offset, y offset) as one raster "mosaic"; where they overlap, the last one with data wins."""
    parts = [c.select(F.lit("mosaic").alias("raster_id"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), "value", F.lit(k).alias("k")) for k, (c, dx, dy) in enumerate(tiles)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.col("k") if nodata is None else F.when(F.col("value") == nodata, -1).otherwise(F.col("k"))
    return out.groupBy("raster_id", "x", "y").agg(F.max_by("value", rank).alias("value"))


def shrink(cells: DataFrame, factor: int, nodata: float | None = None) -> DataFrame:
    """Means of blocks of factor x factor valid cells; a block without any is no-data."""
    v = F.col("value") if nodata is None else F.when(F.col("value") != nodata, F.col("value"))
    out = cells.groupBy("raster_id", F.floor(F.col("x") / factor).cast("int").alias("x"), F.floor(F.col("y") / factor).cast("int").alias("y")).agg(F.avg(v).alias("value"))
    return out if nodata is None else out.withColumn("value", F.coalesce("value", F.lit(float(nodata))))


def _lanczos(d: np.ndarray) -> np.ndarray:
    return np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)


#: Reach in cells and weight by distance of each way to read between cells.
KERNELS = {"bilinear": (1, lambda d: 1 - np.abs(d)), "lanczos": (3, _lanczos)}
#: Side of the tiles of old cells that new ones are read from (smaller where new cells are finer), and new cells that are weighed at once.
TILE, BLOCK = 256, 65_536


def _read_between(at: DataFrame, src: DataFrame, size: tuple[int, int], many: int, method: str, nodata: float) -> DataFrame:
    """New cells (x, y, px, py) as weighted sums of the old ones around their place: both are dealt to tiles of old cells, these with a halo, so a cell is sent about once and no pair of cells is a row."""
    (w, h), (reach, weight) = size, KERNELS[method]
    side = max(4 * reach, int(TILE / math.sqrt(max(1.0, many / (w * h)))))
    own = lambda p, n: F.floor(F.least(F.greatest(F.floor(p), F.lit(0)), F.lit(n - 1)) / side).cast("int")
    halo = lambda c, n: F.sequence(F.floor(F.greatest(F.col(c) - reach, F.lit(0)) / side).cast("int"), F.floor(F.least(F.col(c) + reach, F.lit(n - 1)) / side).cast("int"))
    here = at.where("inside").select("x", "y", "px", "py", own(F.col("px"), w).alias("tx"), own(F.col("py"), h).alias("ty"))
    src = src.where(F.col("cx").between(0, w - 1) & F.col("cy").between(0, h - 1))
    dealt = src.select("raster_id", "cx", "cy", F.col("value").cast("double").alias("value")).withColumn("tx", F.explode(halo("cx", w))).withColumn("ty", F.explode(halo("cy", h)))
    kind = src.limit(0).select("raster_id").toArrow().schema.field(0).type
    schema = pa.schema([("raster_id", kind), ("x", pa.int32()), ("y", pa.int32()), ("value", pa.float64())])

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        if not new.num_rows:
            return schema.empty_table()
        x0, y0 = (max(0, new.column(t)[0].as_py() * side - reach) for t in ("tx", "ty"))
        shape = min(h - y0, side + 2 * reach), min(w - x0, side + 2 * reach)
        values, ok = np.zeros(shape), np.zeros(shape, bool)
        name = None
        if old.num_rows:
            cell = old.column("cy").to_numpy() - y0, old.column("cx").to_numpy() - x0
            there = old.column("value").is_valid().to_numpy()
            v = old.column("value").fill_null(0.0).to_numpy()
            values[cell], ok[cell], name = v, there & (v != nodata), old.column("raster_id")[0].as_py()
        px, py = new.column("px").to_numpy(), new.column("py").to_numpy()
        found, held = np.empty(len(px)), np.empty(len(px), bool)
        taps = np.arange(1 - reach, reach + 1)
        for k in range(0, len(px), BLOCK):
            fx, fy = px[k : k + BLOCK] - 0.5, py[k : k + BLOCK] - 0.5
            ax, ay = np.floor(fx), np.floor(fy)
            top, low, good = np.zeros(len(fx)), np.zeros(len(fx)), np.ones(len(fx), bool)
            for j in taps:
                wy, row = weight(fy - ay - j), np.clip(ay + j, 0, h - 1).astype(int) - y0
                for i in taps:
                    share = weight(fx - ax - i) * wy
                    col = np.clip(ax + i, 0, w - 1).astype(int) - x0
                    top += values[row, col] * share
                    low += share
                    good &= ok[row, col]
            with np.errstate(divide="ignore", invalid="ignore"):
                found[k : k + BLOCK], held[k : k + BLOCK] = np.where(good, top / low, nodata), good & (low == 0)
        return pa.table([pa.array([name], kind).take(pa.array(np.zeros(len(px), np.int32))), new.column("x"), new.column("y"), pa.array(found, mask=held)], schema=schema)

    raster = dict(src.dtypes)["raster_id"]
    return here.groupBy("tx", "ty").cogroup(dealt.groupBy("tx", "ty")).applyInArrow(run, f"raster_id {raster}, x int, y int, value double")


def warp(cells: DataFrame, box: tuple, size: tuple[int, int], source: int, to_box: tuple, to_size: tuple[int, int], target: int, method: str = "nearest", nodata: float = -9999.0) -> DataFrame:
    """The raster on another grid, in another reference system: each new cell's centre is taken back, and the cell below it (nearest) is joined, or the weighted ones around it (bilinear: four, lanczos: 36) are read within tiles.

    Edge cells stand for those beyond the edge, and weights are divided by their sum. New cells whose centre is outside the old raster, or with a no-data
    cell among those around it, are no-data. cells holds one raster; raster_id is null outside it.
    """
    if method != "nearest" and method not in KERNELS:
        raise ValueError(f"no method {method}")
    spark, (w, h), (tw, th) = cells.sparkSession, size, to_size
    grid = spark.range(tw * th).select((F.col("id") % tw).cast("int").alias("x"), F.floor(F.col("id") / tw).cast("int").alias("y"))
    gx = to_box[0] + (F.col("x") + 0.5) * ((to_box[1] - to_box[0]) / tw)
    gy = to_box[3] - (F.col("y") + 0.5) * ((to_box[3] - to_box[2]) / th)
    sx, sy = transform_xy(gx, gy, target, source)
    at = grid.select("x", "y", ((sx - box[0]) * (w / (box[1] - box[0]))).alias("px"), ((box[3] - sy) * (h / (box[3] - box[2]))).alias("py"))
    src = cells.select("raster_id", F.col("x").alias("cx"), F.col("y").alias("cy"), "value")
    if method == "nearest":
        near = at.select("x", "y", F.floor("px").cast("int").alias("cx"), F.floor("py").cast("int").alias("cy"))
        return near.join(src, ["cx", "cy"], "left").select("raster_id", "x", "y", F.coalesce("value", F.lit(nodata)).alias("value"))
    at = at.withColumn("inside", F.coalesce(F.col("px").between(0, w) & F.col("py").between(0, h), F.lit(False)))
    raster = dict(cells.dtypes)["raster_id"]
    outside = at.where("not inside").select(F.lit(None).cast(raster).alias("raster_id"), "x", "y", F.lit(float(nodata)).alias("value"))
    return _read_between(at, src, size, tw * th, method, nodata).unionByName(outside)


def contour_segments(cells: DataFrame, interval: float, base: float = 0.0, nodata: float | None = None) -> DataFrame:
    """Marching triangles: (raster_id, elev, x1, y1, x2, y2) where the level elev = base + k * interval crosses one of the two triangles of four neighbouring cells.

    A vertex at a level counts as above it, so segments of neighbours meet and no level is drawn twice. The four cells come together by windows on rows and columns.
    """
    if interval <= 0:
        raise ValueError("interval must be positive")
    v = F.col("value") if nodata is None else F.when(F.col("value") != nodata, F.col("value"))
    row, col = Window.partitionBy("raster_id", "y").orderBy("x"), Window.partitionBy("raster_id", "x").orderBy("y")
    right = lambda c: F.when(F.lead("x").over(row) == F.col("x") + 1, F.lead(c).over(row))
    quad = cells.select("raster_id", "x", "y", v.alias("a")).withColumn("b", right("a"))
    below = lambda c: F.when(F.lead("y").over(col) == F.col("y") + 1, F.lead(c).over(col))
    quad = quad.withColumns({"c": below("a"), "d": below("b")}).where("a is not null and b is not null and c is not null and d is not null")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    vertex = lambda dx, dy, k: F.struct((x + dx).alias("x"), (y + dy).alias("y"), F.col(k).alias("v"))
    tri = lambda *p: F.struct(*(q.alias(n) for q, n in zip(p, "pqr", strict=True)))
    t = quad.select("raster_id", F.explode(F.array(tri(vertex(0, 0, "a"), vertex(1, 0, "b"), vertex(0, 1, "c")), tri(vertex(1, 0, "b"), vertex(1, 1, "d"), vertex(0, 1, "c")))).alias("t")).select("raster_id", "t.*")
    lo, hi = F.least("p.v", "q.v", "r.v"), F.greatest("p.v", "q.v", "r.v")
    first, last = F.floor((lo - base) / interval) + 1, F.floor((hi - base) / interval)
    t = t.where(first <= last).withColumn("elev", F.explode(F.sequence(first, last))).withColumn("elev", base + F.col("elev") * interval)

    def crossing(m: str, n: str) -> Column:
        p, q, e = F.col(m), F.col(n), F.col("elev")
        k = (e - p["v"]) / F.nullif(q["v"] - p["v"], F.lit(0.0))
        return F.when((p["v"] >= e) != (q["v"] >= e), F.struct((p["x"] + (q["x"] - p["x"]) * k).alias("x"), (p["y"] + (q["y"] - p["y"]) * k).alias("y")))

    ends = F.filter(F.array(crossing("p", "q"), crossing("q", "r"), crossing("r", "p")), lambda e: e.isNotNull())
    out = t.withColumn("e", ends).where(F.size("e") == 2)
    return out.select("raster_id", "elev", F.col("e")[0]["x"].alias("x1"), F.col("e")[0]["y"].alias("y1"), F.col("e")[1]["x"].alias("x2"), F.col("e")[1]["y"].alias("y2"))
