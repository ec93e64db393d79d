"""Raster algebra over cells (raster_id, x, y, value). No-data cells keep their value."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoline.functions.color import gradient


def _valid(v: str, nodata: float | None) -> Column:
    return F.lit(True) if nodata is None else F.col(v) != nodata


def per_cell(cells: DataFrame, f, nodata: float | None = None) -> DataFrame:
    """f(value) in every valid cell: offset, scale, clamp, steps, levels."""
    return cells.withColumn("value", F.when(_valid("value", nodata), f(F.col("value"))).otherwise(F.col("value")))


def clamp(lo: float, hi: float):
    return lambda v: F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))


def steps(interval: float, offset: float = 0.0):
    return lambda v: F.floor((v - offset) / interval) * interval + offset


def statistics(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """min, max and count of the valid cells of each raster."""
    v = F.when(_valid("value", nodata), F.col("value"))
    return cells.groupBy("raster_id").agg(F.min(v).alias("vmin"), F.max(v).alias("vmax"), F.count(v).alias("n"))


#: Rows of statistics (one for each raster) that are broadcast at most.
MOST_RASTERS = 10_000


def with_statistics(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """Cells with the vmin, vmax and n of their raster. Statistics of up to MOST_RASTERS rasters are taken first and broadcast, so cells stay where they are; more are joined by a shuffle."""
    found = statistics(cells, nodata)
    rows = found.take(MOST_RASTERS + 1)
    if len(rows) > MOST_RASTERS:
        return cells.join(found, "raster_id", "left")
    return cells.join(F.broadcast(cells.sparkSession.createDataFrame(rows, found.schema)), "raster_id", "left")


def normalize(cells: DataFrame, lo: float = 0.0, hi: float = 1.0, nodata: float | None = None) -> DataFrame:
    """Linear to lo .. hi; a constant raster becomes lo."""
    scale = F.when(F.col("vmax") == F.col("vmin"), F.lit(0.0)).otherwise((hi - lo) / F.nullif(F.col("vmax") - F.col("vmin"), F.lit(0.0)))
    return with_statistics(cells, nodata).withColumn("value", F.when(_valid("value", nodata), lo + (F.col("value") - F.col("vmin")) * scale).otherwise(F.col("value"))).drop("vmin", "vmax", "n")


def hillshade(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    """v(x, y) - v(x-1, y-1), or 0 where one of the two is no-data; the left column copies x = 1 and the top row copies y = 1."""
    diagonal = Window.partitionBy("raster_id", F.col("x") - F.col("y")).orderBy("x")
    found = cells.select("raster_id", "x", "y", "value", F.lag("x").over(diagonal).alias("px"), F.lag("value").over(diagonal).alias("__from")).where("px = x - 1")
    shade = F.when(_valid("value", nodata) & _valid("__from", nodata), F.col("value") - F.col("__from")).otherwise(F.lit(0.0))
    inner = found.select("raster_id", "x", "y", shade.alias("value")).where("x > 0 and y > 0")
    # only the first two rows and columns meet again
    edge = cells.where("x = 0 or y = 0").select("raster_id", "x", "y", F.greatest("x", F.lit(1)).alias("ix"), F.greatest("y", F.lit(1)).alias("iy"))
    near = inner.where("x = 1 or y = 1").select("raster_id", F.col("x").alias("ix"), F.col("y").alias("iy"), "value")
    return inner.unionByName(edge.join(near, ["raster_id", "ix", "iy"]).select("raster_id", "x", "y", "value"))


def gaussian_kernel(radius: float) -> list[float]:
    if radius < 0:
        raise ValueError("radius must not be negative")
    n = math.ceil(2 * radius + 1)
    n += n % 2 == 0
    w = [math.exp(-((k - n // 2) ** 2) / (2 * (radius / 2.5) ** 2)) if radius else float(k == n // 2) for k in range(n)]
    return [x / sum(w) for x in w]


#: Side of the tiles that blurring works on, or twice the kernel's reach where that is more.
TILE = 256


def gaussian_blur(cells: DataFrame, radius: float, width: int, height: int, nodata: float | None = None) -> DataFrame:
    """Separable, edges extended. Cells that are missing or null give nothing. With nodata, such cells give nothing and keep their value, and the others share their weight.

    Each cell goes to the tiles within reach (at most nine), and a tile with its halo is one task's array of bounded size: one shuffle for any kernel.
    """
    kernel = gaussian_kernel(radius)
    cells = cells.select("raster_id", "x", "y", "value")
    if radius == 0:
        return cells
    r, weights = len(kernel) // 2, np.array(kernel)
    side = max(TILE, 2 * r)
    reach = lambda axis, size: F.sequence(F.floor(F.greatest(F.col(axis) - r, F.lit(0)) / side), F.floor(F.least(F.col(axis) + r, F.lit(size - 1)) / side))
    dealt = cells.withColumn("tx", F.explode(reach("x", width))).withColumn("ty", F.explode(reach("y", height)))

    def blur(frame: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(frame["tx"].iloc[0]) * side, int(frame["ty"].iloc[0]) * side
        w, h = min(side, width - x0), min(side, height - y0)
        low_x, low_y, high_x, high_y = max(0, x0 - r), max(0, y0 - r), min(width, x0 + w + r), min(height, y0 + h + r)
        x, y, v = frame["x"].to_numpy(), frame["y"].to_numpy(), frame["value"].to_numpy(dtype=float)
        ok = ~np.isnan(v) if nodata is None else ~np.isnan(v) & (v != nodata)

        def soft(values: np.ndarray) -> np.ndarray:
            a = np.zeros((high_y - low_y, high_x - low_x))
            a[y - low_y, x - low_x] = values
            a = np.pad(a, ((r - (y0 - low_y), r - (high_y - y0 - h)), (r - (x0 - low_x), r - (high_x - x0 - w))), mode="edge")
            a = sum(k * a[:, i : i + w] for i, k in enumerate(weights))
            return sum(k * a[i : i + h] for i, k in enumerate(weights))

        mine = (x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + h)
        at = y[mine] - y0, x[mine] - x0
        out = soft(np.where(ok, v, 0.0))[at]
        if nodata is not None:
            share = soft(ok.astype(float))[at]
            out = np.where(ok[mine] & (share > 0), out / np.where(share > 0, share, 1.0), v[mine])
        return pd.DataFrame({"raster_id": frame["raster_id"].to_numpy()[mine], "x": x[mine], "y": y[mine], "value": out})

    kind = dict(cells.dtypes)["raster_id"]
    return dealt.groupBy("raster_id", "tx", "ty").applyInPandas(blur, f"raster_id {kind}, x int, y int, value double")


#: Colour of a bottom and a top channel, 0 .. 1, by mode.
MODES = {"normal": lambda b, t: t, "multiply": lambda b, t: t * b}


def blend(bottom: tuple, top: tuple, mode="normal", strength: float = 1.0) -> list[Column]:
    """Channels r, g, b, a in 0 .. 255 of a pixel under another: bytes are cut, and colours are not divided by the resulting alpha. mode: of MODES, or a function of a bottom and a top channel."""
    if not callable(mode) and mode not in MODES:
        raise ValueError(f"no blend mode {mode}")
    mix = mode if callable(mode) else MODES[mode]
    *cb, ab = (c / 255 for c in bottom)
    *ct, at = (c / 255 for c in top)
    at = at * strength if strength < 1 else at
    out = [mix(b, t) * at + b * ab * (1 - at) for b, t in zip(cb, ct, strict=True)]
    return [(c * 255).cast("int") for c in (*out, at + ab * (1 - at))]


def blend_multiply(bottom: Column, top: Column, strength: float) -> Column:
    """Opaque channels 0 .. 255: multiplied, mixed by strength, truncated."""
    b, t = bottom / 255, top / 255
    return ((b * t * strength + b * (1 - strength)) * 255).cast("int")


def offset(amount: float):
    return lambda v: v + float(amount)


def scale(factor: float):
    return lambda v: v * float(factor)


def clamp_extremes(cells: DataFrame, bottom: float, top: float, nodata: float | None = None) -> DataFrame:
    """Cuts the lowest share `bottom` and the highest share `top` of the range (not of the cells)."""
    span = F.col("vmax") - F.col("vmin")
    v = F.least(F.greatest(F.col("value"), F.col("vmin") + span * bottom), F.col("vmax") - span * top)
    return with_statistics(cells, nodata).withColumn("value", F.when(_valid("value", nodata), v).otherwise(F.col("value"))).drop("vmin", "vmax", "n")


def sharpen(cells: DataFrame, radius: float, amount: float, width: int, height: int) -> DataFrame:
    """Unsharp mask: (v - amount * blurred) / (1 - amount)."""
    if amount == 1:
        raise ValueError("amount must not be 1")
    soft = gaussian_blur(cells, radius, width, height).withColumnRenamed("value", "soft")
    return cells.join(soft, ["raster_id", "x", "y"]).select("raster_id", "x", "y", ((F.col("value") - amount * F.col("soft")) / (1 - amount)).alias("value"))


def convolve(cells: DataFrame, kernel: list[float], axis: str) -> DataFrame:
    """A kernel of odd length along x or y; cells whose neighbourhood leaves the raster become 0."""
    if len(kernel) % 2 == 0:
        raise ValueError("the kernel's length must be odd")
    r, other = len(kernel) // 2, "y" if axis == "x" else "x"
    w = Window.partitionBy("raster_id", other).orderBy(axis)
    taps = [F.lag("value", r - k).over(w) * float(c) if k <= r else F.lead("value", k - r).over(w) * float(c) for k, c in enumerate(kernel)]
    return cells.select("raster_id", "x", "y", F.coalesce(sum(taps[1:], taps[0]), F.lit(0.0)).alias("value"))


def combine(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """f(value of a, value of b) of cells of one raster_id at the same place; both must have the same cells, or the query fails. Null values are data."""
    left, right = a.select("raster_id", "x", "y", F.col("value").alias("__a"), F.lit(True).alias("__in_a")), b.select("raster_id", "x", "y", F.col("value").alias("__b"), F.lit(True).alias("__in_b"))
    both = left.join(right, ["raster_id", "x", "y"], "full")
    same = F.when(F.col("__in_a").isNull() | F.col("__in_b").isNull(), F.raise_error(F.lit("rasters differ in size"))).otherwise(f(F.col("__a"), F.col("__b")))
    return both.select("raster_id", "x", "y", same.alias("value"))


def to_image(v: Column, factor: float = 255.0, nodata: float | None = None) -> list[Column]:
    """Grey r, g, b and alpha: rounded half to even and kept in 0 .. 255; no-data is transparent."""
    grey = F.least(F.greatest(F.rint(v * factor), F.lit(0.0)), F.lit(255.0)).cast("int")
    return [grey, grey, grey, F.lit(255) if nodata is None else F.when(v == nodata, 0).otherwise(255)]


def to_single_band(r: Column, g: Column, b: Column, a: Column, weights: tuple = (0.2126, 0.7152, 0.0722), factor: float = 1 / 255, nodata: float = -9999.0) -> Column:
    """Luminance; transparent pixels are no-data."""
    return F.when(a == 0, F.lit(nodata)).otherwise((r * weights[0] + g * weights[1] + b * weights[2]) * factor)


def merge_channels(r: Column, g: Column, b: Column, a: Column | None = None) -> list[Column]:
    """Channels 0 .. 1 as bytes, cut."""
    return [F.least(F.greatest((c * 255).cast("int"), F.lit(0)), F.lit(255)) for c in (r, g, b, F.lit(1.0) if a is None else a)]


def split_channels(r: Column, g: Column, b: Column, a: Column) -> list[Column]:
    """Bytes as channels 0 .. 1."""
    return [c / 255 for c in (r, g, b, a)]


def gradient_map(v: Column, stops: list) -> list[Column]:
    """Colours of a gradient as bytes, cut; opaque."""
    return [*((c * 255).cast("int") for c in gradient(v, stops)), F.lit(255)]
