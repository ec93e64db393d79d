"""Names of one-degree height tiles, and the choice of catalogued files by box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.sources.features import bounded
from isoline.sources.files import existing
from isoline.sources.rasters import read_raster


def cover(boxes: DataFrame, box: tuple = ("xmin", "xmax", "ymin", "ymax")) -> DataFrame:
    """One row per box and degree tile that it reaches into: tx and ty are the tile's lower left corner."""
    x0, x1, y0, y1 = box
    degrees = lambda lo, hi: F.explode(F.sequence(F.floor(lo), F.greatest(F.ceil(hi) - 1, F.floor(lo))))
    return boxes.withColumn("tx", degrees(x0, x1)).withColumn("ty", degrees(y0, y1))


def srtm_name(tx: Column, ty: Column) -> Column:
    """By the lower left corner: N55W005."""
    return F.format_string("%s%02d%s%03d", F.when(ty >= 0, "N").otherwise("S"), F.abs(ty), F.when(tx >= 0, "E").otherwise("W"), F.abs(tx))


def usgs_name(tx: Column, ty: Column) -> Column:
    """By the upper left corner: n43w070. Null outside the north-western quarter of the globe, which the naming covers."""
    return F.when((tx < 0) & (ty >= 0), F.format_string("n%02dw%03d", ty + 1, -tx))


def available(tiles: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """Tiles whose name the catalogue has; the others are seas or gaps."""
    return tiles.join(catalogue.select(name), name, "left_semi")


def read_tiles(spark: SparkSession, folder: str, box: tuple, side: int, extension: str = "hgt") -> DataFrame:
    """One raster "tiles" (raster_id, x, y, value) of the degree tiles below a box (xmin, xmax, ymin, ymax), from files named by `srtm_name`; missing ones are seas or gaps.

    side: cells of a tile's side, the last of which is the next tile's first. x = 0, y = 0 is the upper left corner of the box's tiles.
    """
    box = bounded(box)
    x0, x1, y0, y1 = math.floor(box[0]), math.ceil(box[1]), math.floor(box[2]), math.ceil(box[3])
    have = set(existing(spark, folder))
    names = {f"{'N' if y >= 0 else 'S'}{abs(y):02d}{'E' if x >= 0 else 'W'}{abs(x):03d}": (x, y) for x in range(x0, x1) for y in range(y0, y1)}  # at most 64,800
    found = {n: at for n, at in names.items() if f"{n}.{extension}" in have}
    if not found:
        return spark.createDataFrame([], "raster_id string, x int, y int, value double")
    place = spark.createDataFrame([(n, (x - x0) * (side - 1), (y1 - 1 - y) * (side - 1)) for n, (x, y) in found.items()], "raster_id string, dx int, dy int")
    cells = read_raster(spark, [f"{folder}/{n}.{extension}" for n in found]).join(F.broadcast(place), "raster_id")
    return cells.select(F.lit("tiles").alias("raster_id"), (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "value").groupBy("raster_id", "x", "y").agg(F.max("value").alias("value"))
