"""Parallels and meridians as lines of segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.sources.features import finish


def graticule(spark: SparkSession, box: tuple, x_interval: float, y_interval: float, x_start: float = -180.0, y_start: float = -90.0, segments: int = 10) -> DataFrame:
    """box: xmin, xmax, ymin, ymax. Lines lie at start + k * interval, up to one past the box; vertices of a line reach from one step before the box to one past it. Tags: Latitude or Longitude, three decimals."""
    x0, x1, y0, y1 = box

    def along(lo: float, hi: float, start: float, step: float) -> Column:
        first, last = max(0, math.ceil((lo - step - start) / step - 1e-9)), math.ceil((hi + step - start) / step - 1e-9) - 1
        return F.transform(F.sequence(F.lit(first), F.lit(max(first, last))), lambda k: F.lit(start) + k * step)

    def lines(name: str, at: float, top: float, step: float, vertices: Column, point) -> DataFrame:
        n = max(0, math.ceil((top + step - at) / step - 1e-9))
        df = spark.range(n).withColumn("at", F.lit(float(at)) + F.col("id") * float(step))
        tags = F.array(F.struct(F.lit(name).alias("key"), F.format_string("%.3f", "at").alias("value")))
        return df.select("id", F.lit("line").alias("geom_type"), F.array(F.transform(vertices, point)).alias("parts"), tags.alias("tags"))

    xs, ys = along(x0, x1, x_start, x_interval / segments), along(y0, y1, y_start, y_interval / segments)
    parallels = lines("Latitude", y_start, y1, y_interval, xs, lambda v: F.struct(v.alias("x"), F.col("at").alias("y"))).withColumn("feature_id", F.col("id") * 2)
    meridians = lines("Longitude", x_start, x1, x_interval, ys, lambda v: F.struct(F.col("at").alias("x"), v.alias("y"))).withColumn("feature_id", F.col("id") * 2 + 1)
    return finish(parallels.unionByName(meridians))
