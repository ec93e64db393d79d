"""What all vector sources give: (feature_id, geom_type, parts, tags, xmin, xmax, ymin, ymax, srid).

parts is array<array<struct<x,y>>> (a point is [[p]]), tags an ordered array<struct<key,value>>. Multipolygons are flat lists of rings: outer ones
run counter-clockwise, inner ones clockwise. Features without geometry are left out; empty sources give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoline.functions.bounds import intersects
from isoline.functions.crs import transform_box, transform_parts
from isoline.functions.geometry import area, is_closed

POINTS = "array<struct<x:double,y:double>>"
TAGS = "array<struct<key:string,value:string>>"
COLUMNS = ("feature_id", "geom_type", "parts", "tags", "xmin", "xmax", "ymin", "ymax", "srid")
BOX = ("xmin", "xmax", "ymin", "ymax")


def bounded(box: tuple | None) -> tuple:
    """Sources that have no end must be given a box of four finite sides."""
    if box is None or not all(map(math.isfinite, box)):
        raise ValueError("this source needs a box")
    return box


def finish(df: DataFrame, srid: int = 4326) -> DataFrame:
    """Adds boxes to (feature_id, geom_type, parts, tags) and leaves out what is too short: lines of one vertex, open rings."""
    flat = F.flatten("parts")
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    polygon, line = F.col("geom_type").isin("polygon", "multipolygon"), F.col("geom_type").isin("line", "multiline")
    ok = F.when(polygon, F.forall("parts", lambda c: (F.size(c) >= 4) & is_closed(c))).when(line, F.forall("parts", lambda c: F.size(c) >= 2)).otherwise(F.forall("parts", lambda c: F.size(c) >= 1))
    tags = F.coalesce(F.col("tags").cast(TAGS), F.array().cast(TAGS))
    out = df.where(F.col("parts").isNotNull() & (F.size("parts") > 0) & ok)
    return out.select("feature_id", "geom_type", "parts", tags.alias("tags"), F.array_min(xs).alias("xmin"), F.array_max(xs).alias("xmax"), F.array_min(ys).alias("ymin"), F.array_max(ys).alias("ymax"), F.lit(srid).alias("srid"))


def wound(ring: Column, outer: Column) -> Column:
    """Counter-clockwise if outer, else clockwise."""
    return F.when((area(ring) > 0) != outer, F.reverse(ring)).otherwise(ring)


def in_box(features: DataFrame, box: tuple) -> DataFrame:
    """Features whose boxes strictly overlap the box."""
    return features.where(intersects(BOX, box))


def reproject(features: DataFrame, target: int, source: int) -> DataFrame:
    """All features (of one system, source) in another."""
    if source == target:
        return features
    return finish(features.select("feature_id", "geom_type", transform_parts(F.col("parts"), source, target).alias("parts"), "tags"), target)


def get_data(features: DataFrame, source: int = 4326, box_wgs84: tuple | None = None, target: int | None = None) -> DataFrame:
    """The common contract: all features, or those in a box given in degrees; in their own system or another."""
    if box_wgs84 is not None:
        features = in_box(features, tuple(transform_box(box_wgs84, 4326, source)))
    return features if target is None else reproject(features, target, source)


#: What a kind's query also finds: a polygon is a closed line.
KINDS = {"point": ("point",), "line": ("line", "polygon"), "polygon": ("polygon",), "shape": None}


def of_type(features: DataFrame, kind: str) -> DataFrame:
    """Features of a kind: point, line (polygons too), polygon, or shape for all."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}")
    return features if KINDS[kind] is None else features.where(F.col("geom_type").isin(*KINDS[kind]))


def as_multi(features: DataFrame) -> DataFrame:
    """Points, lines and polygons as multi-geometries of one member."""
    return features.withColumn("geom_type", F.when(F.col("geom_type").isin("point", "line", "polygon"), F.concat(F.lit("multi"), F.col("geom_type"))).otherwise(F.col("geom_type")))


def as_lines(features: DataFrame) -> DataFrame:
    """Polygons as the lines around them; other kinds stay."""
    return features.withColumn("geom_type", F.when(F.col("geom_type") == "polygon", "line").when(F.col("geom_type") == "multipolygon", "multiline").otherwise(F.col("geom_type")))


def as_polygons(features: DataFrame) -> DataFrame:
    """Closed lines of four vertices or more as polygons; other features stay."""
    closed = F.forall("parts", lambda c: (F.size(c) >= 4) & is_closed(c))
    return features.withColumn("geom_type", F.when((F.col("geom_type") == "line") & closed, "polygon").when((F.col("geom_type") == "multiline") & closed, "multipolygon").otherwise(F.col("geom_type")))


def collect(features: DataFrame, key: str) -> DataFrame:
    """(key, geom_type, parts): all features of a key and kind as one multi-geometry, in order of feature_id. A key's geometry is one row, as it is one value."""
    base = F.regexp_replace("geom_type", "^multi", "")
    found = features.groupBy(key, F.concat(F.lit("multi"), base).alias("geom_type")).agg(F.array_sort(F.collect_list(F.struct("feature_id", "parts"))).alias("v"))
    return found.select(key, "geom_type", F.flatten(F.transform("v", lambda v: v["parts"])).alias("parts"))


def map_points(features: DataFrame, f) -> DataFrame:
    """f(x, y) -> (x, y) on every vertex; boxes follow."""
    def moved(p: Column) -> Column:
        x, y = f(p["x"], p["y"])
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    return finish(features.select("feature_id", "geom_type", F.transform("parts", lambda c: F.transform(c, moved)).alias("parts"), "tags"))
