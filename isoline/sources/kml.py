"""KML: each Placemark's point, line, polygon or collection of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.sources.features import POINTS, TAGS, finish, wound

_C = "struct<coordinates:string>"
_RING = f"struct<LinearRing:{_C}>"
_POLYGON = f"struct<outerBoundaryIs:{_RING},innerBoundaryIs:array<{_RING}>>"
_SCHEMA = f"""name string, description string,
ExtendedData struct<Data:array<struct<_name:string,value:string>>,SchemaData:struct<SimpleData:array<struct<_name:string,_VALUE:string>>>>,
Point {_C}, LineString {_C}, Polygon {_POLYGON}, MultiGeometry struct<Point:array<{_C}>,LineString:array<{_C}>,Polygon:array<{_POLYGON}>>"""


def _line(text: Column) -> Column:
    """Points of "lon,lat[,height] lon,lat ..."."""
    pieces = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda s: s != "")

    def point(s: Column) -> Column:
        n = F.split(s, ",")
        return F.struct(F.get(n, F.lit(0)).cast("double").alias("x"), F.get(n, F.lit(1)).cast("double").alias("y"))

    return F.transform(pieces, point)


def _rings(p: Column) -> Column:
    holes = F.coalesce(p["innerBoundaryIs"], F.array().cast(f"array<{_RING}>"))
    return F.concat(F.array(wound(_line(p["outerBoundaryIs"]["LinearRing"]["coordinates"]), F.lit(True))), F.transform(holes, lambda h: wound(_line(h["LinearRing"]["coordinates"]), F.lit(False))))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Members of a MultiGeometry are features of their own; a polygon with holes is a multipolygon. Tags: ExtendedData, after them name and description where these are not among them."""
    raw = spark.read.format("xml").option("rowTag", "Placemark").schema(_SCHEMA).load(path).withColumn("feature_id", F.monotonically_increasing_id())
    none = lambda kind: F.array().cast(f"array<{kind}>")
    several = lambda name, kind: F.concat(F.when(F.col(name).isNotNull(), F.array(name)).otherwise(none(kind)), F.coalesce(F.col(f"MultiGeometry.{name}"), none(kind)))
    geometry = lambda kind, parts: F.struct(kind.alias("geom_type"), parts.cast(f"array<{POINTS}>").alias("parts"))
    points = F.transform(several("Point", _C), lambda g: geometry(F.lit("point"), F.array(_line(g["coordinates"]))))
    lines = F.transform(several("LineString", _C), lambda g: geometry(F.lit("line"), F.array(_line(g["coordinates"]))))
    polygons = F.transform(several("Polygon", _POLYGON), lambda g: geometry(F.when(F.size(F.coalesce(g["innerBoundaryIs"], none(_RING))) > 0, "multipolygon").otherwise("polygon"), _rings(g)))
    data = F.concat(
        F.coalesce(F.transform("ExtendedData.Data", lambda d: F.struct(d["_name"].alias("key"), d["value"].alias("value"))), F.array().cast(TAGS)),
        F.coalesce(F.transform("ExtendedData.SchemaData.SimpleData", lambda d: F.struct(d["_name"].alias("key"), d["_VALUE"].alias("value"))), F.array().cast(TAGS)),
    )
    for k in ("name", "description"):
        data = F.when(F.col(k).isNotNull() & ~F.array_contains(F.transform(data, lambda t: t["key"]), k), F.concat(data, F.array(F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))))).otherwise(data)
    each = raw.select("feature_id", data.alias("tags"), F.explode(F.concat(points, lines, polygons)).alias("g"))
    return finish(each.select("feature_id", "g.geom_type", "g.parts", "tags"))
