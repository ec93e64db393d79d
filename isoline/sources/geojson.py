"""GeoJSON files: a Feature or FeatureCollection each; parsed by Spark's JSON reader, coordinates by their kind's nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions.geometry import area, contains
from isoline.sources.features import POINTS, finish

_GEOMETRY = "struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>"
_SCHEMA = f"type string, geometry {_GEOMETRY}, properties string, features array<struct<geometry:{_GEOMETRY},properties:string>>"


def _coords(depth: int) -> Column:
    return F.from_json(F.col("g.coordinates"), "array<" * depth + "array<double>" + ">" * depth)


def _p(a: Column) -> Column:
    return F.struct(F.get(a, F.lit(0)).alias("x"), F.get(a, F.lit(1)).alias("y"))


def _line(c: Column) -> Column:
    return F.transform(c, _p)


def _tags(properties: Column) -> Column:
    """Every property as text; true and false are written True and False, objects and lists as JSON."""
    entries = F.map_entries(F.from_json(properties, "map<string,variant>"))
    def text(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        plain = F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
        return F.when(kind == "BOOLEAN", F.initcap(plain)).otherwise(plain)

    return F.transform(entries, lambda e: F.struct(e["key"].alias("key"), text(e["value"]).alias("value")))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Each polygon of a MultiPolygon is a feature of its own; a polygon with holes is a multipolygon. Members of a GeometryCollection share properties.

    lines: one Feature a line, which Spark splits; otherwise a file is one task's work. feature_id orders features within the read.
    """
    raw = spark.read.schema(_SCHEMA).json(path, multiLine=not lines)
    one = F.array(F.struct("geometry", "properties"))
    f = raw.select(F.explode(F.coalesce("features", one)).alias("f")).select("f.geometry", "f.properties").where("geometry is not null").withColumn("feature_id", F.monotonically_increasing_id())
    own = F.array(F.struct(F.col("geometry.type").alias("type"), F.col("geometry.coordinates").alias("coordinates")))
    g = f.select("feature_id", "properties", F.explode(F.coalesce("geometry.geometries", own)).alias("g"))
    parts = (
        F.when(F.col("g.type") == "Point", F.array(F.array(F.array(_p(_coords(0))))))
        .when(F.col("g.type") == "MultiPoint", F.array(F.transform(_coords(1), lambda a: F.array(_p(a)))))
        .when(F.col("g.type") == "LineString", F.array(F.array(_line(_coords(1)))))
        .when(F.col("g.type") == "MultiLineString", F.array(F.transform(_coords(2), _line)))
        .when(F.col("g.type") == "Polygon", F.array(F.transform(_coords(2), _line)))
        .when(F.col("g.type") == "MultiPolygon", F.transform(_coords(3), lambda p: F.transform(p, _line)))
    ).cast(f"array<array<{POINTS}>>")
    kind = F.element_at(F.create_map(*map(F.lit, ("Point", "point", "MultiPoint", "multipoint", "LineString", "line", "MultiLineString", "multiline"))), F.col("g.type"))
    each = g.select("feature_id", "properties", kind.alias("kind"), F.explode(parts).alias("parts"))
    named = F.coalesce("kind", F.when(F.size("parts") == 1, "polygon").otherwise("multipolygon"))
    return finish(each.select("feature_id", named.alias("geom_type"), "parts", _tags(F.col("properties")).alias("tags")))


def _polygons(parts: Column) -> Column:
    """Rings as polygons: each counter-clockwise ring with the clockwise ones that it is the smallest to hold; without a counter-clockwise ring, all are one polygon."""
    outer, inner = F.filter(parts, lambda c: area(c) > 0), F.filter(parts, lambda c: area(c) <= 0)
    holds = lambda o, i: contains(o, i[0]["x"], i[0]["y"]) | F.exists(o, lambda p: p == i[0])
    smallest = lambda i: F.array_min(F.transform(F.filter(outer, lambda q: holds(q, i)), area))
    several = F.transform(outer, lambda o: F.concat(F.array(o), F.filter(inner, lambda i: holds(o, i) & (area(o) == smallest(i)))))
    return F.when(F.size(outer) == 1, F.array(F.concat(outer, inner))).when(F.size(outer) == 0, F.array(parts)).otherwise(several)


def to_geojson(features: DataFrame) -> DataFrame:
    """(value): one Feature a line, for write.text; the inverse of read_geojson with lines. A multipolygon with several outer rings is a MultiPolygon."""
    at = lambda p: F.array(p["x"], p["y"])
    line = lambda c: F.transform(c, at)
    lines = F.transform("parts", line)
    polygons = _polygons(F.col("parts"))
    many = (F.col("geom_type") == "multipolygon") & (F.size(polygons) > 1)
    names = F.element_at(F.create_map(*map(F.lit, ("point", "Point", "multipoint", "MultiPoint", "line", "LineString", "multiline", "MultiLineString", "polygon", "Polygon", "multipolygon", "Polygon"))), F.col("geom_type"))
    kind = F.when(many, F.lit("MultiPolygon")).otherwise(names)
    coords = (
        F.when(F.col("geom_type") == "point", F.to_json(lines[0][0]))
        .when(F.col("geom_type") == "line", F.to_json(lines[0]))
        .when(F.col("geom_type") == "multipoint", F.to_json(F.transform(lines, lambda c: c[0])))
        .when(many, F.to_json(F.transform(polygons, lambda p: F.transform(p, line))))
        .when(F.col("geom_type") == "multipolygon", F.to_json(F.transform(polygons[0], line)))
        .otherwise(F.to_json(lines))
    )
    first = F.aggregate("tags", F.expr("cast(map() as map<string,string>)"), lambda m, t: F.when(F.map_contains_key(m, t["key"]), m).otherwise(F.map_concat(m, F.create_map(t["key"], t["value"]))))
    return features.select(F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":'), F.to_json(first), F.lit("}")).alias("value"))
