"""OSM XML: nodes, ways and multipolygon relations as features, assembled by equi joins on node and way ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions.geometry import is_closed
from isoline.sources import osm_elements
from isoline.sources.features import TAGS, bounded, finish, wound
from isoline.sources.steps import Steps

#: Tags that are not kept (* stands for any rest), and keys that make a closed way a polygon.
IGNORED = ("note", "note:*", "source", "source_ref", "source:*", "attribution", "comment", "fixme", "tiger:*", "NHD:*", "nhd:*", "gnis:*", "massgis:*")
AREA_KEYS = ("aeroway", "amenity", "area", "building", "harbour", "historic", "landuse", "leisure", "man_made", "military", "natural", "office", "place", "power", "public_transport", "shop", "sport", "tourism", "water", "waterway", "wetland")

#: The tag of features that lack a node or a way of theirs.
INCOMPLETE = ("isoline:incomplete", "yes")

def kept_tags(tags: Column) -> Column:
    plain = [k for k in IGNORED if not k.endswith("*")]
    prefixes = [k[:-1] for k in IGNORED if k.endswith("*")]

    def keep(t: Column) -> Column:
        out = ~t["key"].isin(*plain)
        for p in prefixes:
            out = out & ~t["key"].startswith(p)
        return out

    return F.coalesce(F.filter(tags, keep), F.array().cast(TAGS))


def is_polygon(c: Column, tags: Column) -> Column:
    return is_closed(c) & (F.size(c) >= 4) & F.exists(tags, lambda t: t["key"].isin(*AREA_KEYS))


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Features with tags only. The file is parsed in one scan (`osm_elements`), whose rows are kept on the shared store. Vertices whose node is missing are left out, as are rings whose way is, and the feature then bears the tag INCOMPLETE; a relation with a ring that is open or too short is left out. Ids repeat between kinds, so a feature is known by (geom_type, feature_id)."""
    flagged = lambda tags, lacking: F.when(lacking, F.concat(tags, F.array(F.struct(F.lit(INCOMPLETE[0]).alias("key"), F.lit(INCOMPLETE[1]).alias("value"))))).otherwise(tags)
    osm_elements.register(spark)
    steps = Steps(spark)
    elements = steps.keep(spark.read.format("isoline_osm").load(path).where("id is not null").withColumnRenamed("id", "_id"))  # kinds follow each other in a file, so a scan for one kind skips the others' row groups
    nodes = elements.where("kind = 'node'").select("_id", F.struct("x", "y").alias("p"), kept_tags(F.col("tags")).alias("tags"))
    points = nodes.where(F.size("tags") > 0).select(F.col("_id").alias("feature_id"), F.lit("point").alias("geom_type"), F.array(F.array("p")).alias("parts"), "tags")

    ways = elements.where("kind = 'way'")
    refs = ways.select("_id", F.posexplode("refs").alias("pos", "ref"))
    placed = refs.join(nodes.select(F.col("_id").alias("ref"), "p"), "ref").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("v"))
    lines = steps.keep(placed.select("_id", F.transform("v", lambda v: v["p"]).alias("c")))
    tagged = ways.select("_id", kept_tags(F.col("tags")).alias("tags"), F.size("refs").alias("refs")).where(F.size("tags") > 0).join(lines, "_id")
    tagged = tagged.withColumn("tags", flagged(F.col("tags"), F.col("refs") > F.size("c")))
    kind = F.when(is_polygon(F.col("c"), F.col("tags")), "polygon").otherwise("line")
    way_features = tagged.select(F.col("_id").alias("feature_id"), kind.alias("geom_type"), F.array("c").alias("parts"), "tags")

    relations = elements.where("kind = 'relation'").where(F.exists("tags", lambda t: (t["key"] == "type") & (t["value"] == "multipolygon"))).select("_id", "members", kept_tags(F.col("tags")).alias("tags"))
    members = relations.where(F.size("tags") > 0).select("_id", "tags", F.posexplode("members").alias("pos", "m")).where("m.type = 'way'")
    inline = F.col("m.nd")
    rings = members.join(lines.select(F.col("_id").alias("way"), "c"), F.col("m.ref") == F.col("way"), "left").select("_id", "tags", "pos", F.col("m.role").alias("role"), F.coalesce("c", F.when(F.size(inline) > 0, inline)).alias("c"))
    turned = F.when(F.col("role").isin("outer", "inner"), wound(F.col("c"), F.col("role") == "outer")).otherwise(F.col("c"))
    whole = rings.groupBy("_id").agg(F.first("tags").alias("tags"), F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("pos", turned.alias("c"))))).alias("v"), F.bool_or(F.col("c").isNull()).alias("lacking"))
    relation_features = whole.select(F.col("_id").alias("feature_id"), F.lit("multipolygon").alias("geom_type"), F.transform("v", lambda v: v["c"]).alias("parts"), flagged(F.col("tags"), F.col("lacking")).alias("tags"))
    return finish(points.unionByName(way_features).unionByName(relation_features))


def overpass_url(box: tuple, server: str) -> str:
    """The address that gives all data in a box (xmin, xmax, ymin, ymax); without a box there would be no end."""
    box = bounded(box)
    return "{}/map?bbox={:g},{:g},{:g},{:g}".format(server.rstrip("/"), box[0], box[2], box[1], box[3])
