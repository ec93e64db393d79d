"""Connected components over an edge table, by alternating large-star and small-star contraction; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.llm.common import join_keys, written


def connected_components(edges: DataFrame, label: str = "components", write=written) -> DataFrame:
    """edges (u, v), bigint. Returns (node, component) for every node with an edge to another node; component is the smallest node reachable.

    Null ends, loops, repeated and reversed edges are allowed. Hot nodes are met by a partial minimum and a broadcast. write keeps the
    tables between rounds; the result reads the last of them.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = write(e, label)
    before = None
    while True:
        # large star: every neighbour larger than the node points to the least of the neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum(F.expr("cast(v > u as bigint)")).alias("larger")), label)
        large = join_keys(both.where("v > u"), least, "u", "larger").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node itself, points to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        e = write(small, label)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
