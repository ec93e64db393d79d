"""Features derived from the supplied tables: points, boxes, lines, rings and a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.functions.tags import make_tags


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over many tasks, for costly functions of a row: a small file would be one task's work. by: rows that are alike in these come to one task."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    lon = (F.col("event_id") * 7919 % 36000) / F.lit(100.0) - 180
    lat = (F.col("event_id") * 15487 % 17000) / F.lit(100.0) - 85
    return e.select("event_id", lon.alias("lon"), lat.alias("lat"), "value", make_tags(type=F.col("event_type"), user=F.col("user_id").cast("string")).alias("tags"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    x, y = (k * 37 % 360 - 180).cast("double"), (k * 53 % 170 - 85).cast("double")
    return read(spark, sf_dir, "part").select("p_partkey", x.alias("xmin"), (x + size).alias("xmax"), y.alias("ymin"), (y + size / F.lit(2.0)).alias("ymax"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", (F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).cast("double").alias("x"), (F.col("l_suppkey") % 50).cast("double").alias("y")).alias("v"))
    c = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("v")).alias("v")).where(F.size("v") >= 2)
    return c.select("l_orderkey", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("c"))


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y, w, h = ((v).cast("double") for v in (k * 31 % 300, k * 17 % 120, F.col("s_nationkey") + 1, k % 7 + 1))
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h), p(x, y)).alias("c"))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.lit("r").alias("raster_id"), (i % 100).cast("int").alias("x"), F.floor(i / 100).cast("int").alias("y"), "value")
