"""Tables that the steps of an iteration leave on the store which driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isoline.sources.store import shared_folder


class Steps:
    """keep(df) writes df and reads it back: lineage ends there, lost executors cost no more than a step, and nothing is computed twice."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:04d}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
