"""Downloaded files kept on the store that driver and executors share, with a manifest of what was got, what is not there, and when.

The manifest is a Parquet table below the folder, to which each `get` adds; the newest row of a name counts. Files are fetched by tasks, so they do not pass
through the driver, and a repeated task writes the same file again. fetch(url) gives bytes, or None where there is no such file: that is kept, too, so
that missing files are not asked for again before absent_age_s.
"""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.sources.steps import Steps
from isoline.sources.store import existing, write_file

ENTRY = "name string, path string, bytes bigint, at double"


class FileCache:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> DataFrame:
        """The newest entry of each name; path is null where there is no such file."""
        if not existing(self.spark, f"{self.folder}/manifest"):
            return self.spark.createDataFrame([], ENTRY)
        rows = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/manifest")
        return rows.groupBy("name").agg(*(F.max_by(c, "at").alias(c) for c in ("path", "bytes")), F.max("at").alias("at"))

    def get(self, wanted: DataFrame, fetch: Callable[[str], bytes | None], max_age_s: float = float("inf"), absent_age_s: float = 86_400.0, now: float | None = None) -> DataFrame:
        """wanted: name, url. Returns name, path, bytes, state: cached, known absent, fetched or absent.

        A file older than max_age_s, or an absence older than absent_age_s, is asked for again. A .zip is unpacked: path is the folder of its members. A
        name that is wanted twice is fetched once; null names are left out.
        """
        now, folder = time.time() if now is None else float(now), self.folder

        def run(frames):
            for frame in frames:
                rows = []
                for name, url in zip(frame["name"], frame["url"], strict=True):
                    data, path = fetch(url), f"{folder}/files/{name}"
                    if data is not None and name.endswith(".zip"):
                        path = path.removesuffix(".zip")
                        with zipfile.ZipFile(io.BytesIO(data)) as z:
                            for member in z.namelist():
                                if not member.endswith("/"):
                                    write_file(f"{path}/{member.rpartition('/')[2]}", z.read(member))
                    elif data is not None:
                        write_file(path, data)
                    rows.append((name, None if data is None else path, None if data is None else len(data), now))
                yield pd.DataFrame(rows, columns=["name", "path", "bytes", "at"])

        asked = wanted.where("name is not null").groupBy("name").agg(F.min("url").alias("url")).join(self.entries(), "name", "left")
        fresh = F.col("at").isNotNull() & (F.lit(now) - F.col("at") <= F.when(F.col("path").isNull(), F.lit(absent_age_s)).otherwise(F.lit(max_age_s)))
        known = asked.where(fresh).select("name", "path", "bytes", F.when(F.col("path").isNull(), "known absent").otherwise("cached").alias("state"))
        steps = Steps(self.spark)
        known = steps.keep(known)  # before the manifest grows
        new = steps.keep(asked.where(~fresh).select("name", "url").mapInPandas(run, ENTRY))
        new.write.mode("append").parquet(f"{folder}/manifest")
        return known.unionByName(new.select("name", "path", "bytes", F.when(F.col("path").isNull(), "absent").otherwise("fetched").alias("state")))

    def newest(self, base: str, extension: str, max_age_s: float, now: float | None = None) -> str | None:
        """The path of the newest file base*extension that is not older than max_age_s, or None."""
        now = time.time() if now is None else now
        fit = self.entries().where(F.col("name").startswith(base) & F.col("name").endswith(extension) & F.col("path").isNotNull() & (F.lit(now) - F.col("at") <= max_age_s))
        found = fit.orderBy(F.desc("at"), "name").limit(1).collect()
        return found[0]["path"] if found else None
