"""Shared plumbing of the training-data operators: the cluster's shared folder, written intermediate tables, crc32 splits."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SUFFIX = ".parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}{TABLE_SUFFIX}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='isoline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/isoline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors, and is computed once."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_fs(uri: str):
    """(filesystem, path) of a shared-folder URI, for executors that write or read their own file formats."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def path_exists(spark: SparkSession, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: Keys that `join_keys` may broadcast at most, and the rows below which a key is never hot.
HOT_KEYS, HOT_ROWS = 10_000, 500


def join_keys(left: DataFrame, right: DataFrame, key: str | list[str], rows: str, how: str = "inner") -> DataFrame:
    """left joined ("inner" or "left") with right, which has each key once and, in column `rows`, how many rows left has of it.

    Keys that hold more than total / HOT_KEYS rows (HOT_ROWS at least) are met by a broadcast, so no task gets all rows of a hot key; as total is the sum
    of right's rows, there are fewer than HOT_KEYS of them however large the tables are. All others are met by a shuffle. left is read twice.
    """
    sums = right.agg(F.sum(rows).alias("total"), F.max(rows).alias("most")).first()
    limit = max(HOT_ROWS, (sums["total"] or 0) // HOT_KEYS)
    if (sums["most"] or 0) <= limit:
        return left.join(right, key, how)
    hot = F.col(rows) > limit
    often = F.broadcast(right.where(hot))
    rare = left.join(F.broadcast(right.where(hot).select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(right.where(~hot), key, how)
    return left.join(often, key).unionByName(rare)


#: Ids of a semi or anti join that are broadcast at most (8 bytes each, some eight times that in a hash relation).
BROADCAST_IDS = 200_000


def counted(ids: DataFrame) -> DataFrame:
    """A written table of one id column with its way of joining: broadcast where its count allows it, else a shuffled hash table."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")


def sweep(spark: SparkSession, folder: str, kept: list[str]) -> None:
    """Removes files of a folder of one writing that lost or repeated attempts left: those whose name, up to its first dot, is not kept."""
    path, names = spark._jvm.org.apache.hadoop.fs.Path(folder), {k.rpartition("/")[2].partition(".")[0] for k in kept}
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for f in store.listStatus(path) if store.exists(path) else ():
        if f.getPath().getName().partition(".")[0] not in names:
            store.delete(f.getPath(), False)


class Scratch:
    """Written tables that no result reads: clear() removes them together."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.n = spark, fresh_path(spark, label), 0

    def written(self, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n:03d}-{label}"
        df.write.option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def added(self, df: DataFrame, label: str) -> DataFrame:
        """Adds df to the table of this label and reads back all of it."""
        path = f"{self.folder}/{label}"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; the remainder of a null id is -1, so it is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(-1))


_HELD: dict = {}


def held(name, make):
    """make(), kept by a Python worker until something else is asked for: workers are used again by other operators, and one table at a time bounds their memory."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


#: Bytes of texts in one slice, unless a single row holds more.
SLICE_BYTES = 1 << 24


def rows_of(batches, size: int, most: int = SLICE_BYTES):
    """Arrow batches cut into slices of at most `size` rows and, but for single rows, `most` bytes of text, so that Python objects of one slice bound the memory."""
    for b in batches:
        texts = [c for c in b.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type)]
        held = np.zeros(b.num_rows + 1, np.int64)
        for c in texts:
            held[1:] += np.cumsum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = min(at + size, max(at + 1, int(np.searchsorted(held, held[at] + most, side="right")) - 1))
            yield b.slice(at, end - at)
            at = end


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
