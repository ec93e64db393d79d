"""The store that driver and executors share: folders, files of own formats, names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='isoline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/isoline/{uuid.uuid4().hex[:12]}"


def open_store(uri: str):
    """(filesystem, path) of a URI, for tasks that write or read files of their own formats."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class Part:
    """A file that is written piece by piece, under a name of the task's own until done()."""

    def __init__(self, uri: str) -> None:
        self.store, self.path = open_store(uri)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{os.path.dirname(self.path)}/_{uuid.uuid4().hex}"
        self.file = self.store.open_output_stream(self.part, compression=None)

    def write(self, data: bytes) -> None:
        self.file.write(data)

    def done(self) -> None:
        self.file.close()
        self.store.move(self.part, self.path)


def write_file(uri: str, data: bytes) -> None:
    """A whole file, under a name of the task's own until it is complete."""
    f = Part(uri)
    f.write(data)
    f.done()


def existing(spark: SparkSession, folder: str) -> list[str]:
    """The names of a folder's files; none where there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in store.listStatus(path)) if store.exists(path) else []
