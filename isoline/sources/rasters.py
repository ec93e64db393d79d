"""Raster files as cells (raster_id, band, x, y, value): heights (.hgt), .npy, PGM/PPM, 8-bit PNG and TIFF.

Files are read as binary by Spark, from any store; a file is one task's work and leaves it in blocks of rows (`tiff` reads large TIFF files by blocks).
Everything else raises.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 65536


def decode(name: str, data: bytes) -> np.ndarray:
    """Bands, rows, columns."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "hgt":
        side = int(round((len(data) / 2) ** 0.5))
        if side * side * 2 != len(data):
            raise ValueError("a .hgt file must be square")
        return np.frombuffer(data, ">i2").reshape(1, side, side)
    if kind == "npy":
        a = np.load(io.BytesIO(data), allow_pickle=False)
        return a[None] if a.ndim == 2 else np.moveaxis(a, 2, 0)
    if kind in ("pgm", "ppm", "pnm"):
        m = re.match(rb"(P[56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
        if not m:
            raise ValueError("only binary PGM and PPM files are supported")
        w, h, top = (int(v) for v in m.groups()[1:])
        bands = 3 if m[1] == b"P6" else 1
        return np.moveaxis(np.frombuffer(data, ">u2" if top > 255 else "u1", w * h * bands, m.end()).reshape(h, w, bands), 2, 0)
    if kind == "png":
        from isoline.render.png import decode as decode_png

        return decode_png(data)
    if kind in ("tif", "tiff"):
        from isoline.sources.tiff import decode as decode_tiff

        return decode_tiff(data)
    raise ValueError(f"raster files of kind {kind} are not supported")


def blocks(name: str, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, bands x rows x columns), some rows at a time; a PNG file is unpacked as they are taken."""
    if name.lower().endswith(".png"):
        from isoline.render.png import blocks as png_blocks

        yield from png_blocks(data, BLOCK)
        return
    bands = decode(name, bytes(data))
    rows = max(1, BLOCK // bands.shape[2])
    for y in range(0, bands.shape[1], rows):
        yield y, bands[:, y : y + rows]


def read_raster(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """raster_id is the file's name without its extension; band counts from 1. nodata: only a remark for the caller, cells keep it."""
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("name"), "content")

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["name"], frame["content"], strict=True):
                for y, bands in blocks(name, content):
                    for k, block in enumerate(bands):
                        yy, xx = np.indices(block.shape)
                        yield pd.DataFrame({"raster_id": name.rsplit(".", 1)[0], "band": k + 1, "x": xx.ravel(), "y": (yy + y).ravel(), "value": block.ravel().astype("float64")})

    return files.mapInPandas(cells, "raster_id string, band int, x int, y int, value double")


def raster_meta(cells: DataFrame) -> DataFrame:
    """Bands, size and range of each raster."""
    return cells.groupBy("raster_id").agg(F.max("band").alias("bands"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.min("value").alias("vmin"), F.max("value").alias("vmax"))
