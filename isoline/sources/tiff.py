"""TIFF files by blocks: strips or tiles; uncompressed, LZW, Deflate or PackBits; horizontal and floating-point predictors; TIFF and BigTIFF.

`spark.read.format("isoline_tiff").load(path)` gives cells (raster_id, band, x, y, value). A file is split into byte ranges, and a partition reads the blocks
that start in its range, so one large file is the work of many tasks. Comparisons of x, y, band and raster_id with constants are pushed to the reader: files
and blocks that they exclude are not read. `write_tiff` writes a raster as files of square regions, each placed by its tie point.
LZW is decoded code by code in Python, about ten times as slow as Deflate.
"""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from isoline.sources.store import open_store, write_file

# Fixed values of the format: sizes and codes of field types, compressions, and tags.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, BANDS, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT, SCALE, TIE, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113

SCHEMA = "raster_id string, band int, x int, y int, value double"
_ARROW = pa.schema([("raster_id", pa.string()), ("band", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("value", pa.float64())])


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the first bit first; the width grows one code early."""
    single = [bytes([k]) for k in range(256)]
    table: list[bytes] = [*single, b"", b""]
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            table, width, last = [*single, b"", b""], 9, b""
            continue
        if code == 257:
            break
        if not last:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("damaged LZW data")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        n = len(table) + 1
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def fresh() -> None:
        nonlocal table, width
        put(256)
        table, width = {bytes([k]): k for k in range(256)}, 9

    fresh()
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        n = len(table) + 2
        if n >= 4094:
            fresh()
        else:
            width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        word = data[k : k + 1]
    if word:
        put(table[word])
        n = len(table) + 3
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three bytes and more as runs, others as they are."""
    a = np.frombuffer(data, np.uint8)
    starts = np.r_[0, np.flatnonzero(np.diff(a)) + 1, len(a)] if len(a) else np.array([0])
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            part = plain[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if e - s < 3:
            plain.extend(data[s:e])
            continue
        flush()
        for k in range(s, e, 128):
            n = min(128, e - k)
            out.extend((257 - n & 255, data[k]) if n > 1 else (0, data[k]))
    flush()
    return bytes(out)


UNPACK = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}
PACK = {"none": (NONE, bytes), "lzw": (LZW, pack_lzw), "deflate": (DEFLATE, zlib.compress), "packbits": (PACKBITS, pack_bits)}


@dataclass
class Layout:
    """Where the blocks of a file's first image are, and how to decode them."""

    width: int
    height: int
    bands: int
    kind: np.dtype
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    compression: int
    predictor: int
    apart: bool
    palette: np.ndarray | None
    origin: tuple[int, int]
    nodata: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[0])

    def place(self, k: int) -> tuple[int, int, int]:
        """The first band, column and row of block k."""
        each = self.across * -(-self.height // self.block[1])
        return (k // each if self.apart else 0), k % each % self.across * self.block[0], k % each // self.across * self.block[1]

    def decode(self, k: int, data: bytes) -> np.ndarray:
        """Block k: bands, rows, columns, without what lies outside of the image."""
        _, x, y = self.place(k)
        w, n = self.block[0], 1 if self.apart else self.bands
        raw, size = UNPACK[self.compression](data), self.kind.itemsize
        h = min(self.block[1], len(raw) // (w * n * size))  # the last strip may be short
        raw = raw[: h * w * n * size]
        if self.predictor == 3:  # bytes of a row by significance, each the difference from the one before it in its band
            rows = np.frombuffer(raw, np.uint8).reshape(h, w * size, n)
            planes = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(h, size, w * n)
            a = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.kind.newbyteorder(">")).reshape(h, w, n)
        else:
            a = np.frombuffer(raw, self.kind).reshape(h, w, n)
            if self.predictor == 2:
                a = np.cumsum(a.astype(self.kind.newbyteorder("=")), axis=1, dtype=self.kind.newbyteorder("="))
        a = np.moveaxis(a, 2, 0)[:, : self.height - y, : self.width - x]
        return self.palette[:, a[0]] if self.palette is not None else a


def layout(read, size: int) -> Layout:
    """read(offset, n) -> bytes of the file."""
    head = read(0, 16)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    order = "<" if head[:2] == b"II" else ">"
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count, entry, place = ("Q", 20, 8) if big else ("H", 12, 4)
    n = struct.unpack(order + count, read(at, struct.calcsize(count)))[0]
    body, tags = read(at + struct.calcsize(count), entry * n), {}
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + ("HHQ" if big else "HHI"), body, entry * k)
        if kind in TYPES:
            code = f"{order}{many}{TYPES[kind]}" if kind != 2 else f"{many}s"
            room, value = struct.calcsize(code), entry * k + entry - place
            data = body[value : value + room] if room <= place else read(struct.unpack_from(order + ("Q" if big else "I"), body, value)[0], room)
            tags[tag] = struct.unpack(code, data)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, bits = one(WIDTH), one(HEIGHT), set(tags.get(BITS, (1,)))
    tiled = TILE_AT in tags
    if one(COMPRESSION, 1) not in UNPACK or len(bits) > 1 or bits.pop() not in (8, 16, 32, 64) or not (tiled or STRIP_AT in tags):
        raise ValueError("only TIFF files of whole bytes, uncompressed or with LZW, Deflate or PackBits, are supported")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[one(FORMAT, 1)]}{one(BITS) // 8}")
    block = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    palette = np.array(tags[PALETTE]).reshape(3, -1) >> 8 if one(PHOTOMETRIC) == 3 else None
    tie, nodata = tags.get(TIE, (0,) * 6), one(NODATA)
    unit = SCALE in tags and tags[SCALE][:2] == (1.0, 1.0)
    origin = (int(tie[3] - tie[0]), int(tie[4] - tie[1])) if unit else (0, 0)
    return Layout(width, height, one(BANDS, 1), kind, block, tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES], one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and one(BANDS, 1) > 1, palette, origin, float(nodata.split(b"\0")[0]) if nodata else None)


def decode(data: bytes) -> np.ndarray:
    """A whole file: bands, rows, columns."""
    f = layout(lambda at, n: data[at : at + n], len(data))
    out = np.zeros((3 if f.palette is not None else f.bands, f.height, f.width), int if f.palette is not None else f.kind.newbyteorder("="))
    for k, (at, n) in enumerate(zip(f.offsets, f.sizes, strict=True)):
        band, x, y = f.place(k)
        a = f.decode(k, data[at : at + n])
        out[band : band + len(a), y : y + a.shape[1], x : x + a.shape[2]] = a
    return out


def encode(bands: np.ndarray, compression: str = "deflate", tile: int = 256, predictor: int = 1, origin: tuple[int, int] = (0, 0), nodata: float | None = None) -> bytes:
    """bands, rows, columns as a TIFF file of tiles; tile is a multiple of 16."""
    n, h, w = bands.shape
    kind = bands.dtype.newbyteorder("<")
    code, pack = PACK[compression]
    blocks = []
    for y in range(0, h, tile):
        for x in range(0, w, tile):
            a = np.zeros((tile, tile, n), kind)
            part = np.moveaxis(bands[:, y : y + tile, x : x + tile], 0, 2)
            a[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                a = np.diff(a, axis=1, prepend=np.zeros((tile, 1, n), kind)).astype(kind)
            raw = a.tobytes()
            if predictor == 3:
                planes = np.ascontiguousarray(a.astype(kind.newbyteorder(">"))).view(np.uint8).reshape(tile, tile * n, kind.itemsize).transpose(0, 2, 1).reshape(tile, tile * kind.itemsize, n)
                raw = np.diff(planes, axis=1, prepend=np.zeros((tile, 1, n), np.uint8)).astype(np.uint8).tobytes()
            blocks.append(pack(raw))
    at = 8 + np.cumsum([0, *map(len, blocks)])
    fields = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (8 * kind.itemsize,) * n), (COMPRESSION, 3, (code,)), (PHOTOMETRIC, 3, (1,)), (BANDS, 3, (n,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,)), (TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILE_AT, 4, tuple(at[:-1].tolist())), (TILE_BYTES, 4, tuple(map(len, blocks))), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],) * n), (SCALE, 12, (1.0, 1.0, 0.0)), (TIE, 12, (0.0, 0.0, 0.0, float(origin[0]), float(origin[1]), 0.0))]
    values = [(tag, t, len(v), struct.pack(f"<{len(v)}{TYPES[t]}", *v)) for tag, t, v in fields]
    if nodata is not None:
        text = repr(float(nodata)).encode() + b"\0"
        values.append((NODATA, 2, len(text), text))
    directory = int(at[-1]) + int(at[-1]) % 2
    far, head = directory + 2 + 12 * len(values) + 4, struct.pack("<H", len(values))
    tail = b""
    for tag, t, many, data in values:
        head += struct.pack("<HHI", tag, t, many) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", far + len(tail)))
        tail += data + b"\0" * (len(data) % 2) if len(data) > 4 else b""
    return b"II*\0" + struct.pack("<I", directory) + b"".join(blocks) + b"\0" * (int(at[-1]) % 2) + head + b"\0\0\0\0" + tail


class Part(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


_SIGNS = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", EqualTo: "="}


class TiffReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int, placed: bool):
        self.path, self.range_bytes, self.placed = path, range_bytes, placed
        self.low, self.high, self.id = {"x": -math.inf, "y": -math.inf, "band": 1}, {"x": math.inf, "y": math.inf, "band": math.inf}, None

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            sign = _SIGNS.get(type(f))
            if name in self.low and sign and f.value is not None:
                if sign in (">", ">=", "="):
                    self.low[name] = max(self.low[name], f.value)
                if sign in ("<", "<=", "="):
                    self.high[name] = min(self.high[name], f.value)
            elif name == "raster_id" and sign == "=":
                self.id = f.value
            yield f  # Spark applies them again

    def partitions(self):
        from pyarrow import fs

        store, path = open_store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith((".tif", ".tiff")) and self.id in (None, _raster_id(f.path))]
        return [Part(p, n, a, min(a + self.range_bytes, n)) for p, n in sorted(files) for a in range(0, max(n, 1), self.range_bytes)]

    def read(self, part):
        store, _ = open_store(self.path)
        with store.open_input_file(part.path) as f:
            form = layout(lambda at, n: f.read_at(n, at), part.size)
            dx, dy = form.origin if self.placed else (0, 0)
            low, high = self.low, self.high
            for k, (at, n) in enumerate(zip(form.offsets, form.sizes, strict=True)):
                band, x, y = form.place(k)
                inside = x + dx <= high["x"] and x + dx + form.block[0] > low["x"] and y + dy <= high["y"] and y + dy + form.block[1] > low["y"]
                bands = 1 if form.apart else 3 if form.palette is not None else form.bands
                if not part.start <= at < part.end or not n or not inside or band + 1 > high["band"] or band + bands < low["band"]:
                    continue
                for i, a in enumerate(form.decode(k, f.read_at(n, at))):
                    if not low["band"] <= band + i + 1 <= high["band"]:
                        continue
                    yy, xx = np.indices(a.shape)
                    yy, xx, v = yy.ravel() + y + dy, xx.ravel() + x + dx, a.ravel().astype(float)
                    keep = (xx >= low["x"]) & (xx <= high["x"]) & (yy >= low["y"]) & (yy <= high["y"])
                    if self.placed and form.nodata is not None:
                        keep &= v != form.nodata
                    m = int(keep.sum())
                    yield pa.RecordBatch.from_arrays([pa.repeat(_raster_id(part.path), m), pa.array(np.full(m, band + i + 1, np.int32)), pa.array(xx[keep].astype(np.int32)), pa.array(yy[keep].astype(np.int32)), pa.array(v[keep])], schema=_ARROW)


def _raster_id(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


class TiffSource(DataSource):
    """Options: path; range_bytes (32 MB); placed (false): add the origin of the tie point to x and y, and leave out cells without data."""

    @classmethod
    def name(cls):
        return "isoline_tiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TiffReader(self.options["path"], int(self.options.get("range_bytes", 1 << 25)), self.options.get("placed", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)


def write_tiff(cells: DataFrame, folder: str, *, compression: str = "deflate", region: int = 2048, tile: int = 256, predictor: int = 1, kind: str = "f8", nodata: float = -9999.0) -> DataFrame:
    """cells (raster_id, x, y, value) as one file for each square region that has some, each written by one task. Returns path and cells of each file.

    Places without a cell, and cells without a value, hold nodata. region bounds a task: region * region values.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(frame["x"].min()), int(frame["y"].min())
        a = np.full((1, int(frame["y"].max()) - y0 + 1, int(frame["x"].max()) - x0 + 1), nodata, kind)
        a[0, frame["y"] - y0, frame["x"] - x0] = frame["value"].fillna(nodata)
        path = f"{folder}/{frame['raster_id'].iloc[0]}-{x0 // region}-{y0 // region}.tif"
        write_file(path, encode(a, compression, tile, predictor, (x0, y0), nodata))
        return pd.DataFrame({"path": [path], "cells": [len(frame)]})

    at = lambda c: F.floor(F.col(c) / region)
    return cells.select("raster_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("value").cast("double").alias("value")).groupBy("raster_id", at("x").alias("__i"), at("y").alias("__j")).applyInPandas(run, "path string, cells bigint")


def placed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of all files of a folder of write_tiff, in places of the whole raster."""
    register(spark)
    return spark.read.format("isoline_tiff").option("placed", "true").load(folder)
