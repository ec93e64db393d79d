"""PNG images: bytes from and to arrays, and a sink that writes one file for each raster, its rows packed in strips."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoline.operators.raster import MOST_RASTERS
from isoline.sources.store import Part

#: Fixed values of the format: the signature, and channels by colour type (grey, RGB, palette, grey and alpha, RGBA).
SIGNATURE, CHANNELS = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Cells of a side of the images that a raster layer is cut into.
TILE = 256


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(pixels: np.ndarray) -> bytes:
    """Rows, columns, four channels of bytes."""
    h, w, _ = pixels.shape
    lines = np.zeros((h, 1 + 4 * w), np.uint8)  # no filter
    lines[:, 1:] = pixels.astype(np.uint8).reshape(h, 4 * w)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def _lines(packed: list, width: int, rows: int) -> Iterator[np.ndarray]:
    """The unpacked bytes of an image, some rows at a time."""
    z, held, step = zlib.decompressobj(), bytearray(), rows * width
    for body in packed:
        while len(body):
            held += z.decompress(body, step)
            body = z.unconsumed_tail
            while len(held) >= step:
                yield np.frombuffer(bytes(held[:step]), np.uint8).reshape(rows, width)
                del held[:step]
    held += z.flush()
    if len(held) % width:
        raise ValueError("the PNG file is cut short")
    for k in range(0, len(held), step):
        yield np.frombuffer(bytes(held[k : k + step]), np.uint8).reshape(-1, width)


def blocks(data: bytes, cells: int = 65_536) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, bands x rows x columns) of an 8-bit image that is not interlaced, some rows at a time; palettes are resolved."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG file")
    view, at, packed, palette, head = memoryview(data), 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = view[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    w, h, depth, color, _, _, interlaced = head
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG files without interlacing are supported")
    n = CHANNELS[color]
    above, start = np.zeros((w, n), np.int64), 0
    for lines in _lines(packed, 1 + w * n, max(1, cells // w)):
        out = np.empty((len(lines), w, n), np.uint8)
        if not lines[:, 0].any():  # no filter in any row
            out[:] = lines[:, 1:].reshape(out.shape)
            above = out[-1].astype(np.int64)
        else:
            for y, line in enumerate(lines):
                out[y] = above = _unfiltered(line[0], line[1:].reshape(w, n).astype(np.int64), above)
        yield start, np.moveaxis(palette[out[:, :, 0]] if color == 3 else out, 2, 0)
        start += len(lines)
    if start != h:
        raise ValueError("the PNG file is cut short")


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A row (columns, channels) without its filter."""
    if kind == 1:
        return np.cumsum(row, axis=0) & 255
    if kind == 2:
        return row + above & 255
    if kind in (3, 4):
        left, corner = np.zeros(row.shape[1], np.int64), np.zeros(row.shape[1], np.int64)
        for x in range(len(row)):
            if kind == 3:
                guess = (left + above[x]) >> 1
            else:
                p = left + above[x] - corner
                a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
            left, corner = row[x] + guess & 255, above[x]
            row[x] = left
    return row


def decode(data: bytes) -> np.ndarray:
    """Bands, rows, columns of a whole image (see `blocks`)."""
    return np.concatenate([b for _, b in blocks(data)], axis=1)


def _image(frame: pd.DataFrame, x0: int = 0, y0: int = 0) -> np.ndarray:
    x, y = frame["x"].to_numpy() - x0, frame["y"].to_numpy() - y0
    a = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 4), np.uint8)
    a[y, x] = frame[["r", "g", "b", "a"]].to_numpy()
    return a


#: Cells of the strips that an image's rows are packed in.
STRIP = 65_536
_ADLER = 65521


def _adler(one: int, two: int, size: int) -> int:
    """The checksum of two byte strings, one after the other, from theirs and the size of the second."""
    a, b = one & 0xFFFF, one >> 16
    c, d = two & 0xFFFF, two >> 16
    return (d + b + size * (a - 1)) % _ADLER << 16 | (a + c - 1) % _ADLER


def write_png(cells: DataFrame, folder: str) -> DataFrame:
    """cells (raster_id, x, y, r, g, b, a; channels 0 .. 255): a file raster_id.png for each raster. Returns (raster_id, path, width, height). Missing cells are transparent.

    Strips of rows are packed by tasks of their own; a file is put together by one task that holds some packed strips at a time.
    """
    some = cells.select(F.col("raster_id").cast("string").alias("raster_id"), "x", "y", "r", "g", "b", "a")
    sizes = some.groupBy(F.col("raster_id").alias("__id")).agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    found = sizes.take(MOST_RASTERS + 1)
    if len(found) <= MOST_RASTERS:
        sizes = F.broadcast(cells.sparkSession.createDataFrame(found, sizes.schema))
    rows = F.greatest(F.lit(1), F.floor(F.lit(STRIP) / F.col("width")))
    dealt = some.join(sizes, F.col("raster_id").eqNullSafe(F.col("__id"))).withColumn("strip", F.floor(F.col("y") / rows).cast("int")).drop("__id")

    def shrunk(raw: bytes, last: bool) -> bytes:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        return z.compress(raw) + z.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)

    def pack(cells: pa.Table) -> pa.Table:
        w, h, k = (cells.column(n)[0].as_py() for n in ("width", "height", "strip"))
        rows = max(1, STRIP // w)
        n = min(rows, h - k * rows)
        at = cells.column("y").to_numpy() - k * rows, cells.column("x").to_numpy()
        lines = np.zeros((n, 1 + 4 * w), np.uint8)  # no filter
        for c, name in enumerate("rgba"):
            lines[:, 1 + c :: 4][at] = cells.column(name).fill_null(0).to_numpy().astype(np.int64)
        raw = lines.tobytes()
        values = cells.column("raster_id")[0].as_py(), w, h, k, len(raw), zlib.adler32(raw), shrunk(raw, (k + 1) * rows >= h)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, packed, strict=True)], schema=packed)

    packed = pa.schema([("raster_id", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("strip", pa.int32()), ("size", pa.int64()), ("adler", pa.int64()), ("body", pa.binary())])
    strips = dealt.groupBy("raster_id", "strip").applyInArrow(pack, "raster_id string, width int, height int, strip int, size bigint, adler bigint, body binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for k in range(batch.num_rows):
                raster, w, h, strip, size, adler, body = (batch.column(c)[k].as_py() for c in range(7))
                rows = max(1, STRIP // w)
                if out is None:
                    path = f"{folder}/{raster}.png"
                    out, sums, at = Part(path), 1, 0
                    out.write(SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", b"\x78\x9c"))
                while at < strip:  # strips without a cell
                    empty = bytes(rows * (1 + 4 * w))
                    out.write(_chunk(b"IDAT", shrunk(empty, False)))
                    sums, at = _adler(sums, zlib.adler32(empty), len(empty)), at + 1
                sums, at = _adler(sums, adler, size), at + 1
                last = at * rows >= h
                out.write(_chunk(b"IDAT", body + struct.pack(">I", sums) if last else body))
                if last:
                    out.write(_chunk(b"IEND", b""))
                    out.done()
                    out = None
                    yield pa.RecordBatch.from_pydict({"raster_id": [raster], "path": [path], "width": pa.array([w], pa.int32()), "height": pa.array([h], pa.int32())})

    return strips.repartition("raster_id").sortWithinPartitions("raster_id", "strip").mapInArrow(join, "raster_id string, path string, width int, height int")


def image_tiles(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(raster_id, x, y, width, height, href): PNG data addresses of square tiles, each a task's array of bounded size."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(frame["tx"].iloc[0]) * tile, int(frame["ty"].iloc[0]) * tile
        a = _image(frame, x0, y0)
        href = "data:image/png;base64," + base64.b64encode(encode(a)).decode()
        return pd.DataFrame({"raster_id": [frame["raster_id"].iloc[0]], "x": [x0], "y": [y0], "width": [a.shape[1]], "height": [a.shape[0]], "href": [href]})

    some = cells.select(F.col("raster_id").cast("string").alias("raster_id"), "x", "y", "r", "g", "b", "a", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    return some.groupBy("raster_id", "tx", "ty").applyInPandas(run, "raster_id string, x int, y int, width int, height int, href string")
