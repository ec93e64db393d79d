"""Shapefiles: .shp and .dbf files are read as binary by Spark (from any store), paired by name, and parsed a pair a task."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoline.sources.features import POINTS, TAGS, finish

#: Fixed values of the format: shape types (those with heights or measures carry the plain kind's fields first).
POINT, LINE, POLYGON, MULTIPOINT = {1, 11, 21}, {3, 13, 23}, {5, 15, 25}, {8, 18, 28}
CHUNK = 2000


def dbf_rows(data: bytes, encoding: str = "utf-8") -> Iterator[list[tuple[str, str | None]] | None]:
    """Name and text of each record's fields; blank fields are null, deleted records are None."""
    count, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < head - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding, "replace"), data[at + 16], chr(data[at + 11])))
        at += 32
    for k in range(count):
        row = data[head + k * width : head + (k + 1) * width]
        if row[:1] == b"*":
            yield None
            continue
        out, at = [], 1
        for name, size, kind in fields:
            text = row[at : at + size].decode(encoding, "replace").strip(" \0")
            if kind == "D" and len(text) == 8:
                text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
            out.append((name, text or None))
            at += size
        yield out


def shapes(data: bytes) -> Iterator[tuple[str, list[np.ndarray]] | None]:
    """Kind and parts of each record; null shapes are None."""
    at = 100
    while at + 12 <= len(data):
        body = at + 8
        kind = struct.unpack_from("<i", data, body)[0]
        at = body + 2 * struct.unpack_from(">i", data, at + 4)[0]
        if kind == 0:
            yield None
        elif kind in POINT:
            yield "point", [np.frombuffer(data, "<f8", 2, body + 4).reshape(1, 2)]
        elif kind in MULTIPOINT:
            n = struct.unpack_from("<i", data, body + 36)[0]
            yield "multipoint", list(np.frombuffer(data, "<f8", 2 * n, body + 40).reshape(n, 1, 2))
        elif kind in LINE | POLYGON:
            parts, n = struct.unpack_from("<ii", data, body + 36)
            first = [*np.frombuffer(data, "<i4", parts, body + 44).tolist(), n]
            xy = np.frombuffer(data, "<f8", 2 * n, body + 44 + 4 * parts).reshape(n, 2)
            rings = [xy[i:j] for i, j in zip(first, first[1:])]
            if kind in POLYGON:  # the format winds outer rings clockwise
                yield ("polygon" if parts == 1 else "multipolygon"), [r[::-1] for r in rings]
            else:
                yield ("line" if parts == 1 else "multiline"), rings
        else:
            raise ValueError(f"shape type {kind} is not supported")


def read_shapefile(spark: SparkSession, path: str, srid: int = 4326, encoding: str = "utf-8") -> DataFrame:
    """path: a folder or pattern that holds .shp files and, beside them, .dbf files; without one, features have no tags. Records of one file stay in one task."""
    both = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(shp|dbf)$")).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("base"), F.lower(F.right("path", F.lit(3))).alias("ext"), "content")
    pair = both.where("ext = 'shp'").select("base", F.col("content").alias("shp")).join(both.where("ext = 'dbf'").select("base", F.col("content").alias("dbf")), "base", "left")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shp, dbf in zip(frame["shp"], frame["dbf"], strict=True):
                fields = dbf_rows(dbf, encoding) if isinstance(dbf, (bytes, bytearray)) else None
                rows = []
                for k, found in enumerate(shapes(bytes(shp))):
                    tags = [] if fields is None else next(fields, [])
                    if found is not None and tags is not None:
                        kind, parts = found
                        rows.append((k, kind, [p[:, 0].tolist() for p in parts], [p[:, 1].tolist() for p in parts], [a for a, _ in tags], [b for _, b in tags]))
                    if len(rows) == CHUNK:
                        yield pd.DataFrame(rows, columns=["feature_id", "geom_type", "xs", "ys", "keys", "vals"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["feature_id", "geom_type", "xs", "ys", "keys", "vals"])

    flat = pair.select("shp", "dbf").mapInPandas(parse, "feature_id long, geom_type string, xs array<array<double>>, ys array<array<double>>, keys array<string>, vals array<string>")
    parts = F.zip_with("xs", "ys", lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))).cast(f"array<{POINTS}>")
    tags = F.zip_with("keys", "vals", lambda k, v: F.struct(k.alias("key"), v.alias("value"))).cast(TAGS)
    return finish(flat.select("feature_id", "geom_type", parts.alias("parts"), tags.alias("tags")), srid)
