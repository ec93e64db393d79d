"""GeoJSON lines as a Spark data source: spark.read.format("isoline_geojson").load(path).

Files are split into byte ranges of whole lines. Comparisons of xmin, xmax, ymin, ymax and
geom_type with constants are pushed to the reader, so features outside a box are dropped before they reach Spark; Spark applies all filters again.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from isoline.sources.store import open_store

SCHEMA = "feature_id bigint, geom_type string, parts array<array<struct<x:double,y:double>>>, tags array<struct<key:string,value:string>>, xmin double, xmax double, ymin double, ymax double"
_ARROW = pa.schema([("feature_id", pa.int64()), ("geom_type", pa.string()), ("parts", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))), ("tags", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), *((n, pa.float64()) for n in ("xmin", "xmax", "ymin", "ymax"))])
#: Nesting of coordinates above single points, by kind.
_DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
_NAMES = {"Point": "point", "MultiPoint": "multipoint", "LineString": "line", "MultiLineString": "multiline"}
_SIGNS = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, EqualTo: lambda a, b: a == b}


#: Ranges that files are split into: more, only if they would be longer than LONGEST bytes.
MOST, LONGEST = 256, 1 << 25


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":")) if isinstance(v, (dict, list)) else str(v)


def _geometries(g: dict | None) -> Iterator[tuple[str, list]]:
    """(kind, parts) of a geometry; members of a collection and polygons of a MultiPolygon one by one."""
    if not g:
        return
    kind, c = g.get("type"), g.get("coordinates")
    if kind == "GeometryCollection":
        for m in g.get("geometries", ()):
            yield from _geometries(m)
    elif kind in _DEPTH and c:
        parts = [[c]] if kind == "Point" else [[p] for p in c] if kind == "MultiPoint" else [c] if kind == "LineString" else c
        for p in parts if kind == "MultiPolygon" else [parts]:
            yield _NAMES.get(kind, "polygon" if len(p) == 1 else "multipolygon"), p


class GeoJsonReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes, self.checks = path, range_bytes, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in _SIGNS and name in ("xmin", "xmax", "ymin", "ymax", "geom_type") and f.value is not None:
                self.checks.append((name, type(f), f.value))
            yield f  # Spark applies them again

    def partitions(self):
        from pyarrow import fs

        store, path = open_store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        step = max(self.range_bytes, min(LONGEST, -(-sum(size for _, size in files) // MOST)))
        return [Range(p, a, min(a + step, size)) for p, size in files for a in range(0, size, step)]

    def read(self, part):
        store, _ = open_store(self.path)
        out: dict = {n: [] for n in _ARROW.names}
        checks = [(n, _SIGNS[kind], v) for n, kind, v in self.checks]
        with store.open_input_file(part.path) as raw, io.BufferedReader(raw, 1 << 20) as f:
            f.seek(max(0, part.start - 1))
            at = max(0, part.start - 1)
            if part.start:
                at += len(f.readline())  # the line that the range before this one ends with
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                here, at = at, at + len(line)
                if not line.strip():
                    continue
                feature = json.loads(line)
                tags = [{"key": k, "value": _text(v)} for k, v in (feature.get("properties") or {}).items()]
                for kind, parts in _geometries(feature.get("geometry")):
                    xs, ys = [p[0] for c in parts for p in c], [p[1] for c in parts for p in c]
                    row = {"feature_id": here, "geom_type": kind, "xmin": float(min(xs)), "xmax": float(max(xs)), "ymin": float(min(ys)), "ymax": float(max(ys))}
                    if all(ok(row[n], v) for n, ok, v in checks):
                        row |= {"parts": [[{"x": float(p[0]), "y": float(p[1])} for p in c] for c in parts], "tags": tags}
                        for n, v in row.items():
                            out[n].append(v)
                if len(out["feature_id"]) >= 4096:
                    yield pa.RecordBatch.from_pydict(out, schema=_ARROW)
                    out = {n: [] for n in _ARROW.names}
        if out["feature_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=_ARROW)


class GeoJsonSource(DataSource):
    """Options: path; range_bytes (32 MB): the shortest range, as each is a task; ranges get longer where there would be more than MOST. feature_id is the byte place of the feature's line in its file."""

    @classmethod
    def name(cls):
        return "isoline_geojson"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GeoJsonReader(self.options["path"], int(self.options.get("range_bytes", 1 << 25)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoJsonSource)
