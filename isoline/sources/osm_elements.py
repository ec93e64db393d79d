"""OSM XML files in one scan: spark.read.format("isoline_osm").load(path) gives every node, way and relation as a row.

Files are split into byte ranges; a range has the elements that start in it, so one large file is the work of many tasks and each byte is parsed once.
Comparisons of kind, id, x and y with constants are pushed to the reader (a way or relation has no x and y). Files are UTF-8, as the format's tools write
them; comments that hold whole elements are not told apart from elements.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from isoline.sources.datasource import _SIGNS, Range
from isoline.sources.store import open_store

_POINT = "struct<x:double,y:double>"
SCHEMA = f"kind string, id bigint, x double, y double, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string,nd:array<{_POINT}>>>, tags array<struct<key:string,value:string>>"
_NODES = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
_ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("x", pa.float64()), ("y", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string()), ("nd", _NODES)]))), ("tags", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])))])

#: The start tag of an element, with its attributes, and whether it ends there.
_START = re.compile(rb"""<(node|way|relation)((?:\s+[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)\s*(/?)>""")
_BEGIN = re.compile(rb"<(?:node|way|relation)[\s/>]")
AHEAD, ELEMENTS = 1 << 20, 4096


def _number(e: ET.Element, name: str, of):
    v = e.get(name)
    return None if v is None else of(v)


def element(e: ET.Element) -> dict:
    kind = e.tag
    return {
        "kind": kind, "id": _number(e, "id", int), "x": _number(e, "lon", float), "y": _number(e, "lat", float),
        "refs": [_number(n, "ref", int) for n in e.findall("nd")] if kind == "way" else None,
        "members": [{"type": m.get("type"), "ref": _number(m, "ref", int), "role": m.get("role"), "nd": [{"x": _number(n, "lon", float), "y": _number(n, "lat", float)} for n in m.findall("nd")]} for m in e.findall("member")] if kind == "relation" else None,
        "tags": [{"key": t.get("k"), "value": t.get("v")} for t in e.findall("tag")],
    }


def elements_of(read, size: int, start: int, end: int):
    """The XML text of each element that starts in [start, end); read(offset, n) -> bytes."""
    data, base = read(start, min(size, end + 32) - start), start

    def more() -> bool:
        nonlocal data
        if base + len(data) >= size:
            return False
        data += read(base + len(data), AHEAD)
        return True

    at = 0
    while True:
        m = _BEGIN.search(data, at)
        if not m or base + m.start() >= end:
            return
        tag = _START.match(data, m.start())
        while not tag:
            if not more():
                raise ValueError(f"damaged element at byte {base + m.start()}")
            tag = _START.match(data, m.start())
        stop = tag.end()
        if not tag[3]:
            close = b"</" + tag[1] + b">"
            found = data.find(close, stop)
            while found < 0:
                known = len(data)
                if not more():
                    raise ValueError(f"element without end at byte {base + m.start()}")
                found = data.find(close, max(stop, known - len(close)))
            stop = found + len(close)
        yield data[m.start() : stop]
        at = stop


class OsmReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes, self.checks = path, range_bytes, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in _SIGNS and name in ("kind", "id", "x", "y") and f.value is not None:
                self.checks.append((name, type(f), f.value))
            yield f  # Spark applies them again

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = open_store(self.path)
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
        return [Range(p, a, min(a + self.range_bytes, size)) for p, size in files for a in range(0, size, self.range_bytes)]

    def read(self, part):
        store, _ = open_store(self.path)
        checks, held = [(n, _SIGNS[kind], v) for n, kind, v in self.checks], []
        only = {v.encode() for n, kind, v in self.checks if n == "kind" and kind.__name__ == "EqualTo"}

        def rows():
            parsed = (element(e) for e in ET.fromstring(b"<r>" + b"".join(held) + b"</r>"))
            kept = [r for r in parsed if all(r[n] is not None and ok(r[n], v) for n, ok, v in checks)]
            return pa.RecordBatch.from_pylist(kept, schema=_ARROW)

        with store.open_input_file(part.path) as f:
            size = f.size()
            head = re.match(rb"""\s*<\?xml[^>]*encoding\s*=\s*["']([^"']+)""", f.read_at(min(size, 200), 0))
            if head and head[1].lower() not in (b"utf-8", b"us-ascii", b"ascii"):
                raise ValueError(f"OSM files in {head[1].decode()} are not supported")
            for text in elements_of(lambda at, n: f.read_at(n, at), size, part.start, part.end):
                if only and not any(text.startswith(b"<" + k) for k in only):
                    continue
                held.append(text)
                if len(held) >= ELEMENTS:
                    yield rows()
                    held.clear()
            if held:
                yield rows()


class OsmSource(DataSource):
    """Options: path; range_bytes (32 MB)."""

    @classmethod
    def name(cls):
        return "isoline_osm"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return OsmReader(self.options["path"], int(self.options.get("range_bytes", 1 << 25)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OsmSource)
