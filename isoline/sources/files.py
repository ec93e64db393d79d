"""Vector files by extension."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from isoline.functions.wkt import read_prj
from isoline.sources.geojson import read_geojson
from isoline.sources.kml import read_kml
from isoline.sources.osm import read_osm
from isoline.sources.shapefile import read_shapefile
from isoline.sources.store import existing, open_store, shared_folder, write_file  # noqa: F401  (also known from here)


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    kind = os.path.splitext(path)[1].lower()
    if kind == ".shp":
        base, (folder, _, name) = os.path.splitext(path)[0], os.path.splitext(path)[0].rpartition("/")
        srid = read_prj(spark, f"{base}.prj") if f"{name}.prj" in existing(spark, folder or ".") else 4326
        return read_shapefile(spark, f"{base}.*", srid)
    readers = {".osm": read_osm, ".geojson": read_geojson, ".json": read_geojson, ".kml": read_kml}
    if kind not in readers:
        raise ValueError(f"vector files of kind {kind} are not supported")
    return readers[kind](spark, path)
