"""Files and ranges of files do not grow in number or size with the data beyond what a task should do."""

import os

from isoline.plans import files
from isoline.sources import datasource


def test_ranges_are_no_more_than_a_job_needs(tmp_path):
    p = tmp_path / "a.geojson"
    p.write_bytes(b"{}\n" * 700_000)
    ranges = datasource.GeoJsonReader(str(p), 1000).partitions()
    assert len(ranges) <= datasource.MOST
    assert ranges[0].start == 0 and ranges[-1].end == 2_100_000 and all(a.end == b.start for a, b in zip(ranges, ranges[1:]))
    small = tmp_path / "b.geojson"
    small.write_bytes(b"{}\n" * 1000)
    assert len(datasource.GeoJsonReader(str(small), 1000).partitions()) == 3


def test_shapefiles_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SHAPES", 20)
    monkeypatch.setattr(files, "shared_folder", lambda spark: str(tmp_path / "shapes"))
    assert files.shapefile_round_trip(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    shp = [f for f in (tmp_path / "shapes").iterdir() if f.name.endswith(".shp")]
    assert len(shp) > 7 and all(os.path.getsize(f) <= 100 + 28 * 20 for f in shp)
