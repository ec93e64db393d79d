"""PNG files of many strips, written by many tasks and read some rows at a time."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from isoline.render import png
from isoline.sources import rasters


def test_strips_with_gaps(spark, tmp_path):
    rng = np.random.default_rng(7)
    want = {"a": np.zeros((2500, 300, 4), np.uint8), "b": np.zeros((3, 7, 4), np.uint8)}
    rows = []
    for name, a in want.items():
        h, w, _ = a.shape
        for y, x in {(h - 1, 0), (0, w - 1), *((int(rng.integers(0, h)), int(rng.integers(0, w))) for _ in range(60))}:
            if not 600 <= y < 1500:  # whole strips without a cell
                a[y, x] = rng.integers(0, 256, 4)
                rows.append((name, x, y, *map(int, a[y, x])))
    cells = spark.createDataFrame(rows, "raster_id string, x int, y int, r int, g int, b int, a int").repartition(5)
    found = {r.raster_id: (r.width, r.height) for r in png.write_png(cells, str(tmp_path)).collect()}
    assert found == {"a": (300, 2500), "b": (7, 3)}
    for name, a in want.items():
        data = (tmp_path / f"{name}.png").read_bytes()
        assert (np.moveaxis(png.decode(data), 0, 2) == a).all()
    assert data.count(b"IDAT") >= 2 and (tmp_path / "a.png").read_bytes().count(b"IDAT") > 10
    parts = list(png.blocks((tmp_path / "a.png").read_bytes(), 3000))
    assert len(parts) == 250 and all(b.shape == (4, 10, 300) for _, b in parts)
    meta = {r.raster_id: tuple(r)[1:4] for r in rasters.raster_meta(rasters.read_raster(spark, f"{tmp_path}/*.png")).collect()}
    assert meta == {"a": (4, 300, 2500), "b": (4, 7, 3)}


def test_checksum_of_two_strings():
    a, b = b"some bytes" * 9000, bytes(70_000) + b"more"
    assert png._adler(png._adler(1, zlib.adler32(a), len(a)), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
