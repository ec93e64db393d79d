"""Transverse Mercator and the datum shift on published examples."""

import pytest
from pyspark.sql import functions as F

from isoline.functions import crs, transverse, wkt


def at(spark, f, x, y):
    out = f(F.lit(float(x)), F.lit(float(y)))
    a, b = out if isinstance(out, tuple) else (out["x"], out["y"])
    return tuple(spark.range(1).select(a, b).first())


def test_british_example(spark):
    """The Ordnance Survey's worked example: Caister water tower on the British datum."""
    grid = transverse.TransverseMercator(-2.0, 49.0, 0.9996012717, 400_000.0, -100_000.0, transverse.AIRY)
    lon, lat = 1 + 43 / 60 + 4.5177 / 3600, 52 + 39 / 60 + 27.2531 / 3600
    assert at(spark, grid.forward, lon, lat) == pytest.approx((651409.903, 313177.270), abs=2e-3)
    assert at(spark, grid.back, 651409.903, 313177.270) == pytest.approx((lon, lat), abs=1e-7)


def test_zones(spark):
    north = lambda x, y: crs.transform_xy(x, y, 4326, 32633)
    assert at(spark, north, 15, 0) == pytest.approx((500_000, 0), abs=1e-6)
    assert at(spark, north, 15, 45) == pytest.approx((500_000, 4982950.400), abs=1e-3)  # the meridian's arc of 45 degrees is 4984944.378 m
    east, up = at(spark, north, 18, 60)
    west, same = at(spark, north, 12, 60)
    assert east - 500_000 == pytest.approx(500_000 - west) and up == pytest.approx(same)
    south = at(spark, lambda x, y: crs.transform_xy(x, y, 4326, 32733), 15, -45)
    assert south == pytest.approx((500_000, 10_000_000 - 4982950.400), abs=1e-3)
    assert at(spark, lambda x, y: crs.transform_xy(x, y, 32633, 32634), 500_000, 5e6)[0] < 100_000  # zone to zone
    assert at(spark, lambda x, y: crs.transform_xy(*crs.transform_xy(x, y, 4326, 3857), 3857, 32633), 15, 45) == pytest.approx((500_000, 4982950.400), abs=1e-3)


def test_shift(spark):
    """From WGS 84 to the British datum and back: some hundred metres, within centimetres of where it began."""
    there = lambda x, y: transverse.shifted(x, y, transverse.WGS84, transverse.AIRY, transverse.TO_OSGB36)
    lon, lat = at(spark, there, -2.0, 53.0)
    assert 1e-4 < abs(lon + 2) < 3e-3 and 1e-4 < abs(lat - 53) < 3e-3
    again = at(spark, lambda x, y: transverse.then(there(x, y), lambda u, v: transverse.shifted(u, v, transverse.AIRY, transverse.WGS84, transverse.TO_OSGB36, back=True)), -2.0, 53.0)
    assert again == pytest.approx((-2.0, 53.0), abs=1e-6)
    assert at(spark, lambda x, y: transverse.shifted(x, y, transverse.WGS84, transverse.WGS84, (0,) * 7), 31.5, -64.25) == pytest.approx((31.5, -64.25), abs=1e-11)


def test_names():
    assert crs.srid("EPSG:32601") == 32601 and crs.srid("WGS 84 / UTM zone 1N") == 32601 and crs.KNOWN[32601][1] == (-180, -174, 0, 84)
    for k in (32633, 32760, 27700):
        assert wkt.srid_of(wkt.to_wkt(k)) == k and crs.srid(f"EPSG:{k}") == k
    assert wkt.from_wkt('PROJCS["WGS_1984_UTM_Zone_12S",GEOGCS["GCS_WGS_1984"]]') == 32712
    assert wkt.from_wkt('PROJCS["British_National_Grid",GEOGCS["GCS_OSGB_1936"]]') == 27700
    for bad in ("EPSG:32661", "EPSG:32600", "EPSG:1"):
        with pytest.raises(ValueError):
            crs.srid(bad)
