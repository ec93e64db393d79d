"""Every query of the map engine against its SQL in DuckDB, and exact values of single functions."""

import glob
import math
import os

import duckdb
import pytest

from isoline.functions.tags import overpass_ql
from isoline.operators.raster import gaussian_kernel
from isoline.plans import registry

DATA = "/root/testdata/sf0.001"


def canon(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(round(v, 9) + 0.0 if isinstance(v, float) else v for v in row) for row in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    assert canon(registry.queries()[name](spark, DATA).toPandas()) == canon(c.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_query_text():
    assert overpass_ql("node", [[("highway", "bus_stop")]], take=100) == '[out:xml];\nnode["highway"="bus_stop"];\nout body 100;'
    assert overpass_ql("nwr", [[("natural", "wetland")]], (10.7, 10.8, 59.9, 60.0)) == '[out:xml];\nnwr["natural"="wetland"](59.9,10.7,60,10.8);\nout body;'
    assert overpass_ql("node", [[("highway", "bus_stop"), ("shelter", "no", "!=")]]) == '[out:xml];\nnode["highway"="bus_stop"]["shelter"!="no"];\nout body;'
    assert overpass_ql("way", [[("natural", "coastline")]], timeout=3600) == '[out:xml][timeout:3600];\nway["natural"="coastline"];\nout body;'


def test_kernel():
    for r in (0.5, 1, 2, 5, 20):
        k = gaussian_kernel(r)
        assert len(k) % 2 == 1 and math.isclose(sum(k), 1)
    with pytest.raises(ValueError):
        gaussian_kernel(-1)
