"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from frostline.plans import catalog
from frostline.sources.tables import DRIVER_TABLES

from conftest import SMALL

catalog.load_all()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)),
                  key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got) == _rows(want)


def test_every_query_has_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
