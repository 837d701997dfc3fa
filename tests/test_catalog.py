"""Every registered query of the library against its SQL, over the smallest tables."""

import math
import os

import pytest

from gridwright.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables of the smallest scale aren't here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in catalog.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(round(v, 6) + 0.0)
    return str(v)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in want)
    spark.catalog.clearCache()
