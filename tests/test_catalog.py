"""Every registered query against its DuckDB oracle on the smallest tables,
and the driver's flagship entry point."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
SF = "/root/testdata/sf0.001"

import __spark_entry__ as E  # noqa: E402
from oracle_check import key, norm  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    from faultline.sources.driver_tables import TABLES
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["repo", "path", "score", "rank"]
    assert 0 < df.count() <= 25


def test_every_query_has_an_oracle():
    from faultline.plans import catalog
    assert set(catalog.ORACLE) == set(catalog.QUERIES) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=key)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    idx = [dcols.index(c) for c in cols]
    drows = sorted((tuple(norm(r[i]) for i in idx) for r in cur.fetchall()), key=key)
    assert sorted(dcols) == cols
    assert srows == drows
