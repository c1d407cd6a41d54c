"""Driver contract and oracle parity at sf0.001 (the driver checks sf0.01)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import _digest  # noqa: E402
from panelcast.plans import all_queries  # noqa: E402
from panelcast.sources.tables import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = all_queries.ORACLE


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"store", "item", "date", "sales", "sales_lag_7", "sales_roll_std_28d", "is_holiday"} <= set(df.columns)


def test_registry_shape():
    q = entry.queries()
    assert set(SQL) <= set(q)
    assert len(all_queries.QUERIES) >= 80
    assert set(entry.oracle_sql()) <= set(q)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle_parity(spark, duck, name):
    sdf = entry.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    hs, ls = _digest(sdf.columns, srows)
    hd, ld = _digest(dcols, drows)
    assert hs == hd, sorted(set(ls) ^ set(ld))[:3]
