"""Every query of the catalogue with SQL against that SQL, over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from featherloom.plans import catalogue
from featherloom.session import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, order):
    return sorted(tuple(round(v, 5) if isinstance(v, float) else None if v is None else str(v) for v in (r[i] for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    found = got.collect()
    assert found and len(set(got.columns)) == len(got.columns)
    if sql := catalogue.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(got.columns)
        order = [list(want.columns).index(c) for c in got.columns]
        assert [str(x) for x in rows(found, range(len(order)))] == [str(x) for x in rows(want.fetchall(), order)]


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
