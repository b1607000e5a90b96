"""Every registered query of the library against its DuckDB statement, on the smallest tables."""

import math
import os

import pytest

from ledgerlark.plans import catalog

TABLES = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")


@pytest.fixture(scope="module")
def base():
    made = duckdb.connect()
    for file in os.listdir(TABLES):
        made.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{TABLES}/{file}'")
    return made


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "hour") else value.isoformat()
    return value


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, base, name):
    want = base.sql(catalog.ORACLES[name])
    found = catalog.QUERIES[name](spark, TABLES)
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    got = sorted(repr([plain(v) for v in r]) for r in found.select(*columns).collect())
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in place]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, TABLES).count() > 0


def test_flagship_and_entry(spark):
    import __spark_entry__

    assert catalog.FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
