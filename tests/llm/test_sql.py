"""Every query of this subpackage that has DuckDB SQL against it, on both of the smaller sets of tables."""

import os

import pytest

from ledgerlark.llm import catalog
from tests.test_queries import plain

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    base = duckdb.connect()
    for file in os.listdir(folder):
        base.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{folder}/{file}'")
    want = base.sql(catalog.ORACLES[name])
    columns = sorted(want.columns)
    found = catalog.QUERIES[name](spark, folder)
    assert sorted(found.columns) == columns
    place = [want.columns.index(c) for c in columns]
    got = sorted(repr([plain(v) for v in r]) for r in found.select(*columns).collect())
    assert got == sorted(repr([plain(r[i]) for i in place]) for r in want.fetchall())
