"""Every registered query of the engine runs, and equals its SQL counterpart in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tests.conftest import SF
from weirstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return v


def result(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert result(df.columns, rows) == result(want.columns, want.fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
