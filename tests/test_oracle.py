"""Every registered query against its DuckDB oracle (what the driver checks)."""

import os

import duckdb
import pytest

from tools.compare import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def _names():
    from sheetmerge.plans import catalog

    return sorted(catalog.QUERIES)


def test_every_query_has_an_oracle():
    from __spark_entry__ import oracle_sql, queries
    from sheetmerge.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert len(catalog.QUERIES) >= 37
    assert set(catalog.QUERIES) <= set(queries()) and set(catalog.ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(oracle_sql()[name])
    dcols, drows = [d[0] for d in res.description], res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(cols, rows) == digest(dcols, drows)


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["表名", "name", "nationkey", "acctbal", "mktsegment"]
    assert df.count() > 0
