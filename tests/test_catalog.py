"""Every query against its oracle in DuckDB on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from evalkit.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def _plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)):
        return "None" if math.isnan(v) else f"{v:.5f}"
    if isinstance(v, (list, tuple)):
        return repr([_plain(x) for x in v])
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted([_plain(v) for v in r] for r in got.select(*cols).collect())
    b = sorted([_plain(v) for v in r] for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf, capsys):
    from pyspark.sql import functions as F

    from evalkit.plans.fixture import table

    table(spark, sf, "lineitem").where(F.col("l_quantity") > 49).groupBy("l_returnflag").count().explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
