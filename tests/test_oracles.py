"""Every query with a DuckDB counterpart against it, on the smallest tables."""

import math
import os

import duckdb
import pytest

from sextant import catalogue
from sextant.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        return repr(round(float(v), 5))

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    mine = [tuple(r) for r in df.collect()]
    other = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in other.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(mine, df.columns) == plain(other.fetchall(), names)


@pytest.mark.skipif(not os.path.exists(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_queries_without_sql_have_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
