"""Every registered query runs, has stable columns, and equals its SQL on the small tables."""

from __future__ import annotations

import os

import pandas as pd
import pytest

from fenwright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    """Rows as sorted tuples: missing values are None, whole floats are integers."""
    df = df[sorted(df.columns)].astype(object)
    one = lambda v: None if v is None or v is pd.NA or v != v else int(v) if isinstance(v, float) and v == int(v) else round(v, 6) if isinstance(v, float) else str(v)
    return sorted((tuple(str(one(v)) for v in r) for r in df.values.tolist()), key=str)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_no_cartesian_products(spark):
    for name, f in registry.queries().items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
