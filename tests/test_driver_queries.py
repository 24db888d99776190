"""Driver queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from netaudit import driver_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return str(v if not isinstance(v, float) else "nan" if math.isnan(v) else round(v, 6) + 0.0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(driver_queries.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = driver_queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(driver_queries.ORACLE[name])
    assert columns == sorted(want.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["rule_id", "object_id", "severity", "problem_category", "passed"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
