"""Every query with SQL against DuckDB, over the smallest tables."""

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from corpusloom.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(norm, x))
    if isinstance(x, bool) or x is None or isinstance(x, (int, float)):
        return x
    return str(x)


def same(df, cursor):
    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = Counter(tuple(norm(r[i]) for i in at) for r in cursor.fetchall())
    assert Counter(tuple(norm(v) for v in r) for r in df.select(*columns).collect()) == expected


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, DATA), duck.execute(ORACLE_SQL[name]))


def test_filters_reach_the_scan(spark):
    plan = QUERIES["existing_ids"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src1)]" in plan
