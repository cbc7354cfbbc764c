import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corpusloom.llm.common import Scratch, connected_components
from corpusloom.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import DATA, TABLES, same

here = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@here
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    same(QUERIES[name](spark, DATA), c.execute(ORACLE_SQL[name]))


@here
def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


@here
def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA)
        assert after.columns == docs.columns, name
        assert 0.5 * before.count() <= after.count() <= before.count()
        rows = {tuple(r) for r in before.collect()}
        assert all(tuple(r) in rows for r in after.collect())
        before = after
    packed = corpus_pipeline.run(spark, DATA).select("doc_id").distinct()
    assert sorted(packed.collect()) == sorted(before.select("doc_id").distinct().collect())


@here
def test_stages_take_odd_rows(spark):
    rows = [(None, "Some plain text. It has a few words.", None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "A fine text of words. It is so.", "en", "s", 9), (3, "A fine text of words. It is so.", "en", "s", 9)]
    for extra in (rows, []):
        docs = spark.createDataFrame(extra, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, DATA).collect()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (3, 5), (5, 4), (4, 3), (200, 9)]
    edges += [(1000, i) for i in range(1001, 1200)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got[160] == 100 and got[5] == 3 and got[4] == 3 and got[200] == 9 and got[1199] == 1000 and 7 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0
