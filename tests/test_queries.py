"""Every query against its SQL over the smallest tables."""

import os

import duckdb
import pytest

from statuta.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(registry.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    from statuta.operators import conversation, retrieval, vector
    from statuta.sources import tables

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = vector.top_k(retrieval.law_candidates(tables.law_articles(spark, DATA)), [0.1] * 64, 10)
    assert "TakeOrderedAndProject" in plan(found) and "ReadSchema" in plan(found)
    assert "WindowGroupLimit" in plan(conversation.last_messages(tables.chat_logs(spark, DATA)))
