"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexground.plans import evaluation, examples, models, reports, retrieval, sources, text, timeline

PLANS = [sources, text, examples, timeline, models, evaluation, retrieval, reports]
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    """Rows with doubles to nine digits, and no negative zero."""
    return sorted(repr(tuple(round(x, 9) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)


SQL = {n: s for p in PLANS for n, s in p.SQL.items()}
#: A third of the queries; the whole set is compared by the driver.
CHOSEN = sorted(SQL)[::3]


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, duck, name):
    out = entry.queries()[name](spark, SF)
    rel = duck.sql(SQL[name])
    names = sorted(rel.columns)
    assert sorted(out.columns) == names
    at = [rel.columns.index(n) for n in names]
    assert plain(map(tuple, out.select(*names).collect())) == plain(tuple(r[i] for i in at) for r in rel.fetchall())


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert len({n for p in PLANS for n in p.QUERIES}) == sum(len(p.QUERIES) for p in PLANS)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and 0 < rows[0].recall <= 1
