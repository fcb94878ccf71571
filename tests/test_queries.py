"""Every query over the driver's smallest tables against its SQL."""

import os

import pytest

from compare import connect, differ
from graphtables import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert differ(spark, con, name, queries.QUERIES[name], queries.ORACLE_SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_personalized_pagerank_takes_all_customers(spark, con):
    seeds = {r.seed for r in queries.QUERIES["personalized_pagerank"](spark, FOLDER).select("seed").distinct().collect()}
    assert seeds == {x for (x,) in con.execute("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)").fetchall()}


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
