"""Every registered query next to its SQL, and what no plan may hold."""

import os
import re

import pytest

from scorewell.catalog import all_queries, all_sql
from tests.compare import difference, duck

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SLOW = {"auto_train", "fraud_train", "leaderboard", "complexity_probe"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", [n for n in all_queries() if n not in SLOW])
def test_query(spark, con, name):
    df = all_queries()[name](spark, SF_DIR)
    sql = all_sql().get(name)
    if sql is None:
        assert df.collect()
    else:
        assert difference(df, con, sql) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", sorted(SLOW - {"auto_train"}))
def test_training_query(spark, name):
    assert all_queries()[name](spark, SF_DIR).collect()


def test_every_sql_belongs_to_a_query():
    assert set(all_sql()) <= set(all_queries())
