"""Every registered query against its SQL counterpart on the smallest test tables."""

import pytest
from pyspark.sql import types as T

from __spark_entry__ import entry
from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


WIDTHS = {
    "report_single_chain_base": 13,
    "report_all_chains": 21,
    "report_ranges": 2,
    "report_chain_totals": 25,
    "report_thresholds": 37,
    "report_top_delegates": 21,
    "report_holders": 10,
}
BANNED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, con, ORACLE[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in BANNED if op in plan]
    assert not any(isinstance(f.dataType, (T.NullType, T.BinaryType)) for f in df.schema.fields)
    assert len(df.columns) == WIDTHS.get(name, len(df.columns))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:2] == ["rank", "blockchain"]
    assert df.count() == 516
