"""Plan properties that matter at scale: pruning, pushdown, no Python on the hot path,
partial top-k before the shuffle."""

import pytest

import __spark_entry__ as E
from stocklens.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    p = plan(QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p


def test_column_pruning(spark):
    p = plan(QUERIES["product_flow"](spark, SF))
    # lineitem is read with only the columns the query needs
    assert "l_comment" not in p and "l_tax" not in p and "l_discount" not in p


def test_topk_partial_limit(spark):
    df = QUERIES["top_products"](spark, SF)
    assert "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString() or \
        "WindowGroupLimit" in plan(df)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
