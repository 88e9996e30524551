"""Every registered query against its DuckDB twin on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import arrow_types, compare, duck  # noqa: E402

from stocklens.plans.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF).toPandas()
    sql = ORACLE.get(name)
    if sql is None:
        assert len(sdf.columns) > 0
        return
    res = compare(sdf, con.execute(sql).df())
    assert res == "OK", res
    assert arrow_types(QUERIES[name](spark, SF), con, sql) == {}
