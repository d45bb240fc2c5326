"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from workload.catalog import load
from workload.verify import compare, duck

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
CHECKS = load()


@pytest.fixture(scope="session")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", CHECKS)
def test_equals_sql(spark, con, name):
    run, sql = CHECKS[name]
    df = run(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan, plan
    result = compare(con, df, sql)
    assert result in ("", "equal but empty") or result.startswith("rows only"), result
