import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tagtide import build_session

    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tagtide-checkpoints-"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="tagtide-warehouse-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tagtide-test-")


@pytest.fixture
def one(spark):
    """Evaluates column expressions over one row of named values."""

    def evaluate(expr, schema="x STRING", *values):
        return spark.createDataFrame([tuple(values)], schema).select(expr.alias("v")).first()["v"]

    return evaluate
