"""Registered checks: name, Spark plan, and the SQL it has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

CHECKS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def check(name: str, sql: str | None = None):
    """Registers a function of (spark, folder of the driver tables)."""

    def register(build):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(spark, sf)

        CHECKS[name] = (run, sql)
        return build

    return register


def load() -> dict[str, tuple[Callable, str | None]]:
    from workload import activity, operations, posts, publication, streams  # noqa: F401  (they register)

    return CHECKS
