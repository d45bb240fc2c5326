"""Turning arrays worked out in a row into rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once a row even where the body uses it in a loop."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unfold(df: DataFrame, array: Column | str, name: str) -> DataFrame:
    """One row per non-null element.

    A plain explode makes the optimizer test the array for emptiness first, which
    works an expensive array expression out several times; the outer form does not.
    """
    return df.withColumn(name, F.explode_outer(array)).filter(F.col(name).isNotNull())
