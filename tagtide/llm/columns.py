"""Documents carried through an operator whatever their other columns are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.staging import staged

DOC = "_doc"


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as a long and text as bytes, as Python tasks read them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def carried(docs: DataFrame, *needed: str, own: list[str] | None = None) -> DataFrame:
    """The needed columns beside the row (all of it, or its ``own`` columns), which is set apart in one column."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in own or docs.columns)).alias(DOC), *(F.col(f"`{c}`") for c in needed))


def without_text(docs: DataFrame) -> list[str]:
    """The other columns: what is shuffled or handed to Python has the text once."""
    return [c for c in docs.columns if c != "text"]


def keyed(docs: DataFrame) -> DataFrame:
    """The carried row but for its text, doc_id, text and a ``row`` that no other row has: the doc_id where that is so, else a number.

    Whether doc_ids tell rows apart is counted first. Where they don't, the table
    is stored with its numbers, so that every later pass sees the same ones.
    """
    rows = carried(docs, "doc_id", "text", own=without_text(docs))
    alone = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    if alone:
        return rows.withColumn("row", F.col("doc_id").cast("long"))
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def unpacked(names: list[str], **changed: Column) -> list[Column]:
    """The carried row's own columns again, some of them changed."""
    return [(changed[c] if c in changed else F.col(f"{DOC}.`{c}`")).alias(c) for c in names]
