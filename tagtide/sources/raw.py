"""Captured pages, daily counters and stored tables as DataFrames or streams.

Lines that are no record of their kind, pages without a list of statuses and
lists that can't be read go to a quarantine with what they were and why, and
never stop a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tagtide import schemas
from tagtide.functions.text import parse_int_prefix

#: Where the reader leaves a line that is no record of the declared schema.
CORRUPT = "_corrupt_record"
QUARANTINE = "server STRING, batch_at BIGINT, page_id STRING, reason STRING, record STRING"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages, one JSON record per line, by the declared schema."""
    return spark.read.schema(schemas.CAPTURED_PAGE).json(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.CAPTURED_PAGE).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def capture_records(spark: SparkSession, path: str) -> DataFrame:
    """Every line of captured pages: the declared fields, and the line itself where it is no such record."""
    return spark.read.schema(with_corrupt(schemas.CAPTURED_PAGE)).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def stream_records(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The same as a stream of files."""
    reader = spark.readStream.schema(with_corrupt(schemas.CAPTURED_PAGE)).option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(path)


def _corrupt(records: DataFrame) -> Column:
    """Whether a line is no record, judged by all declared fields whatever else of them is read.

    The reader parses the fields that a query needs only, so all of them are named here.
    """
    fields = [c for c in records.columns if c != CORRUPT]
    return F.col(CORRUPT).isNotNull() & (F.xxhash64(*fields).bitwiseAND(F.lit(0)) == 0)


def page_fault(records: DataFrame, body: str = "body") -> Column:
    """Why a record can't be taken as a page, or null.

    ``no_record``: the line is not one JSON object of the declared fields;
    ``no_list``: its body is not a list; ``unreadable_list``: the list can't be parsed.
    """
    corrupt = _corrupt(records) if CORRUPT in records.columns else F.lit(False)
    is_array = F.coalesce(F.col(body).rlike(r"\A\s*\["), F.lit(False))
    parsed = F.from_json(F.col(body), T.ArrayType(schemas.STATUS))
    return F.when(corrupt, "no_record").when(~is_array, "no_list").when(parsed.isNull(), "unreadable_list")


def sound_pages(records: DataFrame, body: str = "body") -> DataFrame:
    """The pages whose line is a record; what else is wrong with a page shows in ``quarantined``."""
    kept = records.filter(~_corrupt(records)) if CORRUPT in records.columns else records
    return kept.drop(CORRUPT)


def quarantined(records: DataFrame, body: str = "body") -> DataFrame:
    """(server, batch_at, page_id, reason, record) of what can't be taken as a page."""
    line = F.coalesce(F.col(CORRUPT), F.col(body)) if CORRUPT in records.columns else F.col(body)
    text = F.lit(None).cast("string")
    own = [F.col(c) if c in records.columns else text.cast(t).alias(c) for c, t in (("server", "string"), ("batch_at", "bigint"), ("page_id", "string"))]
    return records.withColumn("reason", page_fault(records, body)).filter("reason IS NOT NULL").select(*own, "reason", line.alias("record"))


def parse_statuses(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per status of each page. A page that is not an array gives no rows.

    The other page columns are carried along with the status's position.
    """
    carried = [c for c in pages.columns if c != body]
    is_array = F.col(body).rlike(r"\A\s*\[")
    parsed = F.from_json(F.col(body), T.ArrayType(schemas.STATUS))
    # The outer form keeps the optimizer from parsing a page again to test it for emptiness.
    rows = pages.filter(is_array).select(*carried, F.posexplode_outer(parsed).alias("pos", "status"))
    return rows.filter(F.col("pos").isNotNull())


def rejected_pages(pages: DataFrame, body: str = "body") -> DataFrame:
    return pages.filter(~F.coalesce(F.col(body).rlike(r"\A\s*\["), F.lit(False)))


def read_statuses(spark: SparkSession, path: str) -> DataFrame:
    return parse_statuses(read_pages(spark, path))


def parse_counters(captured: DataFrame) -> DataFrame:
    """Daily counters per server and tag. Numbers arrive as text; unreadable days are skipped."""
    days = captured.select("server", "name", F.explode("history").alias("d"))
    numbers = [parse_int_prefix(F.col(f"d.{c}")).alias(c) for c in ("day", "uses", "accounts")]
    return days.select(F.col("server").alias("host"), F.col("name").alias("tag"), *numbers).na.drop(
        subset=["day", "uses", "accounts"]
    )


def counter_records(spark: SparkSession, path: str) -> DataFrame:
    """Every line of captured counters: the declared fields, and the line itself where it is no such record."""
    return spark.read.schema(with_corrupt(schemas.TAG_COUNTERS)).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def quarantined_counters(records: DataFrame) -> DataFrame:
    """(server, name, reason, record) of lines that are no record, lack a name or a history, or have a day that can't be read."""
    numbers = F.exists("history", lambda d: parse_int_prefix(d["day"]).isNull() | parse_int_prefix(d["uses"]).isNull()
                       | parse_int_prefix(d["accounts"]).isNull())
    reason = (
        F.when(_corrupt(records), "no_record").when(F.col("server").isNull() | F.col("name").isNull(), "no_name")
        .when(F.col("history").isNull(), "no_history").when(F.coalesce(numbers, F.lit(False)), "unreadable_day"))
    line = F.coalesce(F.col(CORRUPT), F.to_json(F.struct("server", "name", "history")))
    return records.withColumn("reason", reason).filter("reason IS NOT NULL").select("server", "name", "reason", line.alias("record"))


def read_tag_counters(spark: SparkSession, path: str) -> DataFrame:
    return parse_counters(spark.read.schema(schemas.TAG_COUNTERS).json(path))
