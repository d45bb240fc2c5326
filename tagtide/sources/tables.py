"""Stored tables: day-partitioned observations with an index of their keys, and small snapshot tables.

A post keeps the time of creation of its first view, so a later view with another
time belongs to the day that holds the post. The index says which: (tag_id, uri)
by day, sorted by a bucket of the key's hash, so that a lookup reads the row groups
with the batch's own buckets, of two narrow columns. It is written before the posts
and may name a post that is not there, never the other way round.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagtide import constants as C
from tagtide.operators.merges import upsert_observations
from tagtide.session import fresh_folder

#: Parts of the keys' hash that the index is sorted by.
INDEX_BUCKETS = 64


def with_day(observed: DataFrame) -> DataFrame:
    return observed.withColumn("created_date", F.to_date(F.timestamp_seconds("created_at")))


def with_bucket(keys: DataFrame) -> DataFrame:
    return keys.withColumn("bucket", F.pmod(F.xxhash64("tag_id", "uri"), F.lit(INDEX_BUCKETS)).cast("int"))


def index_of(path: str) -> str:
    return f"{path.rstrip('/')}-index"


def _write_index(observed: DataFrame, path: str) -> None:
    """Replaces the index of the days that the posts lie in."""
    (
        with_bucket(observed.select("tag_id", "uri", "created_date"))
        .repartitionByRange("created_date", "bucket").sortWithinPartitions("created_date", "bucket", "tag_id", "uri")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_date").parquet(index_of(path))
    )


def _write_days(observed: DataFrame, path: str, mode: str = "overwrite") -> None:
    (
        observed.repartition("created_date", F.pmod(F.xxhash64("tag_id", "uri"), F.lit(32)))
        .sortWithinPartitions("created_date", "tag_id", "created_at")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic")
        .partitionBy("created_date").parquet(path)
    )


def write_observations(observed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Stores observations by day, clustered by tag inside each day.

    The hash of the post is part of the layout, so one busy tag or day is spread
    over several files.
    """
    _write_days(with_day(observed), path, mode)
    rebuild_index(observed.sparkSession, path)


def rebuild_index(spark: SparkSession, path: str) -> None:
    """The index of a stored table anew, from its keys."""
    _remove(spark, index_of(path))
    if _days(spark, path):
        _write_index(read_observations(spark, path), path)


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def _days(spark: SparkSession, path: str) -> list[str]:
    """The days a table is stored by."""
    files, at = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(n.split("=")[1] for n in names if n.startswith("created_date="))


def _files(spark: SparkSession, path: str):
    """The store's own file system, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _remove(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _rewrite_days(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Replaces the days that the rows lie in, and their index, from a copy in the shared folder that goes afterwards."""
    staged = fresh_folder(spark, "observations")
    rows.write.parquet(staged)
    rows = spark.read.parquet(staged)
    _write_index(rows, path)
    _write_days(rows, path)
    _remove(spark, staged)


def known_days(spark: SparkSession, keys: DataFrame, path: str) -> DataFrame:
    """(tag_id, uri, created_date) of the keys that the store holds, from the keys' own buckets of the index."""
    keys = with_bucket(keys.select("tag_id", "uri"))
    buckets = [row["bucket"] for row in keys.select("bucket").distinct().collect()]  # INDEX_BUCKETS at most
    index = spark.read.schema("tag_id BIGINT, uri STRING, bucket INT, created_date DATE").parquet(index_of(path))
    return index.filter(F.col("bucket").isin(buckets)).join(keys, ["bucket", "tag_id", "uri"], "left_semi").select(
        "tag_id", "uri", "created_date")


def merge_observations_into(spark: SparkSession, batch: DataFrame, path: str) -> None:
    """Merges a batch into the stored table, reading and rewriting only the days it touches.

    A known post is looked up by its key and stays in its stored day with its first
    attributes, whatever time a later view gives; a new one goes to the day of its
    earliest view. Repeating the batch gives the same table.
    """
    if not _days(spark, path):
        first = upsert_observations(batch.limit(0), batch)
        write_observations(first, path)
        return
    if not _days(spark, index_of(path)):
        rebuild_index(spark, path)
    staged = fresh_folder(spark, "batch")
    with_day(upsert_observations(batch.limit(0), batch)).write.parquet(staged)
    batch = spark.read.parquet(staged)
    known = known_days(spark, batch, path).withColumnRenamed("created_date", "_day")
    days = batch.join(known, ["tag_id", "uri"], "left").select(F.coalesce("_day", "created_date").alias("day")).distinct()
    days = [row["day"] for row in days.collect()]  # days, not posts
    if days:
        touched = read_observations(spark, path).filter(F.col("created_date").isin(days))
        merged = upsert_observations(touched.drop("created_date"), batch.drop("created_date"))
        _rewrite_days(spark, with_day(merged), path)
    _remove(spark, staged)


def expire_observations(spark: SparkSession, path: str, now: int, hours: int = C.OBSERVATION_HOURS) -> None:
    """Takes posts older than ``hours`` out of the store: whole days by their folder, the edge day by a rewrite."""
    cutoff = now - hours * C.HOUR
    edge = f"created_date={datetime.fromtimestamp(cutoff, UTC):%Y-%m-%d}"
    files, at = _files(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)]
    for name in names:
        if name.startswith("created_date=") and name < edge:
            _remove(spark, f"{path}/{name}")
            _remove(spark, f"{index_of(path)}/{name}")
    if edge in names:
        rows = read_observations(spark, path).filter(F.col("created_date") == edge.split("=")[1])
        fresh = rows.filter(F.col("created_at") >= cutoff)
        if fresh.isEmpty():
            _remove(spark, f"{path}/{edge}")
            _remove(spark, f"{index_of(path)}/{edge}")
        elif not rows.filter(F.col("created_at") < cutoff).isEmpty():
            _rewrite_days(spark, fresh, path)


def remove_from_store(spark: SparkSession, path: str, gone: DataFrame, key: str) -> None:
    """Takes posts out of the store whose ``key`` (author_hash or origin_host) is listed; rewrites only days that hold one."""
    stored = read_observations(spark, path)
    held = stored.join(gone.select(key), key, "left_semi").select("created_date").distinct()
    days = [row["created_date"] for row in held.orderBy("created_date").collect()]  # days, not posts
    if not days:
        return
    rows = stored.filter(F.col("created_date").isin(days))
    kept = rows.join(gone.select(key), key, "left_anti").select(*rows.columns)
    left = {row["created_date"] for row in kept.select("created_date").distinct().collect()}
    if left:
        _rewrite_days(spark, kept, path)
    for day in days:
        if day not in left:
            _remove(spark, f"{path}/created_date={day}")
            _remove(spark, f"{index_of(path)}/created_date={day}")


def scan_registry(registry: DataFrame) -> DataFrame:
    return registry.orderBy("host")


def scan_tag_history(history: DataFrame, tag_ids: DataFrame | None = None) -> DataFrame:
    rows = history if tag_ids is None else history.join(tag_ids.select("tag_id").distinct(), "tag_id", "left_semi")
    return rows.select("tag_id", "host", "day", "uses", "accounts").orderBy("tag_id", F.desc("day"), "host")
