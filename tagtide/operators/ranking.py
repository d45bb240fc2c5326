"""Ordered cuts and ranks that never gather an unbounded input in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagtide.session import settled

# Above this cut Spark no longer trims window groups before the shuffle.
_GROUP_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"
_SALTS = 64


def top_rows(df: DataFrame, order: list[Column], n: int, rank: str | None = "rank") -> DataFrame:
    """The first ``n`` rows of the whole input, optionally numbered from 1.

    The limit comes first, so each task keeps ``n`` rows and only those meet.
    """
    cut = df.orderBy(*order).limit(n)
    if rank is None:
        return cut
    return cut.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_rows_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1.

    Up to the optimizer's threshold Spark trims every task's groups before the
    shuffle. A larger cut is taken in two steps, the first inside salted slices
    of each group, so a group holding most rows is still spread out.
    """
    threshold = int(df.sparkSession.conf.get(_GROUP_LIMIT, "1000"))
    if n > threshold:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_SALTS))
        sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", salt)
            .withColumn("_in_slice", F.row_number().over(sliced))
            .filter(F.col("_in_slice") <= n)
            .drop("_slice", "_in_slice")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Number every row of an unbounded input in order, without a single-task window.

    Rows are range partitioned and sorted once; a checkpoint fixes that layout,
    so a lost executor cannot shift it. A row's number is its place in its
    partition plus the sizes of the partitions before, which are only as many
    rows as there are partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = settled(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    sizes = laid.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    place = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        laid.join(offsets, "_part")
        .withColumn(rank, F.col("_before") + place + 1)
        .drop("_part", "_row", "_before")
    )


def running_total_before(
    df: DataFrame, keys: list[str], position: str, value: str, out: str, block: int = 4096
) -> DataFrame:
    """Sum of ``value`` over the earlier integer positions of each group.

    Two levels: totals of whole blocks are summed first, then the rows inside a
    block, so no task ever holds more than one block or the block totals.
    """
    blocks = df.withColumn("_block", F.floor(F.col(position) / block))
    totals = blocks.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_blocks_before"))
    inside = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(totals, [*keys, "_block"])
        .withColumn(out, F.col("_blocks_before") + F.col("_inside"))
        .drop("_block", "_inside", "_blocks_before")
    )
