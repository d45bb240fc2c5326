"""Tables between two passes, kept where every executor reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagtide.session import fresh_folder


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a table once into the cluster's shared folder and reads it back.

    Later passes then neither repeat the work nor depend on the executors that
    did it.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose tables are stored by now.

    They go when the driver's JVM collects the plans that made them, which on a
    quiet driver may be long after.
    """
    spark.sparkContext._jvm.System.gc()
