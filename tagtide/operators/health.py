"""Server health from the poll log, and the probe judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagtide import constants as C
from tagtide.functions.numbers import round_up_half
from tagtide.functions.servers import backoff_seconds, classify_probe, reclassify_on_failure
from tagtide.operators.robots import robots_permit


def fold_health(
    polls: DataFrame, registry: DataFrame, floor: int = C.HEADROOM_FLOOR, last_per_batch: bool = False
) -> DataFrame:
    """Health of each polled host after all its polls, taken in (at, seq) order.

    ``polls`` has host, at, seq, status, ok, remaining, reset. The end state
    needs no step-by-step fold: it depends on the last poll, the last success,
    and how many real failures came after that success. Both parts are plain
    aggregations, so a host holding most of the log is combined map-side.

    With ``last_per_batch`` only the last poll of each host and batch (one
    ``at``) may set the success time or the capability.
    """
    when = F.struct("at", "seq")
    throttled = F.col("status") == 429
    ok = F.col("ok") & ~throttled
    failed = ~F.col("ok") & ~throttled
    events = polls.select(
        "host", "at", "seq", "status", "remaining", "reset",
        ok.alias("_ok"), failed.alias("_failed"), throttled.alias("_throttled"),
    )
    ends = events.groupBy("host").agg(
        F.max(F.when(F.col("_ok"), when)).alias("_last_ok"),
        F.max_by(F.struct("at", "remaining", "reset", "_ok", "_throttled"), when).alias("_last"),
    )
    after = (F.col("_last_ok").isNull()) | (when > F.col("_last_ok"))
    failures = (
        events.filter("_failed").select("host", "at", "seq")
        .join(ends.select("host", "_last_ok"), "host").filter(after)
        .groupBy("host").agg(F.count("*").alias("_since_ok"))
    )
    if last_per_batch:
        events = events.groupBy("host", "at").agg(
            F.max_by(F.struct("seq", "status", "_ok", "_failed"), "seq").alias("e")
        ).select("host", "at", "e.*")
    marks = events.groupBy("host").agg(
        F.max(F.when(F.col("_ok"), F.col("at"))).alias("last_ok_at"),
        F.max(F.when(F.col("_failed"), reclassify_on_failure(F.col("status")))).alias("capability"),
    )
    start = registry.select("host", F.col("consecutive_failures").alias("_before"))
    carried = F.when(F.col("_last_ok").isNull(), F.coalesce("_before", F.lit(0))).otherwise(F.lit(0))
    count = (F.coalesce("_since_ok", F.lit(0)) + carried).cast("int")
    wait = F.coalesce(F.col("_last.reset"), F.col("_last.at") + C.BACKOFF_BASE_SECONDS)
    paused = (
        F.when(F.col("_last._throttled"), wait)
        .when(F.col("_last._ok"), F.when(F.col("_last.remaining") < floor, wait))
        .otherwise(F.col("_last.at") + backoff_seconds(F.col("consecutive_failures")))
    )
    return (
        ends.join(failures, "host", "left").join(marks, "host", "left").join(start, "host", "left")
        .withColumn("consecutive_failures", count)
        .withColumn("backoff_until", paused)
        .select("host", "consecutive_failures", "backoff_until", "last_ok_at", "capability")
    )


def health_summary(registry: DataFrame, poll_log: DataFrame, since: int) -> DataFrame:
    """Polls, failures, mean latency and lowest headroom of every server since a time."""
    rows = poll_log.filter(F.col("at") >= since).groupBy("host").agg(
        F.count("*").alias("polls"), F.count_if(~F.col("status").eqNullSafe(F.lit(200))).alias("failures"),
        round_up_half(F.avg("latency_ms"), 0).alias("mean_latency_ms"),
        F.min("ratelimit_remaining").alias("lowest_headroom"),
    )
    zero = F.lit(0).cast("bigint")
    return registry.join(rows, "host", "left").select(
        "host", "capability", "opt_out", "last_ok_at", "consecutive_failures", "backoff_until",
        F.coalesce("polls", zero).alias("polls"), F.coalesce("failures", zero).alias("failures"),
        "mean_latency_ms", "lowest_headroom",
    )


def judge_probes(results: DataFrame, token: str = C.COLLECTOR_TOKEN) -> DataFrame:
    """Verdict on each probed server; a closing robots file settles it before anything else."""
    opted_out = ~robots_permit(F.col("robots_body"), token)
    text = F.lit(None).cast("string")
    capability = classify_probe(
        F.col("timeline_ok"), F.col("timeline_status"), F.col("tags_ok"), F.col("software")
    )
    return results.withColumn("opted_out", opted_out).select(
        "host", "opted_out",
        F.when(F.col("opted_out"), "blocked").otherwise(capability).alias("capability"),
        F.when(F.col("opted_out"), text).otherwise(F.col("software")).alias("software"),
        F.when(F.col("opted_out"), text).otherwise(F.col("version")).alias("version"),
        F.when(F.col("opted_out"), "robots_disallow")
        .when(~F.col("timeline_ok"), F.concat(F.lit("http_"), F.col("timeline_status"))).alias("reason"),
    )
