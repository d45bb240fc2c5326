"""Predicates and classifications over server rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtide import constants as C


def is_monitored() -> Column:
    return ~F.col("opt_out") & (F.col("capability") == "timeline") & F.col("bit").isNotNull()


def is_collectable(now: int) -> Column:
    return is_monitored() & (F.coalesce(F.col("backoff_until"), F.lit(0)) <= now)


def is_federating_software(software: Column) -> Column:
    return F.coalesce(F.lower(F.trim(software)).isin(*C.FEDERATING_SOFTWARE), F.lit(False))


def classify_probe(timeline_ok: Column, timeline_status: Column, tags_ok: Column, software: Column) -> Column:
    return (
        F.when(timeline_ok, "timeline")
        .when(tags_ok, "tags_only")
        .when(timeline_status == 0, "unknown")
        .when(is_federating_software(software), "activitypub")
        .otherwise("blocked")
    )


def reclassify_on_failure(status: Column) -> Column:
    return F.when(status.isin(*C.REFUSED_STATUSES), "tags_only")


def backoff_seconds(failures: Column) -> Column:
    # The exponent is bounded first: the cap is reached after a handful of failures.
    doubling = F.pow(F.lit(2.0), F.least(failures, F.lit(32)) - 1) * C.BACKOFF_BASE_SECONDS
    capped = F.least(F.lit(float(C.BACKOFF_CAP_SECONDS)), doubling)
    return F.when(failures <= 0, F.lit(0)).otherwise(capped).cast("bigint")


def server_state(now: int) -> Column:
    """opted_out, paused, failing or ok, in that order of precedence."""
    return (
        F.when(F.col("opt_out"), "opted_out")
        .when(F.col("backoff_until") > now, "paused")
        .when(F.col("consecutive_failures") > 0, "failing")
        .otherwise("ok")
    )
