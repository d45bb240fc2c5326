"""The scheduled jobs: collection batch, tier changes, discovery pass, probing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagtide import constants as C
from tagtide.operators import health, ingest, merges, overview as O, policy, pool as P
from tagtide.session import settled


def discovery_decisions(
    observed: DataFrame, tags: DataFrame, pool: DataFrame, now: int, max_tracked: int = C.MAX_TRACKED
) -> DataFrame:
    """Every promotion and retirement of one pass as (action, reason, id, name, place).

    Retirements come first, so the slots they free are open to promotion.

    The per-tag figures and each step's short decision list are checkpointed:
    every later step reads them, and none should read the posts again.
    """
    figures = settled(O.tracked_activity(observed, tags, now))
    tracked = figures.withColumn("posts_24h", F.col("posts_any_24h"))
    quiet = policy.select_quiet_retirements(tracked, now).select("id", "name")
    narrow = policy.select_non_community_retirements(figures, now).select("id", "name").join(
        quiet.select("id"), "id", "left_anti"
    )
    dropped = quiet.select("id").unionByName(narrow.select("id"))
    remaining = tracked.join(dropped, "id", "left_anti")
    excess = policy.select_excess_retirements(remaining, now, max_tracked).select("id", "name")

    def retired(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select(
            F.lit("retire").alias("action"), F.lit(reason).alias("reason"), "id", "name", F.lit(None).cast("int").alias("place")
        )

    retiring = settled(retired(quiet, "quiet").unionByName(retired(narrow, "not_community")).unionByName(
        retired(excess, "over_ceiling")
    ))
    after = merges.retire_tags(tags, retiring.select("id"), now)
    # Neither list is cut before the gates; more than max_tracked can never be taken.
    wanted = policy.queried_untracked(after, now - C.WEEK, max(1, max_tracked))
    candidates = P.load_candidates(pool, after, now - C.POOL_HOURS * C.HOUR, limit=None)
    promoted = policy.select_promotions_with_queried(
        wanted, candidates, policy.count_tracked(after).scalar(), max_tracked
    )
    return settled(retiring.unionByName(promoted.select(
        F.lit("promote").alias("action"), F.col("source").alias("reason"), F.lit(None).cast("bigint").alias("id"),
        "name", F.col("rank").cast("int").alias("place"),
    )))


def apply_discovery(tags: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    retired = merges.retire_tags(tags, decisions.filter(F.col("action") == "retire"), now)
    return merges.promote_tags(retired, decisions.filter(F.col("action") == "promote"), now)


def retier_pass(observed: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    return policy.retier(tags, O.posts_per_hour(observed, tags, now), now)


def probe_pass(registry: DataFrame, results: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Judges captured probe results and returns (registry after, verdicts)."""
    verdicts = health.judge_probes(results)
    outs = verdicts.filter("opted_out").select("host", "reason")
    return merges.record_probes(merges.set_opt_out(registry, outs), verdicts, now), verdicts


def tick_report(
    jobs: DataFrame, polls: DataFrame, normalised: DataFrame, sightings: DataFrame, tags: DataFrame, keys: list[str],
    candidate_limit: int | None = None,
) -> DataFrame:
    """One row per batch: jobs, bytes, servers, posts, writes, candidates and skips.

    ``jobs`` carries ``run`` and ``bytes``; ``sightings`` is the exploded tags of
    kept posts. All candidates are written unless the caller sets an allowance.
    """
    planned = jobs.groupBy(*keys).agg(
        F.count("*").alias("jobs_planned"), F.count_if("run").alias("jobs_run"),
        F.count_if(~F.col("run")).alias("jobs_deferred"),
        F.coalesce(F.sum(F.when(F.col("run"), F.col("bytes"))), F.lit(0)).alias("bytes_parsed"),
    )
    hosts = (
        polls.groupBy(*keys, "host").agg(F.max("ok").alias("_ok"), F.max(~F.col("ok")).alias("_bad"))
        .groupBy(*keys).agg(F.count_if("_ok").alias("hosts_ok"), F.count_if("_bad").alias("hosts_failed"))
    )
    skips = ingest.skip_counts(normalised, keys).withColumnRenamed("posts", "posts_observed")
    matched = ingest.match_tracked_tags(sightings, tags)
    written = matched.select(*keys, "tag_id", "uri").distinct().groupBy(*keys).agg(F.count("*").alias("observations_written"))
    minutes = (
        matched.filter(~F.col("is_boost")).select(*keys, "tag_id", F.floor(F.col("created_at") / 60).alias("m"))
        .distinct().groupBy(*keys).agg(F.count("*").alias("rollup_buckets"))
    )
    fresh = ingest.untracked_sightings(sightings, tags)
    pairs = fresh.select(*keys, "name", "author_hash").distinct().groupBy(*keys, "name").agg(F.count("*").alias("_pairs"))
    seen = pairs.groupBy(*keys).agg(
        F.count("*").alias("candidates_seen"),
        (F.sum("_pairs") if candidate_limit is None else F.least(F.sum("_pairs"), F.lit(candidate_limit))).alias("candidates_written"),
    )
    report = planned
    for part in (hosts, skips, written, minutes, seen):
        report = report.join(part, keys, "left")
    return report.na.fill(0)
