"""The published reports, each as one plan over all tags, servers or requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtide import constants as C
from tagtide.functions import ratings as R
from tagtide.functions.numbers import round_up_half
from tagtide.functions.servers import is_collectable, is_monitored, server_state
from tagtide.operators import health, overview as O, policy, pool as P, trust, windows as W
from tagtide.session import settled


def monitored_count(registry: DataFrame) -> Column:
    return registry.agg(F.count_if(is_monitored())).scalar()


def last_successful_update(registry: DataFrame) -> DataFrame:
    return registry.agg(F.max("last_ok_at").alias("last_successful_update"))


def degraded_hosts(registry: DataFrame, now: int) -> DataFrame:
    """Monitored servers that cannot be polled right now."""
    return registry.filter(is_monitored() & ~is_collectable(now)).select("host")


def hours_comparable(registry: DataFrame, polls: DataFrame, now: int, seconds: int = C.HOUR) -> Column:
    """Whether the last two spans were reported by similar shares of the monitored servers."""
    spans = {"current": (now - seconds, now), "previous": (now - 2 * seconds, now - seconds)}
    seen = W.reporting_counts(polls, spans).select(F.struct("current", "previous")).scalar()
    return R.coverage_comparable(monitored_count(registry), seen["current"], seen["previous"])


def tag_report(
    observed: DataFrame, tags: DataFrame, registry: DataFrame, polls: DataFrame, history: DataFrame, now: int,
    windows: dict[str, int] | None = None, cron_seconds: int = C.CRON_SECONDS,
) -> DataFrame:
    """One row per tag: windows with trends, coverage, origins, tracking state, server counters.

    Reading registers nothing; counting a search is ``register_tag_queries``.
    """
    windows = windows or C.WINDOWS
    longest = max(windows.values())
    monitored = monitored_count(registry)
    by_window = W.multi_window_report(observed, tags, polls, monitored, now, windows)
    figures = F.struct(*[F.col(c) for c in by_window.columns if c not in ("id", "name")])
    per_tag = by_window.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("window"), figures))).alias("windows"),
        F.max(F.when(F.col("seconds") == longest, F.col("posts_observed"))).alias("_posts"),
    )
    start = now - longest
    # The posts are read once for masks and origins together; the rest works on the counts.
    counts = settled(W.origin_mask_counts(observed, start, now))
    median = W.weighted_median_popcount(counts)
    by_origin = counts.groupBy("tag_id", "host").agg(F.sum("posts").alias("posts_observed"))
    origins = W.leading_origins(by_origin).groupBy("tag_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "host", "posts_observed"))),
            lambda o: F.struct(o["host"].alias("host"), o["posts_observed"].alias("posts_observed")),
        ).alias("origins")
    )
    unique = by_origin.groupBy("tag_id").agg(F.count("*").alias("unique_origin_servers"))
    # Only tags without a post show their servers' counters, so only their history is gathered.
    silent = by_window.filter((F.col("seconds") == longest) & (F.col("posts_observed") == 0)).select(F.col("id").alias("tag_id"))
    counters = history.join(silent, "tag_id", "left_semi").groupBy("tag_id").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("day")).alias("k"), "host", "day", "uses", "accounts"))).alias("_days")
    )
    joined = tags.join(per_tag, "id")
    for part in (median, origins, unique, counters):
        joined = joined.join(part.withColumnRenamed("tag_id", "id"), "id", "left")
    days = F.transform("_days", lambda d: F.struct(
        d["host"].alias("host"), F.to_date(F.timestamp_seconds(d["day"])).alias("day"),
        d["uses"].alias("uses"), d["accounts"].alias("accounts")))
    degraded = degraded_hosts(registry, now).agg(F.sort_array(F.collect_list("host"))).scalar()
    updated = last_successful_update(registry).scalar()
    longest_key = next(k for k, v in windows.items() if v == longest)
    return joined.select(
        F.col("id").alias("tag_id"), F.col("name").alias("tag"), F.coalesce("display", "name").alias("display"),
        "tracked", R.tracking_state(F.col("tracked"), F.col("retired_at")).alias("tracking_state"),
        "tier", R.effective_interval(F.col("tier"), cron_seconds).alias("poll_interval_seconds"),
        R.tier_seconds(F.col("tier")).alias("tier_interval_seconds"),
        "first_seen_at", (F.col("first_seen_at") == now).alias("newly_registered"),
        "windows", monitored.alias("instances_monitored"),
        F.col("windows")[longest_key]["instances_reporting"].alias("instances_reporting"),
        degraded.alias("instances_degraded"),
        "median_instances_per_post", R.coverage_quality(F.col("median_instances_per_post"), monitored).alias("quality"),
        F.coalesce("unique_origin_servers", F.lit(0)).alias("unique_origin_servers"),
        F.coalesce("origins", F.array()).alias("origins"),
        updated.alias("last_successful_update"),
        F.when(F.col("_posts") == 0, days).alias("server_counters"),
    )


def lookup_report(report: DataFrame, window: str = "24h") -> DataFrame:
    """The short reading of a tag report: status first, then the headline window."""
    w = F.coalesce(F.col("windows")[window], F.col("windows")["24h"])
    day_posts = F.col("windows")["24h"]["posts_observed"]
    return report.select(
        "tag_id", "tag", R.lookup_status(day_posts).alias("status"),
        w["posts_observed"].alias("posts_observed"), w["authors_observed"].alias("authors_observed"),
        R.posts_per_author(w["posts_observed"], w["authors_observed"]).alias("posts_per_author"),
        R.window_direction(w["trend"], w["coverage_comparable"]).alias("direction"),
        round_up_half(w["trend"], 2).alias("change"), "quality",
        R.lookup_reason(day_posts, F.col("tracked"), F.col("newly_registered")).alias("reason"),
        R.lookup_remedy(day_posts, F.col("tracked")).alias("what_would_change_it"),
    )


def tracked_listing(overview: DataFrame, order: str = "authors", limit: int | None = None) -> DataFrame:
    """Tracked tags in the chosen order with the crowding ratio and each one's share of the peak."""
    overview = settled(overview)
    peak = overview.agg(F.greatest(F.lit(1), F.max("authors_24h"))).scalar()
    ranked = policy.rank_tags(overview, order, limit)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("authors_24h") / peak))
    return ranked.select(
        "rank", F.col("name").alias("tag"), F.coalesce("display", "name").alias("display"), "tier",
        F.col("posts_24h").alias("posts_observed"), F.col("authors_24h").alias("authors_observed"),
        R.posts_per_author(F.col("posts_24h"), F.col("authors_24h")).alias("posts_per_author"),
        F.col("posts_1h").alias("posts_observed_1h"), F.col("authors_1h").alias("authors_observed_1h"),
        F.col("origin_servers_24h").alias("origin_servers"), "first_seen_at", share.alias("share_of_peak"),
    )


def discovered_listing(
    pool: DataFrame, tags: DataFrame, now: int, limit: int = C.LISTED_CANDIDATES
) -> DataFrame:
    """Leading candidates with the advisory flags and whether the gates would pass them."""
    rows = P.load_candidates(pool, tags, now - C.POOL_HOURS * C.HOUR, C.MIN_AUTHORS, limit)
    authors, servers = F.col("distinct_authors"), F.col("distinct_origin_servers")
    return rows.select(
        "rank", F.col("name").alias("tag"), authors.alias("authors_observed"), servers.alias("origin_servers"),
        "posts_per_author", "mean_tags_per_post",
        R.looks_like_tag_spam(F.col("mean_tags_per_post")).alias("looks_like_tag_spam"),
        R.authors_per_server(authors, servers).alias("authors_per_server"),
        R.passes_promotion_gates(authors, servers).alias("would_promote"), "first_seen",
    )


def trending_report(
    observed: DataFrame, tags: DataFrame, registry: DataFrame, polls: DataFrame, now: int,
    limit: int = C.TRENDING_DEFAULT, receipts: int = 2,
) -> DataFrame:
    """Busiest tags of the last hour with a direction and their newest posts as receipts.

    Receipts are looked up only for the few tags that made the list.
    """
    comparable = hours_comparable(registry, polls, now)
    ranked = policy.rank_trending(O.tag_overview(observed, tags, now), comparable, limit)
    listed = ranked.select(F.col("id").alias("tag_id"))
    recent = W.originals(observed, now - C.HOUR).join(listed, "tag_id", "left_semi")
    posts = O.representative_posts(recent, now - C.HOUR, receipts).groupBy("tag_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "url", "origin_host", "created_at"))),
            lambda p: F.struct(p["url"].alias("url"), p["origin_host"].alias("origin_host"), p["created_at"].alias("created_at")),
        ).alias("recent_posts")
    )
    return (
        ranked.join(posts.withColumnRenamed("tag_id", "id"), "id", "left")
        .withColumn("recent_posts", F.coalesce("recent_posts", F.array()))
        .withColumn("hours_comparable", comparable)
    )


def asked_evidence(
    asked: DataFrame, observed: DataFrame, tags: DataFrame, pool: DataFrame, reports: DataFrame, now: int
) -> DataFrame:
    """Evidence on every distinct name of a ``tag`` column, however often it is asked for."""
    names = asked.select("tag").distinct()
    stats = P.candidate_stats(pool, names.select(F.col("tag").alias("name")), now - C.POOL_HOURS * C.HOUR)
    told = trust.summarise_server_reports(reports.join(names, "tag", "left_semi"))
    return trust.name_evidence(names, O.tag_overview(observed, tags, now), stats, told)


def evaluate_report(
    requests: DataFrame, observed: DataFrame, tags: DataFrame, pool: DataFrame, reports: DataFrame, now: int,
    limit: int = C.MAX_REQUEST_TAGS,
) -> DataFrame:
    """Each request's candidates, ranked, with standing, figures, reading and server reports.

    ``requests`` has request_id and a comma separated ``tags`` text; ``reports``
    the servers' daily counters (tag, host, day, uses, accounts).
    """
    candidates = trust.clean_candidates(requests, limit)
    evidence = asked_evidence(candidates.select("tag"), observed, tags, pool, reports, now)
    read = trust.add_server_reports(trust.add_reading(trust.candidate_standing(candidates, evidence)))
    return trust.rank_candidates(read.drop("place"), limit)


def compare_report(
    requests: DataFrame, observed: DataFrame, tags: DataFrame, pool: DataFrame, reports: DataFrame,
    rollups: DataFrame, now: int,
) -> DataFrame:
    """Up to four tags of a request side by side, with the day's hourly shape of tracked ones."""
    four = requests.withColumn(
        "tags", F.array_join(F.slice(F.split("tags", ","), 1, C.MAX_COMPARED_TAGS), ",")
    )
    evaluated = evaluate_report(four, observed, tags, pool, reports, now, C.MAX_COMPARED_TAGS)
    hourly = O.hourly_by_age(rollups, O.active_tags(tags), now).select(F.col("name").alias("tag"), "hourly")
    return trust.mixed_standings(evaluated).join(hourly, "tag", "left")


def check_claims(
    claims: DataFrame, observed: DataFrame, tags: DataFrame, registry: DataFrame, polls: DataFrame, pool: DataFrame,
    reports: DataFrame, now: int,
) -> DataFrame:
    """Verdict on each (claim_id, tag, claim, scope) row, with the evidence it rests on.

    ``tag`` is a cleaned name. Unknown claims are left out; any scope but the
    network-wide one means this index.
    """
    asked = claims.filter(F.col("claim").isin(*C.CLAIMS)).withColumn(
        "scope", F.when(F.col("scope") == C.NETWORK_SCOPE, C.NETWORK_SCOPE).otherwise(C.INDEX_SCOPE)
    )
    evidence = asked_evidence(asked, observed, tags, pool, reports, now)
    monitored = monitored_count(registry)
    median = W.weighted_median_popcount(W.mask_distribution(observed, now - C.DAY, now))
    grade = R.coverage_quality(F.col("median_instances_per_post"), monitored)
    graded = evidence.join(median, "tag_id", "left").withColumn("coverage", F.when(F.col("tag_id").isNotNull(), grade))
    sighted = F.col("tag_id").isNull()
    rows = asked.join(graded, "tag").withColumns({
        "display": F.coalesce("tracked_display", "tag"),
        "authors_24h": F.when(~sighted, F.col("authors_24h")),
        "origin_servers_24h": F.when(~sighted, F.col("origin_servers_24h")),
        "reported_sources": F.coalesce("reported_sources", F.lit(0)),
        "hours_comparable": hours_comparable(registry, polls, now),
        "instances_monitored": monitored,
    })
    verdict = trust.claim_verdict(
        F.col("claim"), F.col("scope"), F.col("standing"), F.col("authors_24h"), F.col("authors_1h"),
        F.col("authors_prev_1h"), F.col("hours_comparable"), F.col("coverage"), F.col("sighting_authors"),
        F.col("reported_accounts_7d"),
    )
    judged = rows.withColumn("_v", verdict).withColumn("may_say", F.col("_v.may_say"))
    return judged.withColumn("sentence", trust.claim_sentence(F.col("may_say"))).select(
        "claim_id", "tag", "display", "claim", "scope", "_v.verdict", "_v.reason", "may_say", "sentence", "standing",
        "posts_24h", "authors_24h", "origin_servers_24h", "authors_1h", "authors_prev_1h", "hours_comparable",
        "coverage", "sighting_authors", "reported_accounts_7d", "reported_sources", "instances_monitored",
    )


def instances_report(registry: DataFrame, polls: DataFrame, now: int) -> DataFrame:
    """Every server with its last hour and its present state."""
    rows = health.health_summary(registry, polls, now - C.HOUR)
    return rows.select(
        "host", "capability", F.col("opt_out").alias("opted_out"), F.col("last_ok_at").alias("last_successful_poll"),
        "consecutive_failures", F.when(F.col("backoff_until") > now, F.col("backoff_until")).alias("paused_until"),
        "polls", "failures", "mean_latency_ms", "lowest_headroom", server_state(now).alias("state"),
    )


def server_groups(registry: DataFrame) -> DataFrame:
    """(capability, host) of every server; opted-out servers form a group of their own. For registries of any size."""
    group = F.when(F.col("opt_out"), "opted_out").otherwise(F.col("capability")).alias("capability")
    return registry.select(group, "host")


def servers_by_capability(registry: DataFrame) -> DataFrame:
    """Hosts per capability in one row each, as the published report has them; ``server_groups`` has them as rows."""
    return server_groups(registry).groupBy("capability").agg(F.sort_array(F.collect_list("host")).alias("hosts"))


def coverage_report(registry: DataFrame) -> DataFrame:
    """One row: capability -> hosts."""
    return servers_by_capability(registry).agg(
        F.map_from_entries(F.collect_list(F.struct("capability", "hosts"))).alias("servers_by_capability")
    )


def meta_report(registry: DataFrame, pool: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    return P.discovery_stats(pool, tags, now).select(
        "*", monitored_count(registry).alias("instances_monitored"),
        last_successful_update(registry).scalar().alias("last_successful_update"),
    )


def timeseries_report(rollups: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """Minute points of the last day per tag."""
    points = W.timeseries(rollups, (now - C.DAY) // 60, now // 60 + 1)
    named = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    return points.join(named, "tag_id").select(
        "tag", (F.col("minute") * 60).alias("at"), F.col("posts").alias("posts_observed"), "instances_reporting"
    )


def posts_report(observed: DataFrame, tags: DataFrame, now: int, limit: int = 10) -> DataFrame:
    named = tags.select(F.col("id").alias("tag_id"), F.col("name").alias("tag"))
    posts = O.representative_posts(observed, now - C.DAY, limit)
    return posts.join(named, "tag_id").select("tag", "rank", "url", "created_at", "origin_host")


def _log_share(value: Column, high: Column) -> Column:
    """Place of a value between 1 and ``high`` on a log axis; the middle if the axis has no length."""
    low = F.log1p(F.lit(1.0))
    span = F.log1p(F.greatest(F.lit(0.0), high)) - low
    return F.when(span > 0, (F.log1p(F.greatest(F.lit(0.0), value)) - low) / span).otherwise(F.lit(0.5))


def shape_features(overview: DataFrame) -> DataFrame:
    """Normalised breadth, concentration and volume of every tag with authors, and the threshold line.

    The set-wide maxima come from one small aggregate, not from a window over all tags.
    """
    ratio = R.authors_per_server(F.col("authors_24h"), F.col("origin_servers_24h"), 0.0)
    active = overview.filter(F.col("authors_24h") > 0).withColumn("authors_per_server", ratio)
    peaks = active.agg(F.struct(
        F.max("authors_24h").cast("double").alias("authors"),
        F.greatest(F.lit(2.0 * C.MAX_AUTHORS_PER_SERVER), F.max("authors_per_server")).alias("ratio"),
        F.greatest(F.lit(1), F.max("posts_24h")).alias("posts"),
    )).scalar()
    line = _log_share(F.lit(float(C.MAX_AUTHORS_PER_SERVER)), peaks["ratio"])
    return active.select(
        "id", "name", F.coalesce("display", "name").alias("display"), "tier", "posts_24h", "authors_24h",
        F.col("origin_servers_24h").alias("origin_servers"), "authors_per_server",
        F.coalesce(R.posts_per_author(F.col("posts_24h"), F.col("authors_24h")), F.lit(0.0)).alias("posts_per_author"),
        _log_share(F.col("authors_24h").cast("double"), peaks["authors"]).alias("authors_share"),
        _log_share(F.col("authors_per_server"), peaks["ratio"]).alias("concentration_share"),
        F.sqrt(F.col("posts_24h") / peaks["posts"]).alias("volume_share"),
        line.alias("threshold_share"),
        (F.col("authors_per_server") > C.MAX_AUTHORS_PER_SERVER).alias("above_threshold"),
    )


def peak_normalised(series: Column) -> Column:
    """A series divided by its own peak, the peak being at least 1."""
    return F.transform(series, lambda v: v / F.greatest(F.lit(1), F.array_max(series)))


def explore_report(observed: DataFrame, rollups: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """Every tracked tag in strip order with its hourly shape and, if active, its place on the map."""
    overview = settled(O.tag_overview(observed, tags, now))
    hourly = O.hourly_posts(rollups, O.active_tags(tags), now).select("id", "hourly")
    features = shape_features(overview).select(
        "id", "authors_per_server", "authors_share", "concentration_share", "volume_share", "above_threshold"
    )
    rows = overview.join(hourly, "id").join(features, "id", "left").withColumn("rhythm", peak_normalised(F.col("hourly")))
    return rows.orderBy(R.tier_rank(F.col("tier")).asc(), F.desc("authors_24h"), F.asc("name"))
