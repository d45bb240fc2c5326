"""Evaluating candidate tags, summarising server counters, and checking claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tagtide import constants as C
from tagtide.functions import ratings as R
from tagtide.functions.text import casefold_tag, tag_display
from tagtide.operators.ranking import top_rows_per_group


def clean_candidates(requests: DataFrame, limit: int = C.MAX_REQUEST_TAGS) -> DataFrame:
    """(request_id, tags text) to at most ``limit`` usable distinct names per request.

    The first spelling of a name is the one shown. The whole text is read inside
    its row, keeping only the names found so far, so nothing is shuffled.
    """
    empty = F.array().cast("array<struct<tag:string,display:string>>")

    def once(value: Column, use) -> Column:
        # Names a value inside the lambda, so it is worked out once per word.
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def add(found: Column, display: Column, tag: Column) -> Column:
        more = F.concat(found, F.array(F.struct(tag.alias("tag"), display.alias("display"))))
        return F.when(F.exists(found, lambda f: f["tag"] == tag), found).otherwise(more)

    def take(found: Column, raw: Column) -> Column:
        # A full list is returned as it is, before the next word is looked at.
        cleaned = once(tag_display(raw), lambda d: F.when(d.isNull(), found).otherwise(
            once(casefold_tag(d), lambda t: add(found, d, t))))
        return F.when(F.size(found) >= limit, found).otherwise(cleaned)

    found = F.aggregate(F.split("tags", ","), empty, take)
    # The outer form keeps the optimizer from reading the text again to test for an empty list.
    rows = requests.select("request_id", F.posexplode_outer(found).alias("place", "c")).filter(F.col("c").isNotNull())
    return rows.select("request_id", "c.tag", "c.display", (F.col("place") + 1).alias("place"))


def name_evidence(
    names: DataFrame, overview: DataFrame, stats: DataFrame, summaries: DataFrame | None = None
) -> DataFrame:
    """Everything known about each distinct name, tracked figures before sightings.

    ``names`` has one ``tag`` column without repeats. Every side has one row per
    name, so these joins cannot be skewed however often a name is asked for.
    """
    tracked = overview.select(
        F.col("name").alias("tag"), F.col("id").alias("tag_id"), F.col("display").alias("tracked_display"),
        "posts_24h", F.col("authors_24h").alias("_authors"), F.col("origin_servers_24h").alias("_servers"),
        "authors_1h", "authors_prev_1h",
    )
    seen = stats.select(
        F.col("name").alias("tag"), F.col("distinct_authors").alias("sighting_authors"),
        F.col("distinct_origin_servers").alias("_seen_servers"), F.col("posts_per_author").alias("_seen_ratio"),
    )
    is_tracked = F.col("tag_id").isNotNull()
    standing = F.when(is_tracked, "tracked").when(F.col("sighting_authors").isNotNull(), "discovered").otherwise("unseen")
    authors = F.when(is_tracked, F.col("_authors")).otherwise(F.col("sighting_authors"))
    servers = F.when(is_tracked, F.col("_servers")).otherwise(F.col("_seen_servers"))
    ratio = F.when(is_tracked, R.posts_per_author(F.col("posts_24h"), F.col("_authors"))).otherwise(F.col("_seen_ratio"))
    rows = names.join(tracked, "tag", "left").join(seen, "tag", "left")
    told = ["uses_7d", "accounts_7d", "source_count"]
    if summaries is not None:
        rows = rows.join(summaries.select("tag", *told), "tag", "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("bigint") for c in told})
    return rows.select(
        "tag", "tag_id", "tracked_display", standing.alias("standing"), authors.alias("authors_24h"), "posts_24h",
        servers.alias("origin_servers_24h"), R.authors_per_server(authors, servers).alias("authors_per_server"),
        ratio.alias("posts_per_author"), "authors_1h", "authors_prev_1h",
        F.when(~is_tracked, F.col("sighting_authors")).alias("sighting_authors"),
        F.when(~is_tracked, F.col("uses_7d")).alias("reported_uses_7d"),
        F.when(~is_tracked, F.col("accounts_7d")).alias("reported_accounts_7d"),
        F.when(~is_tracked, F.col("source_count")).alias("reported_sources"),
    )


def candidate_standing(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """The evidence beside each candidate of each request."""
    joined = candidates.join(evidence, "tag")
    return joined.withColumn("display", F.coalesce("tracked_display", "display")).drop("tracked_display", "tag_id")


def add_reading(evaluated: DataFrame) -> DataFrame:
    """Shape, spread and recency codes, and a sentence."""
    shape = R.reading_shape(
        F.col("standing"), F.col("authors_24h"), F.col("authors_per_server"), F.col("posts_per_author")
    )
    return evaluated.withColumn("shape", shape).withColumns({
        "spread": R.reading_spread(F.col("shape"), F.col("origin_servers_24h")),
        "recency": R.reading_recency(F.col("shape"), F.col("authors_1h")),
        "reading": R.reading_text(
            F.col("shape"), F.col("authors_24h"), F.col("origin_servers_24h"),
            F.col("authors_per_server"), F.col("posts_per_author"),
        ),
    })


def rank_candidates(evaluated: DataFrame, limit: int = C.MAX_REQUEST_TAGS) -> DataFrame:
    """Order inside each request, which holds at most ``limit`` names: most authors first, unseen last."""
    order = [
        F.coalesce("authors_24h", F.lit(-1)).desc(), F.coalesce("origin_servers_24h", F.lit(-1)).desc(), F.asc("tag"),
    ]
    return top_rows_per_group(evaluated, ["request_id"], order, limit)


def server_report_totals(days: DataFrame, keys: list[str]) -> DataFrame:
    """Per tag and server: week totals and the highest single day."""
    return days.groupBy(*keys, "host").agg(
        F.sum("uses").alias("uses_7d"), F.sum("accounts").alias("accounts_7d"),
        F.greatest(F.lit(0), F.max("accounts")).alias("peak"),
    )


def summarise_server_reports(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What servers say about a tag themselves. Totals are not deduplicated between servers.

    ``days`` has one row per tag, host and day; a tag no server reported on has no row here.
    """
    keys = keys or ["tag"]
    per_server = server_report_totals(days, keys)
    detail = F.sort_array(F.collect_list(F.struct("host", "uses_7d", "accounts_7d")))
    return per_server.groupBy(*keys).agg(
        F.sum("uses_7d").alias("uses_7d"), F.sum("accounts_7d").alias("accounts_7d"),
        F.max("peak").alias("peak_day_accounts"), F.count("*").alias("source_count"), detail.alias("per_server"),
    )


def add_server_reports(evaluated: DataFrame) -> DataFrame:
    """Replaces the reading of unseen candidates by what servers say themselves."""
    told = (F.col("standing") == "unseen") & F.col("reported_sources").isNotNull()
    unused = told & (F.col("reported_accounts_7d") == 0)
    shape = F.when(unused, "reported_unused").when(told, "reported_in_use").otherwise(F.col("shape"))
    text = (
        F.when(unused, F.format_string("Not observed; %d servers asked report no use this week.", "reported_sources"))
        .when(told, F.format_string("Not observed; %d servers asked report %d accounts this week (their own count).",
                                    "reported_sources", "reported_accounts_7d"))
        .otherwise(F.col("reading"))
    )
    only_unseen = {c: F.when(told, F.col(c)) for c in ("reported_uses_7d", "reported_accounts_7d", "reported_sources")}
    return evaluated.withColumns({"reading": text, "shape": shape}).withColumns(only_unseen)


def mixed_standings(evaluated: DataFrame) -> DataFrame:
    """Adds whether a request's figures come from one kind of evidence and so may be compared.

    A request holds a handful of names at most, so the window is tiny.
    """
    kinds = F.size(F.collect_set("standing").over(Window.partitionBy("request_id")))
    return evaluated.withColumn("comparable", kinds <= 1)


def claim_verdict(
    claim: Column, scope: Column, standing: Column, authors_24h: Column, authors_1h: Column, authors_prev_1h: Column,
    hours_comparable: Column, coverage: Column, sighting_authors: Column, reported_accounts: Column,
) -> Column:
    """Struct of verdict, reason code, and which true sentence may be said instead.

    Scope is judged first; then each claim by its own evidence.
    """
    zero = F.lit(0)
    observed = F.coalesce(authors_24h, zero) > 0
    sighted = (standing == "discovered") & (F.coalesce(sighting_authors, zero) > 0)
    reported = F.coalesce(reported_accounts, zero) > 0
    fallback = F.when(sighted, "sighted").when(reported, "server_reported").otherwise("no_evidence")
    say_seen = F.when(observed, "observed").otherwise(fallback)

    change = F.when(authors_prev_1h == 0, F.lit(1.0)).otherwise(
        F.try_divide(authors_1h - authors_prev_1h, authors_prev_1h)
    )
    actual = F.when(F.abs(change) < C.FLAT_BAND, "flat").when(change > 0, "rising").otherwise("falling")
    no_series = (standing != "tracked") | authors_1h.isNull() | authors_prev_1h.isNull()
    few = F.greatest(authors_1h, authors_prev_1h) < C.MIN_AUTHORS_FOR_DIRECTION
    thin = F.coalesce(coverage, F.lit("thin")) == "thin"
    tracked = standing == "tracked"

    def out(verdict: str, reason: str | Column, say: str | Column) -> Column:
        as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(verdict).alias("verdict"), as_col(reason).alias("reason"), as_col(say).alias("may_say"))

    directional = (
        F.when(no_series, out("blocked", "not_polled", fallback))
        .when(~hours_comparable, out("blocked", "coverage_changed", "observed"))
        .when(few, out("blocked", "too_few_authors", "observed"))
        .when(actual == claim, out("allowed", "direction_matches", actual))
        .when(actual == "flat", out("blocked", "data_says_flat", "flat"))
        .otherwise(out("blocked", "data_says_opposite", actual))
    )
    evidence = observed | (F.coalesce(sighting_authors, zero) > 0) | reported
    return (
        F.when(scope == C.NETWORK_SCOPE,
               out("blocked", "no_complete_view", F.when(tracked & observed, "observed").otherwise(fallback)))
        .when(claim.isin("rising", "falling"), directional)
        .when((claim == "busy") & (~tracked | ~observed), out("blocked", "nothing_observed", fallback))
        .when(claim == "busy",
              out("qualified", F.when(coverage == "thin", "judgement_thin_coverage").otherwise("judgement"), "observed"))
        .when((claim == "quiet") & ~tracked, out("blocked", "not_polled", fallback))
        .when((claim == "quiet") & thin, out("blocked", "coverage_thin", "observed"))
        .when(claim == "quiet", out("qualified", "judgement", "observed"))
        .when((claim == "in_use") & evidence, out("allowed", "positive_evidence", say_seen))
        .when(claim == "in_use", out("blocked", "no_evidence", fallback))
        .when((claim == "unused") & observed, out("blocked", "observed_in_use", "observed"))
        .when(claim == "unused", out("blocked", "absence_is_not_evidence", fallback))
    )


def claim_sentence(kind: Column) -> Column:
    """The sentence behind a ``may_say`` code, in this project's own words."""
    d = F.col("display")
    return (
        F.when(kind == "observed", F.format_string(
            "In the last day this index saw #%s from %d accounts on %d origin servers (%d servers monitored).",
            d, "authors_24h", "origin_servers_24h", "instances_monitored"))
        .when(kind == "sighted", F.format_string(
            "#%s is not polled, but %d accounts were seen using it beside polled tags.", d, "sighting_authors"))
        .when(kind == "server_reported", F.format_string(
            "%d servers count about %d accounts on #%s this week; this index did not observe it.",
            "reported_sources", "reported_accounts_7d", d))
        .when(kind == "flat", F.format_string(
            "#%s is level: %d authors an hour before, %d in the last hour.", d, "authors_prev_1h", "authors_1h"))
        .when(kind.isin("rising", "falling"), F.format_string(
            "#%s is %s on the monitored servers: %d authors an hour before, %d in the last hour.",
            d, kind, "authors_prev_1h", "authors_1h"))
        .otherwise(F.format_string("This index knows nothing about #%s.", d))
    )
