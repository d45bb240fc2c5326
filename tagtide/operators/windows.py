"""Windowed counts, masks, origins, series and coverage, for all tags at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtide import constants as C
from tagtide.functions.arrays import unfold
from tagtide.functions.numbers import mask_bits, popcount, round_up_half
from tagtide.functions.ratings import coverage_comparable, coverage_quality, trend
from tagtide.operators.ranking import top_rows_per_group


def between(df: DataFrame, start: int, end: int | None = None, column: str = "created_at") -> DataFrame:
    """Rows in ``[start, end)``; also prunes by ``created_date`` where the table is stored by day."""
    cond = F.col(column) >= start
    if end is not None:
        cond = cond & (F.col(column) < end)
    if column == "created_at" and "created_date" in df.columns:
        cond = cond & (F.col("created_date") >= F.to_date(F.timestamp_seconds(F.lit(start))))
        if end is not None:
            cond = cond & (F.col("created_date") <= F.to_date(F.timestamp_seconds(F.lit(end))))
    return df.filter(cond)


def span_tallies(observed: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """Originals, exact distinct authors and boosts of several time spans in one pass.

    Rows are first reduced per (tag, author). An author counts for a span when it
    has an original in it, so the distinct counts become plain sums, and a tag
    holding a third of all posts is spread over its authors.
    """
    rows = between(observed, min(s for s, _ in spans.values()), max(e for _, e in spans.values()))
    boost = F.col("is_boost")
    counts, totals = [], []
    for label, (start, end) in spans.items():
        inside = (F.col("created_at") >= start) & (F.col("created_at") < end)
        counts += [F.count_if(inside & ~boost).alias(f"_p_{label}"), F.count_if(inside & boost).alias(f"_b_{label}")]
        totals += [
            F.sum(f"_p_{label}").alias(f"posts_{label}"),
            F.count_if(F.col(f"_p_{label}") > 0).alias(f"authors_{label}"),
            F.sum(f"_b_{label}").alias(f"boosts_{label}"),
        ]
    return rows.groupBy("tag_id", "author_hash").agg(*counts).groupBy("tag_id").agg(*totals)


def zero_filled(tags: DataFrame, figures: DataFrame, id_col: str = "id") -> DataFrame:
    """Every tag with its figures, 0 where nothing was observed."""
    names = [c for c in figures.columns if c != "tag_id"]
    joined = tags.join(figures, F.col(id_col) == F.col("tag_id"), "left")
    return joined.select(*tags.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


def window_counts(observed: DataFrame, tags: DataFrame, start: int, end: int) -> DataFrame:
    tallies = span_tallies(observed, {"w": (start, end)})
    figures = tallies.select(
        "tag_id", F.col("posts_w").alias("posts_observed"), F.col("authors_w").alias("authors_observed"),
        F.col("boosts_w").alias("boosts_observed"),
    )
    return zero_filled(tags.select("id", "name"), figures)


def originals(observed: DataFrame, start: int, end: int | None = None) -> DataFrame:
    return between(observed, start, end).filter(~F.col("is_boost"))


def mask_distribution(observed: DataFrame, start: int, end: int) -> DataFrame:
    rows = originals(observed, start, end)
    return rows.groupBy("tag_id", F.col("seen_mask").alias("mask")).agg(F.count("*").alias("posts"))


def weighted_median_popcount(distribution: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Median number of servers per post, weighted by the posts behind each mask."""
    keys = keys or ["tag_id"]
    counted = distribution.filter(F.col("posts") > 0).withColumn("_seen", popcount(F.col("mask")))
    counted = counted.groupBy(*keys, "_seen").agg(F.sum("posts").alias("_posts"))
    return counted.groupBy(*keys).agg(
        F.percentile("_seen", F.lit(0.5), F.col("_posts")).alias("median_instances_per_post")
    )


def median_instances_per_post(observed: DataFrame, start: int, end: int) -> DataFrame:
    """The same median straight from the rows, for small inputs and as a cross-check."""
    rows = originals(observed, start, end)
    return rows.groupBy("tag_id").agg(
        F.percentile(popcount(F.col("seen_mask")), F.lit(0.5)).alias("median_instances_per_post")
    )


def coverage_grades(observed: DataFrame, monitored: Column, start: int, end: int) -> DataFrame:
    medians = weighted_median_popcount(mask_distribution(observed, start, end))
    return medians.withColumn("quality", coverage_quality(F.col("median_instances_per_post"), monitored))


def origin_mask_counts(observed: DataFrame, start: int, end: int) -> DataFrame:
    """Originals per (tag, origin, mask): what medians, origin lists and origin counts are all made from."""
    rows = originals(observed, start, end)
    return rows.groupBy("tag_id", F.col("origin_host").alias("host"), F.col("seen_mask").alias("mask")).agg(
        F.count("*").alias("posts")
    )


def origin_breakdown(observed: DataFrame, start: int, end: int, limit: int = 20) -> DataFrame:
    counts = (
        originals(observed, start, end).groupBy("tag_id", F.col("origin_host").alias("host"))
        .agg(F.count("*").alias("posts_observed"))
    )
    return leading_origins(counts, limit)


def leading_origins(counts: DataFrame, limit: int = 20) -> DataFrame:
    return top_rows_per_group(counts, ["tag_id"], [F.desc("posts_observed"), F.asc("host")], limit)


def distinct_origins(observed: DataFrame, start: int, end: int) -> DataFrame:
    pairs = originals(observed, start, end).groupBy("tag_id", "origin_host").agg(F.lit(1).alias("_one"))
    return pairs.groupBy("tag_id").agg(F.count("*").alias("unique_origin_servers"))


def instances_reporting(polls: DataFrame, start: int, end: int) -> DataFrame:
    """One row: distinct hosts that answered with 200 in the span."""
    rows = between(polls, start, end, "at").filter(F.col("status") == 200)
    return rows.agg(F.countDistinct("host").alias("instances_reporting"))


def reporting_counts(polls: DataFrame, spans: dict[str, tuple[int, int]]) -> DataFrame:
    """One row: ``instances_reporting`` for several spans from one pass over the poll log."""
    rows = between(polls, min(s for s, _ in spans.values()), max(e for _, e in spans.values()), "at")
    rows = rows.filter(F.col("status") == 200)
    flags = [F.max((F.col("at") >= s) & (F.col("at") < e)).alias(k) for k, (s, e) in spans.items()]
    return rows.groupBy("host").agg(*flags).agg(*[F.count_if(F.col(k)).alias(k) for k in spans])


def reporting_masks(observed: DataFrame, start: int, end: int) -> DataFrame:
    return between(observed, start, end).select("tag_id", F.col("seen_mask").alias("mask")).distinct()


def reporting_hosts(observed: DataFrame, registry: DataFrame, start: int, end: int) -> DataFrame:
    """The servers that actually contributed posts of each tag."""
    masks = between(observed, start, end).groupBy("tag_id").agg(F.bit_or("seen_mask").alias("mask"))
    bits = unfold(masks, mask_bits(F.col("mask")), "bit")
    return bits.join(registry.select("host", "bit"), "bit").select("tag_id", "host")


def coverage_overlap(observed: DataFrame, registry: DataFrame, start: int, end: int) -> DataFrame:
    """Per tag: posts seen in all, posts of the single best server, and the gain from merging."""
    masks = mask_distribution(observed, start, end)
    total = masks.groupBy("tag_id").agg(F.sum("posts").alias("unique_posts"))
    per_server = (
        unfold(masks, mask_bits(F.col("mask")), "bit")
        .join(registry.select("bit"), "bit", "left_semi")
        .groupBy("tag_id", "bit").agg(F.sum("posts").alias("_posts"))
    )
    best = per_server.groupBy("tag_id").agg(F.max("_posts").alias("largest_server_posts"))
    return total.join(best, "tag_id", "left").withColumn(
        "extra_posts", F.col("unique_posts") - F.coalesce("largest_server_posts", F.lit(0))
    )


def server_overlap(observed: DataFrame, registry: DataFrame, start: int, end: int) -> DataFrame:
    """Posts shared by two servers, over all tags.

    Posts are counted per distinct mask first; a mask holds at most 63 servers,
    so the pair step works on bit positions, never on pairs of posts.
    """
    posts = originals(observed, start, end).groupBy("uri").agg(F.bit_or("seen_mask").alias("mask"))
    masks = posts.groupBy("mask").agg(F.count("*").alias("posts"))
    bits = mask_bits(F.col("mask"))
    pairs = F.flatten(F.transform(bits, lambda a: F.transform(
        F.filter(bits, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    shared = (
        unfold(masks, pairs, "p")
        .groupBy(F.col("p.a").alias("bit_a"), F.col("p.b").alias("bit_b")).agg(F.sum("posts").alias("shared_posts"))
    )
    a = registry.select(F.col("host").alias("server_a"), F.col("bit").alias("bit_a"))
    b = registry.select(F.col("host").alias("server_b"), F.col("bit").alias("bit_b"))
    return shared.join(a, "bit_a").join(b, "bit_b").select("server_a", "server_b", "shared_posts")


def lag_stats(observed: DataFrame, start: int, end: int) -> DataFrame:
    """How long after posting each tag's originals were first seen, in seconds."""
    lag = F.col("observed_at") - F.col("created_at")
    counts = originals(observed, start, end).groupBy("tag_id", lag.alias("_lag")).agg(F.count("*").alias("_n"))
    return counts.groupBy("tag_id").agg(
        F.percentile("_lag", F.lit(0.5), F.col("_n")).alias("median_lag"),
        round_up_half(F.sum(F.col("_lag") * F.col("_n")) / F.sum("_n")).alias("mean_lag"),
        F.max("_lag").alias("max_lag"),
    )


def language_mix(observed: DataFrame, start: int, end: int) -> DataFrame:
    return originals(observed, start, end).groupBy("tag_id", "language").agg(
        F.count("*").alias("posts"), F.count_if("sensitive").alias("sensitive_posts")
    )


def corroboration_gap(observed: DataFrame, history: DataFrame, start: int, end: int) -> DataFrame:
    """Observed daily figures beside each server's own counters, never added together."""
    day = (F.floor(F.col("created_at") / C.DAY) * C.DAY).alias("day")
    daily = (
        originals(observed, start, end).groupBy("tag_id", day, "author_hash").agg(F.count("*").alias("_p"))
        .groupBy("tag_id", "day").agg(F.sum("_p").alias("posts_observed"), F.count("*").alias("authors_observed"))
    )
    return daily.join(history.select("tag_id", "host", "day", "uses", "accounts"), ["tag_id", "day"], "left").select(
        "tag_id", "day", "posts_observed", "authors_observed", "host", "uses", "accounts",
        (F.col("uses") - F.col("posts_observed")).alias("uses_gap"),
    )


def minute_rollup(observed: DataFrame, reporting: Column, touched: DataFrame | None = None) -> DataFrame:
    """Originals per (tag, minute); with ``touched`` exactly those buckets, empty ones as 0."""
    minute = F.floor(F.col("created_at") / 60).alias("minute")
    rows = observed.filter(~F.col("is_boost")).select("tag_id", minute)
    counts = rows.groupBy("tag_id", "minute").agg(F.count("*").alias("posts"))
    if touched is not None:
        counts = touched.join(counts, ["tag_id", "minute"], "left").withColumn(
            "posts", F.coalesce("posts", F.lit(0).cast("bigint"))
        )
    return counts.withColumn("instances_reporting", reporting.cast("bigint"))


def timeseries(rollups: DataFrame, from_minute: int, to_minute: int) -> DataFrame:
    rows = rollups.filter((F.col("minute") >= from_minute) & (F.col("minute") < to_minute))
    return rows.select("tag_id", "minute", "posts", "instances_reporting").orderBy("tag_id", "minute")


def multi_window_report(
    observed: DataFrame, tags: DataFrame, polls: DataFrame, monitored: Column, now: int,
    windows: dict[str, int] | None = None,
) -> DataFrame:
    """One row per tag and window: current counts, trend against the window before, comparability."""
    windows = windows or C.WINDOWS
    spans = {}
    for key, seconds in windows.items():
        spans[f"{key}_now"] = (now - seconds, now)
        spans[f"{key}_prev"] = (now - 2 * seconds, now - seconds)
    tallies = zero_filled(tags.select("id", "name"), span_tallies(observed, spans))
    reporting = reporting_counts(polls, spans).select(F.struct("*").alias("r")).scalar()
    rows = []
    for key, seconds in windows.items():
        current, previous = reporting[f"{key}_now"], reporting[f"{key}_prev"]
        comparable = coverage_comparable(monitored, current, previous)
        posts = F.col(f"posts_{key}_now")
        rows.append(F.struct(
            F.lit(key).alias("window"),
            F.lit(seconds).alias("seconds"),
            posts.alias("posts_observed"),
            F.col(f"authors_{key}_now").alias("authors_observed"),
            F.col(f"boosts_{key}_now").alias("boosts_observed"),
            F.col(f"posts_{key}_prev").alias("posts_previous"),
            trend(posts, F.col(f"posts_{key}_prev"), comparable).alias("trend"),
            comparable.alias("coverage_comparable"),
            current.alias("instances_reporting"),
        ))
    return tallies.select("id", "name", F.inline(F.array(*rows)))
