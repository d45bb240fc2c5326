"""Column functions that grade, compare and describe figures."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tagtide import constants as C
from tagtide.functions.numbers import round_up_half


def coverage_quality(median_seen: Column, monitored: Column) -> Column:
    share = F.try_divide(median_seen, monitored)
    return (
        F.when(share >= C.GOOD_SHARE, "good")
        .when(share >= C.PARTIAL_SHARE, "partial")
        .otherwise("thin")
    )


def coverage_comparable(
    monitored: Column,
    current: Column,
    previous: Column,
    min_share: float = C.MIN_COMPARABLE_SHARE,
    max_drift: float = C.MAX_COVERAGE_DRIFT,
) -> Column:
    """Both windows saw enough servers, and nearly the same number of them."""
    enough = (F.try_divide(current, monitored) >= min_share) & (F.try_divide(previous, monitored) >= min_share)
    steady = F.try_divide(F.abs(current - previous), monitored) <= max_drift
    return F.when(monitored > 0, enough & steady).otherwise(F.lit(False))


def trend(current: Column, previous: Column, comparable: Column) -> Column:
    return F.when(comparable & (previous > 0), (current - previous) / previous)


def direction(current: Column, previous: Column, comparable: Column) -> Column:
    """Struct of direction, change and reason code for two author counts."""
    change = F.when(previous > 0, (current - previous) / previous)
    thin = F.greatest(current, previous) < C.MIN_AUTHORS_FOR_DIRECTION
    none = F.lit(None).cast("string")
    label = (
        F.when(~comparable, "not_comparable")
        .when(thin, "insufficient")
        .when(previous == 0, "up")
        .when(F.abs(change) < C.FLAT_BAND, "flat")
        .when(change > 0, "up")
        .otherwise("down")
    )
    reason = (
        F.when(~comparable, "coverage_changed")
        .when(thin, "too_few_authors")
        .when(previous == 0, "nothing_before")
        .otherwise(none)
    )
    return F.struct(
        label.alias("direction"),
        F.when(comparable & ~thin, change).alias("change"),
        reason.alias("reason"),
    )


def posts_per_author(posts: Column, authors: Column) -> Column:
    return F.when(authors > 0, round_up_half(posts / authors))


def authors_per_server(authors: Column, servers: Column, empty: float | None = None) -> Column:
    ratio = F.when(servers > 0, round_up_half(authors / servers))
    return ratio if empty is None else F.coalesce(ratio, F.lit(float(empty)))


def sightings_per_author(sightings: Column, authors: Column) -> Column:
    """NULL until somebody was seen twice: one sighting each says nothing."""
    return F.when((authors > 0) & (sightings > authors), round_up_half(sightings / authors))


def looks_like_tag_spam(mean_tags: Column) -> Column:
    return F.coalesce(mean_tags >= C.TAG_SPAM_MEAN_TAGS, F.lit(False))


def passes_promotion_gates(
    authors: Column,
    servers: Column,
    min_authors: int = C.MIN_AUTHORS,
    min_servers: int = C.MIN_ORIGIN_SERVERS,
    max_ratio: float = C.MAX_AUTHORS_PER_SERVER,
) -> Column:
    """The gates on the unrounded ratio."""
    spread = F.coalesce(F.try_divide(authors, servers) <= max_ratio, F.lit(False))
    return (authors >= min_authors) & (servers >= min_servers) & spread


def tier_seconds(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in C.TIER_SECONDS.items() for x in kv]), tier)


def tier_rank(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in C.TIER_RANK.items() for x in kv]), tier)


def effective_interval(tier: Column, cron_seconds: int = C.CRON_SECONDS) -> Column:
    return F.greatest(tier_seconds(tier), F.lit(max(1, cron_seconds)))


def tracking_state(tracked: Column, retired_at: Column) -> Column:
    return F.when(tracked, "tracked").when(retired_at.isNotNull(), "retired").otherwise("queued")


def window_direction(post_trend: Column, comparable: Column) -> Column:
    """The lookup variant on post counts: a change of exactly the band is flat."""
    return (
        F.when(~comparable, "not_comparable")
        .when(post_trend.isNull(), "insufficient")
        .when(post_trend > C.FLAT_BAND, "up")
        .when(post_trend < -C.FLAT_BAND, "down")
        .otherwise("flat")
    )


def lookup_status(posts_24h: Column) -> Column:
    return F.when(posts_24h > 0, "ok").otherwise("insufficient_data")


def lookup_reason(posts_24h: Column, tracked: Column, newly_registered: Column) -> Column:
    return (
        F.when(posts_24h > 0, F.lit(None).cast("string"))
        .when(tracked & newly_registered, "just_registered")
        .when(tracked, "nothing_observed")
        .otherwise("no_capacity")
    )


def lookup_remedy(posts_24h: Column, tracked: Column) -> Column:
    return (
        F.when(posts_24h > 0, F.lit(None).cast("string"))
        .when(tracked, "ask_after_next_collection")
        .otherwise("wait_for_free_slot")
    )


def reading_shape(
    standing: Column, authors: Column, per_server: Column, per_author: Column
) -> Column:
    """What kind of use the figures describe."""
    return (
        F.when(standing == "unseen", "no_evidence")
        .when(F.coalesce(authors, F.lit(0)) == 0, "known_but_silent")
        .when(per_server > C.MAX_AUTHORS_PER_SERVER, "publisher")
        .when((authors < C.FEW_AUTHORS) & (per_author >= C.REPETITIVE_POSTS_PER_AUTHOR), "few_repeating")
        .otherwise("many_accounts")
    )


def reading_spread(shape: Column, servers: Column) -> Column:
    silent = shape.isin("no_evidence", "known_but_silent")
    return F.when(~silent, F.when(F.coalesce(servers, F.lit(0)) <= 1, "one_server").otherwise("several_servers"))


def reading_recency(shape: Column, authors_1h: Column) -> Column:
    silent = shape.isin("no_evidence", "known_but_silent")
    return F.when(
        ~silent & authors_1h.isNotNull(), F.when(authors_1h > 0, "active_last_hour").otherwise("quiet_last_hour")
    )


def reading_text(shape: Column, authors: Column, servers: Column, per_server: Column, per_author: Column) -> Column:
    """A short sentence in this project's own words."""
    return (
        F.when(shape == "no_evidence", "Nothing known about this tag.")
        .when(shape == "known_but_silent", "Known, but silent for the past day.")
        .when(
            shape == "publisher",
            F.format_string("%d accounts on %d servers in a day (%.1f per server): concentrated like a feed.",
                            authors, servers, per_server),
        )
        .when(
            shape == "few_repeating",
            F.format_string("%d accounts in a day, each posting often (%.1f posts).", authors, per_author),
        )
        .otherwise(F.format_string("%d different accounts on %d servers in a day.", authors, servers))
    )
