"""Ranking, promotion, retirement and tier decisions over per-tag tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtide import constants as C
from tagtide.functions.ratings import direction, passes_promotion_gates
from tagtide.functions.numbers import round_up_half
from tagtide.operators.overview import active_tags
from tagtide.operators.ranking import global_rank, top_rows

_ORDERS = {
    "authors": [F.desc, "authors_24h", F.desc, "posts_24h", F.asc, "name"],
    "posts": [F.desc, "posts_24h", F.asc, "name"],
    "name": [F.asc, "name"],
}


def scan_tracked_tags(tags: DataFrame) -> DataFrame:
    return active_tags(tags).orderBy("id")


def find_tags(tags: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of the named tags; names are casefolded already."""
    return tags.join(names.select("name").distinct(), "name", "left_semi")


def count_tracked(tags: DataFrame) -> DataFrame:
    return active_tags(tags).agg(F.count("*").alias("tracked"))


def queried_untracked(tags: DataFrame, since: int, limit: int = C.QUEUE_LIMIT) -> DataFrame:
    rows = tags.filter(~F.col("tracked") & ~F.col("blocked") & (F.col("last_query_at") >= since))
    rows = rows.select("name", "last_query_at", "query_count")
    return top_rows(rows, [F.desc("last_query_at"), F.desc("query_count"), F.asc("name")], limit)


def rank_tags(overview: DataFrame, order: str = "authors", limit: int | None = None) -> DataFrame:
    """Numbers the tags in the chosen order; an unknown order means authors.

    Without a limit every tag is numbered, by a distributed rank.
    """
    spec = _ORDERS.get(order, _ORDERS["authors"])
    cols = [spec[i](spec[i + 1]) for i in range(0, len(spec), 2)]
    return global_rank(overview, cols) if limit is None else top_rows(overview, cols, limit)


def select_promotions(
    candidates: DataFrame, slots: Column, max_tracked: int = C.MAX_TRACKED, blocked: DataFrame | None = None,
    min_authors: int = C.MIN_AUTHORS, min_servers: int = C.MIN_ORIGIN_SERVERS,
    max_ratio: float = C.MAX_AUTHORS_PER_SERVER,
) -> DataFrame:
    """Candidates passing the gates, broadest first, as many as there are slots.

    ``slots`` never exceeds ``max_tracked``, so the cut at ``max_tracked`` comes first.
    """
    gates = passes_promotion_gates(
        F.col("distinct_authors"), F.col("distinct_origin_servers"), min_authors, min_servers, max_ratio
    )
    rows = candidates.drop("rank").filter(gates)
    if blocked is not None:
        rows = rows.join(blocked.select("name"), "name", "left_anti")
    order = [F.desc("distinct_origin_servers"), F.desc("distinct_authors"), F.asc("name")]
    return top_rows(rows, order, max_tracked).filter(F.col("rank") <= slots)


def select_promotions_with_queried(
    queried: DataFrame, candidates: DataFrame, tracked_count: Column, max_tracked: int = C.MAX_TRACKED,
    blocked: DataFrame | None = None,
) -> DataFrame:
    """Requested tags first, then the pool; a name in both takes one slot.

    The pool is cut to the slots left over before names already taken are
    removed, so such a name can leave a slot unused.
    """
    slots = F.greatest(F.lit(0), F.lit(max_tracked) - tracked_count)
    wanted = queried.drop("rank")
    if blocked is not None:
        wanted = wanted.join(blocked.select("name"), "name", "left_anti")
    order = [F.desc("last_query_at"), F.desc("query_count"), F.asc("name")]
    wanted = wanted.groupBy("name").agg(
        F.max("last_query_at").alias("last_query_at"), F.max("query_count").alias("query_count")
    )
    wanted = top_rows(wanted, order, max_tracked).filter(F.col("rank") <= slots)
    taken = wanted.agg(F.count("*")).scalar()
    pool = select_promotions(candidates, slots - taken, max_tracked, blocked)
    pool = pool.join(wanted.select("name"), "name", "left_anti")
    return wanted.select("name", F.lit("requested").alias("source"), "rank").unionByName(
        pool.select("name", F.lit("discovered").alias("source"), "rank")
    )


def _not_asked_since(now: int, seconds: int) -> Column:
    return F.col("last_query_at").isNull() | (F.lit(now) - F.col("last_query_at") >= seconds)


def select_quiet_retirements(
    tracked: DataFrame, now: int, quiet: int = C.QUIET_SECONDS, grace: int = C.GRACE_SECONDS
) -> DataFrame:
    past_grace = F.lit(now) - F.col("first_seen_at") >= grace
    return tracked.filter(past_grace & (F.col("posts_24h") == 0) & _not_asked_since(now, quiet))


def select_non_community_retirements(
    breadth: DataFrame, now: int, min_servers: int = C.MIN_ORIGIN_SERVERS,
    max_ratio: float = C.MAX_AUTHORS_PER_SERVER, min_posts: int = C.MIN_POSTS_TO_JUDGE,
    protect: int = C.QUERY_PROTECTION_SECONDS,
) -> DataFrame:
    servers, authors = F.col("origin_servers_24h"), F.col("authors_24h")
    narrow = (servers < min_servers) | F.coalesce(F.try_divide(authors, servers) > max_ratio, F.lit(False))
    return breadth.filter((F.col("posts_24h") >= min_posts) & narrow & _not_asked_since(now, protect))


def select_excess_retirements(
    tracked: DataFrame, now: int, max_tracked: int = C.MAX_TRACKED, protect: int = C.QUERY_PROTECTION_SECONDS
) -> DataFrame:
    """The quietest unprotected tags beyond the ceiling.

    What stays is at most ``max_tracked`` tags, so those are picked from the
    loud end and everything else goes; the overflow itself may be any size.
    """
    ceiling = max(0, max_tracked)
    free = tracked.filter(_not_asked_since(now, protect))
    sizes = tracked.agg(F.struct(F.count("*").alias("all"), F.count_if(_not_asked_since(now, protect)).alias("free"))).scalar()
    overflow = F.greatest(F.lit(0), sizes["all"] - ceiling)
    keep = F.greatest(F.lit(0), sizes["free"] - overflow)
    if ceiling == 0:
        return free
    loud = top_rows(free.select("id", "name", "posts_24h"), [F.desc("posts_24h"), F.desc("name")], ceiling, "_loud")
    # With no overflow every tag stays, however many there are.
    kept = loud.filter(F.col("_loud") <= keep).select("id")
    return free.filter(overflow > 0).join(kept, "id", "left_anti")


def assign_tiers(
    rates: DataFrame, now: int, max_hot: int = C.MAX_HOT, max_warm: int = C.MAX_WARM,
    fresh: int = C.QUERY_FRESH_SECONDS,
) -> DataFrame:
    """Tier of each (id, posts_per_hour, last_query_at) row.

    Only the top ``max_hot + max_warm`` can leave the cold tier, so only they
    are ranked.
    """
    watched = F.col("last_query_at").isNotNull() & (F.lit(now) - F.col("last_query_at") <= fresh)
    scored = rates.withColumn("score", F.when(watched, F.lit(1_000_000)).otherwise(F.lit(0)) + F.col("posts_per_hour"))
    max_hot, max_warm = max(0, max_hot), max(0, max_warm)
    raised = top_rows(
        scored.filter(F.col("score") > 0).select("id", "score"), [F.desc("score"), F.asc("id")], max_hot + max_warm, "_place"
    ).select("id", F.when(F.col("_place") <= max_hot, "hot").otherwise("warm").alias("_raised"))
    return scored.join(raised, "id", "left").select(
        "id", "score", F.coalesce("_raised", F.lit("cold")).alias("tier")
    )


def retier(tags: DataFrame, rates: DataFrame, now: int, **limits) -> DataFrame:
    """Tracked tags whose tier changes."""
    tracked = active_tags(tags).select("id", "name", "tier", "last_query_at")
    hourly = tracked.join(rates.select("id", "posts_per_hour"), "id", "left").withColumn(
        "posts_per_hour", F.coalesce("posts_per_hour", F.lit(0))
    )
    tiers = assign_tiers(hourly, now, **limits).select("id", F.col("tier").alias("new_tier"))
    return tracked.join(tiers, "id").filter(F.col("tier") != F.col("new_tier")).select("id", "name", "tier", "new_tier")


def rank_trending(
    overview: DataFrame, comparable: Column, limit: int = C.TRENDING_DEFAULT, most: int | None = C.TRENDING_MAX
) -> DataFrame:
    """The busiest tags of the last hour by authors, each with a direction that may be withheld.

    ``limit`` is held to 1 at least and, as the published report does, to
    ``most`` at most; None lifts that.
    """
    bounded = max(1, int(limit) if most is None else min(most, int(limit)))
    order = [F.desc("authors_1h"), F.desc("origin_servers_24h"), F.asc("name")]
    top = top_rows(overview.filter(F.col("authors_1h") > 0), order, bounded)
    called = direction(F.col("authors_1h"), F.col("authors_prev_1h"), comparable)
    return top.withColumn("_d", called).select(
        "rank", "id", F.col("name").alias("tag"), F.coalesce("display", "name").alias("display"),
        "authors_1h", "posts_1h", "authors_24h", "origin_servers_24h",
        F.col("_d.direction").alias("direction"), F.col("authors_prev_1h").alias("authors_previous_1h"),
        round_up_half(F.col("_d.change"), 2).alias("change"), F.col("_d.reason").alias("reason"),
    )
