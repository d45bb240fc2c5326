"""Per-tag activity tables that keep silent tags, and the hourly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagtide import constants as C
from tagtide.operators.ranking import top_rows_per_group
from tagtide.operators.windows import between, originals, zero_filled


def active_tags(tags: DataFrame) -> DataFrame:
    """The tags being polled."""
    return tags.filter(F.col("tracked") & ~F.col("blocked"))


def _by_author_and_origin(rows: DataFrame, **figures) -> DataFrame:
    """Sums of figures for each (tag, author) and, as rows of their own, each (tag, origin), from one reading.

    Posts are first reduced to (tag, author, origin); only these rows are set out
    twice, so a dominant tag is spread over its authors and posts are read once.
    """
    names = list(figures)
    reduced = rows.groupBy("tag_id", "author_hash", "origin_host").agg(*(column.alias(name) for name, column in figures.items()))
    sides = F.array(
        F.struct(F.lit(True).alias("is_author"), F.col("author_hash").alias("key"), *names),
        F.struct(F.lit(False).alias("is_author"), F.col("origin_host").cast("binary").alias("key"), *names),
    )
    return (
        reduced.select("tag_id", F.explode(sides).alias("s")).select("tag_id", "s.*")
        .groupBy("tag_id", "is_author", "key").agg(*(F.sum(name).alias(name) for name in names))
    )


def _authors(condition=None):
    kept = F.col("is_author") if condition is None else F.col("is_author") & condition
    return F.count_if(kept)


def _of_authors(name: str):
    return F.coalesce(F.sum(F.when(F.col("is_author"), F.col(name))), F.lit(0))


def tag_overview(observed: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """Day and hour figures of every tracked tag."""
    day, hour, before = now - C.DAY, now - C.HOUR, now - 2 * C.HOUR
    created = F.col("created_at")
    sides = _by_author_and_origin(
        originals(observed, day), _posts=F.count("*"), _last=F.count_if(created >= hour),
        _prev=F.count_if((created >= before) & (created < hour)))
    figures = sides.groupBy("tag_id").agg(
        _of_authors("_posts").alias("posts_24h"), _authors().alias("authors_24h"), _of_authors("_last").alias("posts_1h"),
        _authors(F.col("_last") > 0).alias("authors_1h"), _authors(F.col("_prev") > 0).alias("authors_prev_1h"),
        F.count_if(~F.col("is_author")).alias("origin_servers_24h"),
    )
    kept = active_tags(tags).select("id", "name", "display", "tier", "first_seen_at", "last_query_at")
    return zero_filled(kept, figures)


def tag_overview_expanded(observed: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """The same table from one aggregation with several distinct counts, kept to compare plans."""
    hour, before = now - C.HOUR, now - 2 * C.HOUR
    created, author = F.col("created_at"), F.col("author_hash")
    figures = originals(observed, now - C.DAY).groupBy("tag_id").agg(
        F.count("*").alias("posts_24h"), F.countDistinct(author).alias("authors_24h"),
        F.count_if(created >= hour).alias("posts_1h"),
        F.countDistinct(F.when(created >= hour, author)).alias("authors_1h"),
        F.countDistinct(F.when((created >= before) & (created < hour), author)).alias("authors_prev_1h"),
        F.countDistinct("origin_host").alias("origin_servers_24h"),
    )
    kept = active_tags(tags).select("id", "name", "display", "tier", "first_seen_at", "last_query_at")
    return zero_filled(kept, figures)


def tracked_breadth(observed: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    figures = _by_author_and_origin(originals(observed, now - C.DAY), _posts=F.count("*")).groupBy("tag_id").agg(
        _of_authors("_posts").alias("posts_24h"), _authors().alias("authors_24h"),
        F.count_if(~F.col("is_author")).alias("origin_servers_24h"))
    return zero_filled(active_tags(tags).select("id", "name", "last_query_at"), figures)


def tracked_for_retirement(observed: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """Day counts including boosts: any sign of life keeps a tag."""
    counts = between(observed, now - C.DAY).groupBy("tag_id").agg(F.count("*").alias("posts_24h"))
    return zero_filled(active_tags(tags).select("id", "name", "last_query_at", "first_seen_at"), counts)


def tracked_activity(observed: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """Everything the retirement rules ask, from one reading of the day.

    ``posts_any_24h`` includes boosts, the other figures are of originals.
    """
    sides = _by_author_and_origin(
        between(observed, now - C.DAY), _any=F.count("*"), _own=F.count_if(~F.col("is_boost")))
    figures = sides.groupBy("tag_id").agg(
        _of_authors("_any").alias("posts_any_24h"), _of_authors("_own").alias("posts_24h"),
        _authors(F.col("_own") > 0).alias("authors_24h"),
        F.count_if(~F.col("is_author") & (F.col("_own") > 0)).alias("origin_servers_24h"))
    kept = active_tags(tags).select("id", "name", "last_query_at", "first_seen_at")
    return zero_filled(kept, figures)


def posts_per_hour(observed: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """Originals of the last hour for every unblocked tag, polled or not."""
    counts = originals(observed, now - C.HOUR).groupBy("tag_id").agg(F.count("*").alias("posts_per_hour"))
    return zero_filled(tags.filter(~F.col("blocked")).select("id", "name"), counts)


def _hourly(rollups: DataFrame, tags: DataFrame, bucket) -> DataFrame:
    hours = [F.coalesce(F.sum(F.when(bucket == i, F.col("posts"))), F.lit(0)).alias(f"h{i}") for i in range(24)]
    sums = rollups.groupBy("tag_id").agg(*hours)
    filled = zero_filled(tags.select("id", "name"), sums)
    return filled.select("id", "name", F.array(*[F.col(f"h{i}") for i in range(24)]).alias("hourly"))


def hourly_posts(rollups: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """24 clock-aligned hourly counts per tag, oldest first."""
    first = now // C.HOUR - 23
    rows = rollups.filter(F.col("minute") >= first * 60)
    return _hourly(rows, tags, F.floor(F.col("minute") / 60) - first)


def hourly_by_age(rollups: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """24 hourly counts per tag cut backwards from ``now``, oldest first."""
    minute = now // 60
    rows = rollups.filter((F.col("minute") > minute - 24 * 60) & (F.col("minute") <= minute))
    return _hourly(rows, tags, 23 - F.floor((F.lit(minute) - F.col("minute")) / 60))


def representative_posts(observed: DataFrame, since: int, limit: int = 10) -> DataFrame:
    """The newest linkable, non-sensitive originals of each tag."""
    rows = originals(observed, since).filter(~F.col("sensitive") & F.col("url").isNotNull())
    rows = rows.select("tag_id", "uri", "url", "created_at", "origin_host", "seen_mask")
    return top_rows_per_group(rows, ["tag_id"], [F.desc("created_at"), F.asc("uri")], limit)
