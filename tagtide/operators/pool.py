"""The discovery pool: names seen beside tracked tags, by distinct author."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagtide import constants as C
from tagtide.functions.numbers import round_up_half
from tagtide.functions.ratings import sightings_per_author
from tagtide.operators.ranking import top_rows


def known_names(tags: DataFrame) -> DataFrame:
    return tags.filter(F.col("tracked") | F.col("blocked")).select("name")


def _reduce_by_origin(pool: DataFrame) -> DataFrame:
    """Partial figures per (name, origin), so a name holding most of the pool is spread out."""
    return pool.groupBy("name", "origin_host").agg(
        F.count("*").alias("_authors"), F.sum("posts_seen").alias("_sightings"),
        F.sum("tags_on_post").alias("_tags"), F.count("tags_on_post").alias("_tagged"),
        F.min("first_seen").alias("_first"),
    )


def candidate_figures(pool: DataFrame) -> DataFrame:
    """Authors, servers, sightings, mean tags and first sighting per name.

    The pool holds one row per (name, author), so the author count is a row count.
    """
    mean_tags = F.when(F.sum("_tagged") > 0, round_up_half(F.sum("_tags") / F.sum("_tagged")))
    return _reduce_by_origin(pool).groupBy("name").agg(
        F.sum("_authors").alias("distinct_authors"),
        F.count("origin_host").alias("distinct_origin_servers"),
        sightings_per_author(F.sum("_sightings"), F.sum("_authors")).alias("posts_per_author"),
        mean_tags.alias("mean_tags_per_post"),
        F.min("_first").alias("first_seen"),
    )


def load_candidates(
    pool: DataFrame, tags: DataFrame, since: int, min_authors: int = C.MIN_AUTHORS,
    limit: int | None = C.CANDIDATE_LIMIT,
) -> DataFrame:
    """The leading candidates, or all of them, without a rank, where there is no limit.

    Known names leave before the cut, so they cannot crowd it.
    """
    rows = pool.filter(F.col("first_seen") >= since).join(known_names(tags), "name", "left_anti")
    figures = candidate_figures(rows).filter(F.col("distinct_authors") >= min_authors)
    order = [F.desc("distinct_origin_servers"), F.desc("distinct_authors"), F.asc("name")]
    return figures if limit is None else top_rows(figures, order, limit)


def candidate_stats(pool: DataFrame, names: DataFrame, since: int) -> DataFrame:
    """The same figures for a table of names, tracked or not."""
    rows = pool.filter(F.col("first_seen") >= since).join(names.select("name").distinct(), "name", "left_semi")
    return candidate_figures(rows)


def discovery_stats(pool: DataFrame, tags: DataFrame, now: int) -> DataFrame:
    """One row on the health of the pool and of the tracked set."""
    rows = pool.filter(F.col("first_seen") >= now - C.POOL_HOURS * C.HOUR)
    sizes = rows.groupBy("name").agg(F.count("*").alias("_authors"))
    whole = sizes.agg(F.count("*").alias("pool_names"), F.coalesce(F.sum("_authors"), F.lit(0)).alias("pool_rows"))
    fresh = sizes.join(known_names(tags), "name", "left_anti").agg(F.struct(
        F.coalesce(F.max("_authors"), F.lit(0)).alias("strongest"),
        F.count_if(F.col("_authors") >= C.MIN_AUTHORS).alias("ready"),
    )).scalar()
    untracked = ~F.col("tracked")
    counts = tags.filter(~F.col("blocked")).agg(F.struct(
        F.count_if("tracked").alias("tracked"),
        F.count_if(untracked & F.col("retired_at").isNotNull()).alias("retired"),
        F.count_if(untracked & F.col("retired_at").isNull()).alias("queued"),
    )).scalar()
    return whole.select(
        "pool_names", "pool_rows", fresh["strongest"].alias("strongest_authors"),
        fresh["ready"].alias("ready_to_promote"), counts["tracked"].alias("tracked_count"),
        counts["retired"].alias("retired_count"), counts["queued"].alias("queued_count"),
    )
