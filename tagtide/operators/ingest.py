"""From captured pages to normalised posts, sightings and merged observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtide.functions.arrays import unfold
from tagtide.functions.numbers import bit_mask
from tagtide.functions.text import author_hash, epoch_seconds, hash_hex, origin_host, tag_list

_ATTRIBUTES = [
    "url", "origin_host", "author_hash", "created_at", "observed_at", "is_boost", "sensitive", "language",
]


def unwrap_boosts(statuses: DataFrame, status: str = "status") -> DataFrame:
    """Adds ``post`` (the inner post of a boost, else the post itself) and ``is_boost``."""
    outer = F.col(status)
    fields = ["id", "uri", "url", "created_at", "visibility", "language", "sensitive", "account", "tags"]
    boosted = outer["reblog"].isNotNull()
    post = F.struct(*[F.when(boosted, outer["reblog"][f]).otherwise(outer[f]).alias(f) for f in fields])
    return statuses.withColumn("is_boost", boosted).withColumn("post", post)


def skip_reason(wrapper_visibility: Column) -> Column:
    """The first failed check of a post, in the order the checks run; NULL if it is kept."""
    post = F.col("post")
    private = ~post["visibility"].eqNullSafe(F.lit("public")) | (
        F.col("is_boost") & ~wrapper_visibility.eqNullSafe(F.lit("public"))
    )
    acct = post["account"]["acct"]
    return (
        F.when(post["uri"].isNull() | post["created_at"].isNull(), "malformed")
        .when(private, "non_public")
        .when(F.col("origin_host").isNull() | F.col("created_at").isNull(), "malformed")
        .when(acct.isNull() | (acct == ""), "malformed")
    )


def normalise(statuses: DataFrame, salt: str, suppressed: DataFrame | None = None) -> DataFrame:
    """Every status with its stored fields and a ``skip_reason``.

    ``suppressed`` holds an ``author_hash`` column; it is joined, not collected,
    so the list may grow. Other columns of the input (server, batch time, page,
    position) are kept.
    """
    carried = [c for c in statuses.columns if c != "status"]
    rows = unwrap_boosts(statuses)
    post = F.col("post")
    rows = rows.withColumn("origin_host", origin_host(post["uri"])).withColumn(
        "created_at", epoch_seconds(post["created_at"])
    )
    rows = rows.select(
        *carried,
        post["uri"].alias("uri"),
        post["url"].alias("url"),
        "origin_host",
        author_hash(post["account"]["acct"], salt).alias("author_hash"),
        "created_at",
        "is_boost",
        post["sensitive"].eqNullSafe(F.lit(True)).alias("sensitive"),
        post["language"].alias("language"),
        tag_list(post["tags"]).alias("tags"),
        skip_reason(F.col("status")["visibility"]).alias("skip_reason"),
    )
    return rows if suppressed is None else drop_suppressed(rows, suppressed)


def drop_suppressed(posts: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Marks posts of suppressed authors that no earlier check rejected.

    Posts without an author can match nothing; in a shuffle they are spread by their
    link instead of meeting in one place.
    """
    marks = suppressed.filter(F.col("author_hash").isNotNull()).select(F.col("author_hash").alias("_gone")).distinct().withColumn(
        "_suppressed", F.lit(True))
    elsewhere = F.concat(F.lit("without an author "), F.coalesce("uri", F.lit(""))).cast("binary")
    return (
        posts.withColumn("_key", F.coalesce("author_hash", elsewhere))
        .join(marks, F.col("_key") == F.col("_gone"), "left")
        .withColumn("skip_reason", F.coalesce("skip_reason", F.when(F.col("_suppressed"), "suppressed")))
        .select(*posts.columns)
    )


def kept_posts(normalised: DataFrame) -> DataFrame:
    return normalised.filter(F.col("skip_reason").isNull()).drop("skip_reason")


def skip_counts(normalised: DataFrame, keys: list[str] | None = None) -> DataFrame:
    counts = [
        F.count_if(F.col("skip_reason").isNull()).alias("posts"),
        *[F.count_if(F.col("skip_reason") == r).alias(r) for r in ("non_public", "malformed", "suppressed")],
    ]
    return normalised.groupBy(*(keys or [])).agg(*counts)


def tag_sightings(posts: DataFrame) -> DataFrame:
    """One row per post view and tag, with how many tags the post carried."""
    return unfold(posts.withColumn("tags_on_post", F.size("tags")), "tags", "name").drop("tags")


def match_tracked_tags(sightings: DataFrame, tags: DataFrame) -> DataFrame:
    """Credits each sighting to the tracked tag it names."""
    tracked = tags.filter(F.col("tracked") & ~F.col("blocked")).select(F.col("id").alias("tag_id"), "name")
    return sightings.join(tracked, "name")


def untracked_sightings(sightings: DataFrame, tags: DataFrame) -> DataFrame:
    """Sightings of names outside the tracked set: the raw material of discovery."""
    tracked = tags.filter(F.col("tracked") & ~F.col("blocked")).select("name")
    return sightings.join(tracked, "name", "left_anti")


def attach_mask(sightings: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds the reporting server's one-bit mask, 0 for a server without a bit."""
    bits = registry.select("host", "bit")
    return sightings.join(bits, "host", "left").withColumn("mask", bit_mask(F.col("bit"))).drop("bit")


def combine_views(posts: DataFrame) -> DataFrame:
    """Posts whose views agree, once, with the union of their masks and the earliest sighting.

    Servers rarely differ about a post, so this hash aggregation leaves about one
    row per post before tags multiply the rows and the wide merge sorts them.
    """
    keys = ["uri", *[c for c in _ATTRIBUTES if c != "observed_at"], "tags"]
    return posts.groupBy(*keys).agg(F.min("observed_at").alias("observed_at"), F.bit_or("mask").alias("mask"))


def merge_sightings(sightings: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One observation per (tag, post): masks are OR-ed, the earliest view's attributes stay.

    Views of the same moment are told apart by ``order``, or else by their
    attributes, so the result does not depend on the order of arrival.
    """
    first = F.min_by(F.struct(*_ATTRIBUTES), F.struct(*(order or ["observed_at", *_ATTRIBUTES])))
    return (
        sightings.groupBy("tag_id", "uri")
        .agg(first.alias("_first"), F.bit_or("mask").alias("seen_mask"))
        .select("tag_id", "uri", "_first.*", "seen_mask")
    )


def observations(posts: DataFrame, tags: DataFrame, registry: DataFrame) -> DataFrame:
    """The write path of one batch: attach bits, combine equal views, credit tracked tags, merge."""
    views = combine_views(attach_mask(posts, registry))
    return merge_sightings(match_tracked_tags(tag_sightings(views), tags))


def touched_minutes(observed: DataFrame) -> DataFrame:
    """The (tag, minute) buckets a batch of originals falls in."""
    minute = F.floor(F.col("created_at") / 60).alias("minute")
    return observed.filter(~F.col("is_boost")).select("tag_id", minute).distinct()


def suppressed_hex(suppression: DataFrame) -> DataFrame:
    return suppression.select(hash_hex(F.col("author_hash")).alias("author_hex")).distinct()
