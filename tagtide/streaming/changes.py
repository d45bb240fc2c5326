"""Change tables: what each micro-batch wrote, folded on reading, and their upkeep.

A table is the folder of its batches plus at most one *base*, the fold of all
batches up to its number. A batch that runs again overwrites its own folder. A
base counts once it is wholly written; the batches it holds go afterwards, so
reading is right whenever a run stops. Rows with a time lie by day, and windows
read their days only.

Removals are tombstones: an author's posts are gone from every batch, an origin's
from the batches up to a number. Every fold leaves them out and every base is
written without them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagtide import constants as C, schemas
from tagtide.operators import ingest
from tagtide.sources import tables
from tagtide.sources.raw import QUARANTINE

#: The time that a table's rows are laid out and expire by, in seconds, and how long they stay.
CLOCKS: dict[str, tuple[str, int]] = {
    "observation": ("created_at", C.OBSERVATION_HOURS * C.HOUR),
    "tag_candidate": ("first_seen", C.POOL_HOURS * C.HOUR),
    "poll_log": ("at", C.POLL_LOG_DAYS * C.DAY),
    "tag_minute": ("minute", C.ROLLUP_DAYS * C.DAY),
    "post_index": ("created_at", C.OBSERVATION_HOURS * C.HOUR),
}
#: Notes of single batches that nothing reads once the batch is folded.
BY_BATCH = ("touched_minute", "skip_count", "tag_version")
SCHEMAS = {
    "observation": schemas.OBSERVATION, "tag_candidate": schemas.TAG_CANDIDATE, "poll_log": schemas.POLL_LOG,
    "tag_minute": schemas.TAG_MINUTE, "post_index": "tag_id BIGINT, uri STRING, created_at BIGINT, bucket INT",
    "touched_minute": "tag_id BIGINT, minute BIGINT",
    "skip_count": "posts BIGINT, non_public BIGINT, malformed BIGINT, suppressed BIGINT",
    "tombstone": "author_hash BINARY, origin_host STRING, upto BIGINT", "quarantine": QUARANTINE,
    "new_authors": "tag_id BIGINT, start BIGINT, end BIGINT, authors BIGINT", "tag": schemas.TAG, "tag_version": "version BIGINT",
}


def clock(table: str) -> Column:
    """A row's time in seconds."""
    column = F.col(CLOCKS[table][0])
    return column * 60 if table == "tag_minute" else column


def write_change(change: DataFrame, root: str, table: str, batch_id: int) -> None:
    """Writes a batch's own folder; rows of timed tables lie in it by day, so that windows and expiry prune."""
    _write(change, f"{root}/{table}/batch={batch_id}", table)


def write_base(rows: DataFrame, root: str, table: str, upto: int) -> None:
    """Writes a folded table in the place of all its batches up to a number."""
    _write(rows, f"{root}/{table}.base/batch={upto}", table)


def _write(change: DataFrame, folder: str, table: str) -> None:
    writer = change.write
    if table == "post_index":
        writer = tables.with_bucket(change).repartitionByRange("bucket").sortWithinPartitions("bucket").write
    elif table in CLOCKS:
        writer = change.withColumn("created_date", F.to_date(F.timestamp_seconds(clock(table)))).write.partitionBy("created_date")
    # The whole folder is replaced, whatever the session's mode of overwriting partitions is.
    writer.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The batches that are wholly written in a folder."""
    files, at = tables._files(spark, folder)
    if not files.exists(at):
        return []
    names = [s.getPath() for s in files.listStatus(at) if s.getPath().getName().startswith("batch=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n.getName().split("=")[1]) for n in names if files.exists(done(n, "_SUCCESS")))


def newest_base(spark: SparkSession, root: str, table: str, before: int | None = None) -> int | None:
    found = [n for n in _numbers(spark, f"{root}/{table}.base") if before is None or n < before]
    return found[-1] if found else None


def read_batch(spark: SparkSession, root: str, table: str, batch_id: int, *more: str) -> DataFrame:
    """What one batch wrote, with ``more`` columns than the table keeps."""
    return spark.read.schema(", ".join([SCHEMAS[table], *more])).parquet(f"{root}/{table}/batch={batch_id}")


def read_changes(spark: SparkSession, root: str, table: str, before: int | None = None) -> DataFrame:
    """A table's changes with their ``batch``: the newest base and the batches after it, those below ``before`` if given."""
    base = newest_base(spark, root, table, before)
    after = [n for n in _numbers(spark, f"{root}/{table}") if (base is None or n > base) and (before is None or n < before)]
    day = ", created_date DATE" if table in CLOCKS and table != "post_index" else ""
    schema = f"{SCHEMAS.get(table)}{day}, batch BIGINT"
    reader = spark.read.schema(schema) if table in SCHEMAS else spark.read.option("mergeSchema", "true")
    parts = []
    if base is not None:
        parts.append(reader.option("basePath", f"{root}/{table}.base").parquet(f"{root}/{table}.base/batch={base}"))
    if after:
        parts.append(reader.option("basePath", f"{root}/{table}").parquet(*(f"{root}/{table}/batch={n}" for n in after)))
    if not parts:
        if table not in SCHEMAS:
            raise FileNotFoundError(f"{root}/{table} holds no finished batch")
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


# -- folds -------------------------------------------------------------------


def entomb(spark: SparkSession, root: str, gone: DataFrame, run: int | None = None) -> None:
    """Removes posts for good: ``gone`` has (author_hash, origin_host, upto) with either of the first two.

    ``upto`` is the last batch it holds for; null holds for all, those to come as well.
    A ``run`` that is repeated overwrites its own tombstones; else the next number is taken.
    """
    run = _next_run(spark, root) if run is None else run
    write_change(gone.select("author_hash", "origin_host", F.col("upto").cast("bigint").alias("upto")), root, "tombstone", run)


def tombstones_of(hashes: DataFrame) -> DataFrame:
    """Tombstones of suppressed authors."""
    return hashes.select("author_hash", F.lit(None).cast("string").alias("origin_host"), F.lit(None).cast("bigint").alias("upto"))


def tombstones_of_origins(registry: DataFrame, upto: int) -> DataFrame:
    """Tombstones of the servers that opted out, for what is stored up to a batch."""
    return registry.filter("opt_out").select(
        F.lit(None).cast("binary").alias("author_hash"), F.col("host").alias("origin_host"), F.lit(upto).cast("bigint").alias("upto"))


def current_tombstones(spark: SparkSession, root: str) -> DataFrame | None:
    """All tombstones, or None where nothing was ever removed."""
    if newest_base(spark, root, "tombstone") is None and not _numbers(spark, f"{root}/tombstone"):
        return None
    return read_changes(spark, root, "tombstone").drop("batch").distinct()


def standing(posts: DataFrame, root: str) -> DataFrame:
    """Changes of posts without those that a tombstone covers."""
    graves = current_tombstones(posts.sparkSession, root)
    if graves is None:
        return posts
    authors = graves.filter("author_hash IS NOT NULL").select("author_hash").distinct()
    origins = graves.filter("origin_host IS NOT NULL").groupBy("origin_host").agg(
        F.max(F.coalesce("upto", F.lit((1 << 63) - 1))).alias("_upto"))
    kept = posts.join(authors, "author_hash", "left_anti")
    kept = kept.join(origins, "origin_host", "left")
    return kept.filter(F.col("_upto").isNull() | (F.col("batch") > F.col("_upto"))).select(*posts.columns)


def current_observations(
    spark: SparkSession, root: str, since: int | None = None, before: int | None = None, days: list | None = None
) -> DataFrame:
    """The stored observations: all changes folded, the earliest view's attributes kept.

    ``since`` leaves out posts created before, ``days`` those of other days; their
    folders are not read. All views of a post lie in its day, so a day folds alone.
    """
    changes = read_changes(spark, root, "observation", before)
    if since is not None:
        changes = changes.filter((F.col("created_date") >= F.to_date(F.timestamp_seconds(F.lit(since)))) & (F.col("created_at") >= since))
    if days is not None:
        changes = changes.filter(F.col("created_date").isin(days))
    changes = standing(changes.drop("created_date"), root).withColumnRenamed("seen_mask", "mask")
    return ingest.merge_sightings(changes, ["batch", "observed_at"])


def current_candidates(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The pool: each batch adds one sighting to its (name, author) pairs, a base as many as it folded."""
    changes = read_changes(spark, root, "tag_candidate", before)
    detail = F.struct("first_seen", "origin_host", "tags_on_post")
    return changes.groupBy("name", "author_hash").agg(
        F.min_by(detail, "batch").alias("_kept"), F.sum("posts_seen").alias("posts_seen")
    ).select("name", "author_hash", "_kept.*", "posts_seen")


def current_rollups(spark: SparkSession, root: str, before: int | None = None, days: list | None = None) -> DataFrame:
    """The stored minutes: the newest count, and the highest number of servers that ever reported."""
    changes = read_changes(spark, root, "tag_minute", before)
    if days is not None:
        changes = changes.filter(F.col("created_date").isin(days))
    return changes.groupBy("tag_id", "minute").agg(
        F.max_by("posts", "batch").alias("posts"), F.max("instances_reporting").alias("instances_reporting"))


def current_poll_log(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    return read_changes(spark, root, "poll_log", before).drop("batch", "created_date")


def current_index(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(tag_id, uri, created_at, bucket) of every post, as its first batch gave it."""
    changes = read_changes(spark, root, "post_index", before)
    return changes.groupBy("bucket", "tag_id", "uri").agg(F.min_by("created_at", "batch").alias("created_at"))


FOLDS: dict[str, Callable[..., DataFrame]] = {
    "observation": current_observations, "tag_candidate": current_candidates, "poll_log": current_poll_log,
    "tag_minute": current_rollups, "post_index": current_index,
}


def settled_times(spark: SparkSession, posts: DataFrame, root: str, before: int) -> DataFrame:
    """A batch's posts with the time of creation that the store holds for those it knows.

    Only row groups with the batch's own buckets of the index are read.
    """
    keyed = tables.with_bucket(posts)
    buckets = [row["bucket"] for row in keyed.select("bucket").distinct().collect()]  # INDEX_BUCKETS at most
    changes = read_changes(spark, root, "post_index", before).filter(F.col("bucket").isin(buckets))
    known = changes.join(keyed.select("bucket", "tag_id", "uri"), ["bucket", "tag_id", "uri"], "left_semi").groupBy("tag_id", "uri").agg(
        F.min_by("created_at", "batch").alias("_known"))
    return posts.join(known, ["tag_id", "uri"], "left").withColumn("created_at", F.coalesce("_known", "created_at"))


# -- versions of the tag table -----------------------------------------------


def publish_tags(spark: SparkSession, root: str, tags: DataFrame) -> int:
    """Stores a new version of the tag table; batches that start from now on use it."""
    version = 1 + max([-1, *_numbers(spark, f"{root}/tag")])
    columns = [c.split()[0] for c in schemas.TAG.split(", ")]
    write_change(tags.select(*(c for c in columns if c in tags.columns)), root, "tag", version)
    return version


def tags_of_batch(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The tag table as a batch first saw it: the newest version then, noted for when the batch runs again."""
    if batch_id not in _numbers(spark, f"{root}/tag_version"):
        versions = _numbers(spark, f"{root}/tag")
        if not versions:
            raise FileNotFoundError(f"{root}/tag holds no version of the tag table")
        write_change(spark.createDataFrame([(versions[-1],)], SCHEMAS["tag_version"]), root, "tag_version", batch_id)
    version = read_batch(spark, root, "tag_version", batch_id).first()["version"]
    return read_batch(spark, root, "tag", version)


# -- upkeep ------------------------------------------------------------------


def consolidate(spark: SparkSession, root: str, table: str, upto: int, since: int | None = None) -> int:
    """Writes the fold of all batches up to ``upto`` as the table's base, removes what it replaces, and returns its rows.

    ``since`` leaves out rows older than that time. Batches up to ``upto`` must be
    finished: a stream may consolidate up to the one before the batch it is at. A
    base of that number is not written again.
    """
    base = newest_base(spark, root, table)
    if base is not None and base > upto:
        raise ValueError(f"{table} is already folded up to batch {base}")
    if base != upto:
        rows = FOLDS[table](spark, root, before=upto + 1)
        if since is not None:
            rows = rows.filter(clock(table) >= since)
        write_base(rows.select(*(c for c in rows.columns if c != "bucket")), root, table, upto)
    drop_superseded(spark, root, table)
    return read_changes(spark, root, table, before=upto + 1).count()


def drop_superseded(spark: SparkSession, root: str, table: str) -> None:
    """Removes the batches and bases that the newest base holds."""
    base = newest_base(spark, root, table)
    if base is None:
        return
    for folder in (f"{root}/{table}", f"{root}/{table}.base"):
        files, at = tables._files(spark, folder)
        if files.exists(at):
            for name in [s.getPath().getName() for s in files.listStatus(at)]:
                if name.startswith("batch="):
                    number = int(name.split("=")[1])
                    if number < base or (number == base and folder.endswith(table)):
                        tables._remove(spark, f"{folder}/{name}")


def retain(spark: SparkSession, root: str, now: int, upto: int, registry: DataFrame | None = None) -> dict[str, int]:
    """The retention run over all stored tables; returns the rows each has left.

    Posts of servers that opted out get a tombstone. Every table is folded up to
    ``upto`` without the rows past their time. Tombstones that the new base has
    burnt in go; those of authors stay, for the batches to come.
    """
    if registry is not None:
        entomb(spark, root, tombstones_of_origins(registry, upto), _next_run(spark, root))
    left = {}
    for table, (_, seconds) in CLOCKS.items():
        if newest_base(spark, root, table) is not None or _numbers(spark, f"{root}/{table}"):
            left[table] = consolidate(spark, root, table, upto, now - seconds)
    for table in BY_BATCH:
        for number in _numbers(spark, f"{root}/{table}"):
            if number <= upto:
                tables._remove(spark, f"{root}/{table}/batch={number}")
    versions = _numbers(spark, f"{root}/tag")
    noted = [read_batch(spark, root, "tag_version", n).first()["version"] for n in _numbers(spark, f"{root}/tag_version")]
    for version in versions:
        if version < min([versions[-1], *noted]):
            tables._remove(spark, f"{root}/tag/batch={version}")
    graves = current_tombstones(spark, root)
    if graves is not None:
        run = _next_run(spark, root)
        write_base(graves.filter(F.col("upto").isNull() | (F.col("upto") > upto)), root, "tombstone", run)
        drop_superseded(spark, root, "tombstone")
    return left


def _next_run(spark: SparkSession, root: str) -> int:
    return 1 + max([-1, *_numbers(spark, f"{root}/tombstone"), *_numbers(spark, f"{root}/tombstone.base")])
