"""Structured Streaming forms of the series, the merges and the collection batch.

Two kinds of job stand side by side. Windowed aggregations keep their state in
Spark and finish a window once the watermark has passed it. The collection job
writes each micro-batch as its own folder of small change tables (``changes``). A
batch that runs again overwrites its own folder, so a lost executor or a restart
never counts anything twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tagtide import constants as C, schemas
from tagtide.functions.numbers import bit_mask
from tagtide.operators import health, ingest, merges
from tagtide.operators.windows import minute_rollup
from tagtide.session import fresh_folder
from tagtide.sources import raw, tables
from tagtide.streaming.changes import (  # noqa: F401  (the folds are read from here too)
    SCHEMAS, current_candidates, current_observations, current_poll_log, current_rollups, drop_superseded, entomb, publish_tags,
    read_batch, read_changes, retain, settled_times, tags_of_batch, tombstones_of, write_base, write_change,
)

CANDIDATE = ["name", "author_hash", "first_seen", "origin_host", "tags_on_post", "posts_seen"]
#: The figures of a batch's report.
TICK = ["posts_observed", "non_public", "malformed", "suppressed", "observations_written", "rollup_buckets", "candidates_seen",
        "candidates_written", "hosts_ok"]
WATERMARK = f"{C.OBSERVATION_HOURS} hours"


def with_event_time(posts: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Adds ``created_ts``; posts older than the watermark stop counting."""
    return posts.withColumn("created_ts", F.timestamp_seconds("created_at")).withWatermark("created_ts", watermark)


def stream_observations(sightings: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """(tag, post) rows whose mask widens as further servers report the post; update mode.

    A post's creation time is the post's own, equal in every view, so it can be
    part of the key and lets the state expire with the watermark.
    """
    attributes = ["url", "origin_host", "author_hash", "observed_at", "is_boost", "sensitive", "language"]
    first = F.min_by(F.struct(*attributes), F.struct("observed_at", "host", "seq"))
    return (
        with_event_time(sightings, watermark).groupBy("tag_id", "uri", "created_ts")
        .agg(first.alias("_first"), F.bit_or("mask").alias("seen_mask"))
        .select("tag_id", "uri", F.unix_seconds("created_ts").alias("created_at"), "_first.*", "seen_mask")
    )


def stream_minute_counts(sightings: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Distinct original posts per tag and minute, append mode.

    A post arrives once per reporting server, so it is first reduced to one row
    per (minute, tag, post); the count is a second stage on top.
    """
    rows = with_event_time(sightings.filter(~F.col("is_boost")), watermark)
    posts = rows.groupBy(F.window("created_ts", "1 minute"), "tag_id", "uri").agg(F.count("*").alias("views"))
    counts = posts.groupBy("window", "tag_id").agg(F.count("*").alias("posts"))
    return counts.select("tag_id", F.floor(F.unix_seconds("window.start") / 60).alias("minute"), "posts")


def stream_exact_authors(
    sightings: DataFrame, length: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Exact distinct authors of originals per tag and window, append mode.

    Streams refuse a distinct count; two chained aggregations give the same
    number and spread a dominant tag over its authors.
    """
    rows = with_event_time(sightings.filter(~F.col("is_boost")), watermark)
    window = F.window("created_ts", length, slide) if slide else F.window("created_ts", length)
    authors = rows.groupBy(window, "tag_id", "author_hash").agg(F.count("*").alias("views"))
    counts = authors.groupBy("window", "tag_id").agg(F.count("*").alias("authors"))
    return counts.select("tag_id", F.unix_seconds("window.start").alias("start"), F.unix_seconds("window.end").alias("end"), "authors")


def stream_new_authors(
    sightings: DataFrame, length: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Each author of originals once per tag and window, in the batch that first shows them; append mode.

    State is one entry for each (window, tag, author), so a dominant tag is spread
    over its authors, and goes when the watermark passes the window's end.
    """
    rows = with_event_time(sightings.filter(~F.col("is_boost")), watermark)
    window = F.window("created_ts", length, slide) if slide else F.window("created_ts", length)
    return rows.select(window.alias("window"), "tag_id", "author_hash").dropDuplicates(["window", "tag_id", "author_hash"])


def start_author_counts(sightings: DataFrame, root: str, checkpoint: str, **options) -> StreamingQuery:
    """Keeps the exact number of authors per tag and window up to date with every batch.

    A batch writes how many new authors it showed; ``current_authors`` adds them up.
    """
    def run(batch: DataFrame, i: int) -> None:
        counts = batch.groupBy("tag_id", F.unix_seconds("window.start").alias("start"), F.unix_seconds("window.end").alias("end")).agg(
            F.count("*").alias("authors"))
        write_change(counts, root, "new_authors", i)

    writer = stream_new_authors(sightings, **options).writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(availableNow=True).start()


def current_authors(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Exact authors per tag and window after all batches, or after those ``before`` one."""
    changes = read_changes(spark, root, "new_authors", before)
    return changes.groupBy("tag_id", "start", "end").agg(F.sum("authors").alias("authors"))


def late_rows(query: StreamingQuery) -> list[tuple[int, int]]:
    """(batch, rows that came behind the watermark and were left out) of a query's recent batches.

    Spark counts what reaches a stateful operator: views, where nothing is added up before it.
    """
    out = {}
    for progress in query.recentProgress:
        dropped = sum(state["numRowsDroppedByWatermark"] for state in progress["stateOperators"])
        out[progress["batchId"]] = max(dropped, out.get(progress["batchId"], 0))
    return sorted(out.items())


def credit_stream(posts: DataFrame, tags: DataFrame, registry: DataFrame) -> DataFrame:
    """Post views joined to the tracked tags and to the reporting server's bit."""
    rows = ingest.match_tracked_tags(ingest.tag_sightings(posts), tags)
    return rows.join(registry.select("host", "bit"), "host", "left").withColumn("mask", bit_mask(F.col("bit"))).drop("bit")


# -- change tables -----------------------------------------------------------


def compact(spark: SparkSession, root: str, table: str, fold: Callable[[SparkSession, str], DataFrame], into: str) -> None:
    """Writes the folded table as one batch of a new root, to be read from then on.

    It takes the number of the last batch it holds, so later batches follow it.
    """
    last = read_changes(spark, root, table).agg(F.max("batch")).first()[0]
    write_change(fold(spark, root), into, table, last or 0)


def collect_batch(
    batch: DataFrame, batch_id: int, root: str, tags: DataFrame | None, registry: DataFrame, salt: str,
    suppressed: DataFrame | None = None, candidate_limit: int | None = None, reporting: int | None = None,
) -> None:
    """One collection batch of post views, written as change tables, with its minutes recounted and its report.

    ``batch`` has normalised posts with ``skip_reason`` or captured pages with a
    ``body``; pages are parsed and normalised here. Every candidate is written
    unless the caller sets an allowance. ``reporting`` is the number of servers
    that answered; without it, those that showed a post count. Without ``tags``, the
    batch uses the published version of the tag table that was newest when it first
    ran. Lines and pages that can't be read are written to the quarantine.
    """
    spark = batch.sparkSession
    tags = tags_of_batch(spark, root, batch_id) if tags is None else tags
    # What feeds several writes is stored once, so they all see the same rows.
    captured, staged, credited = (fresh_folder(spark, purpose) for purpose in ("pages", "batch", "credited"))
    if "body" in batch.columns:
        batch.write.parquet(captured)
        batch = spark.read.schema(batch.schema).parquet(captured)
        write_change(raw.quarantined(batch), root, "quarantine", batch_id)
        batch = raw.sound_pages(batch)
        statuses = raw.parse_statuses(batch).withColumnRenamed("server", "host").withColumnRenamed("batch_at", "observed_at")
        batch = ingest.normalise(statuses, salt, suppressed).withColumn("seq", F.col("pos"))
    elif suppressed is not None:
        batch = ingest.drop_suppressed(batch, suppressed)
    reason = F.col("skip_reason")
    skips = [F.count_if(reason == r).alias(r) for r in ("non_public", "malformed", "suppressed")]
    counts = observed(batch, lambda rows: rows.write.parquet(staged), F.count_if(reason.isNull()).alias("posts_observed"), *skips)
    posts = spark.read.parquet(staged)
    kept = ingest.kept_posts(posts)
    ingest.observations(kept, tags, registry).write.parquet(credited)
    merged = settled_times(spark, spark.read.parquet(credited), root, batch_id).withColumn("is_new", F.col("_known").isNull())
    counts |= observed(merged.drop("_known"), lambda rows: write_change(rows, root, "observation", batch_id),
                       F.count(F.lit(1)).alias("observations_written"))
    own = read_batch(spark, root, "observation", batch_id, "is_new BOOLEAN")
    write_change(own.filter("is_new").select("tag_id", "uri", "created_at"), root, "post_index", batch_id)
    counts |= observed(ingest.touched_minutes(own), lambda rows: write_change(rows, root, "touched_minute", batch_id),
                       F.count(F.lit(1)).alias("rollup_buckets"))
    fresh = ingest.untracked_sightings(ingest.tag_sightings(kept), tags)
    pairs = _stamped(fresh) if candidate_limit is None else merges.cap_candidates(_stamped(fresh), candidate_limit)
    pairs = pairs.withColumn("posts_seen", F.lit(1).cast("bigint")).select(*CANDIDATE)
    counts |= observed(pairs, lambda rows: write_change(rows, root, "tag_candidate", batch_id), F.count(F.lit(1)).alias("candidates_written"))
    names = read_batch(spark, root, "tag_candidate", batch_id) if candidate_limit is None else fresh
    counts["candidates_seen"] = names.select("name").distinct().count()
    counts["hosts_ok"] = posts.select("host").distinct().count() if reporting is None else reporting
    skipped = tuple(counts[c] for c in ("posts_observed", "non_public", "malformed", "suppressed"))
    write_change(spark.createDataFrame([skipped], SCHEMAS["skip_count"]), root, "skip_count", batch_id)
    update_rollups(spark, root, batch_id, counts["hosts_ok"])
    columns = ", ".join(f"{c} BIGINT" for c in TICK)
    write_change(spark.createDataFrame([tuple(counts[c] for c in TICK)], columns), root, "tick_report", batch_id)
    for folder in (captured, staged, credited):
        tables._remove(spark, folder)


def observed(rows: DataFrame, write: Callable[[DataFrame], None], *figures: Column) -> dict[str, int]:
    """Writes rows and returns figures about them that are taken in the same pass."""
    figure = Observation()
    write(rows.observe(figure, *figures))
    return dict(figure.get)


def _stamped(sightings: DataFrame) -> DataFrame:
    rows = merges.candidate_batch(sightings, 0)
    latest = sightings.agg(F.max("observed_at")).scalar()
    return rows.withColumn("first_seen", latest.cast("bigint"))


def start_collection(
    pages: DataFrame, root: str, checkpoint: str, tags: DataFrame | None, registry: DataFrame, salt: str,
    suppressed: DataFrame | None = None, **options,
) -> StreamingQuery:
    """Runs ``collect_batch`` on every micro-batch of a page stream.

    Without ``tags``, each batch takes the newest version that ``publish_tags`` stored,
    so a promoted tag is collected from the next batch on, without a restart. Every
    ``retain_every`` batches, the tables are folded and swept before the batch
    is collected, at the latest time of a stored poll of a post.
    """
    candidate_limit, reporting = options.pop("candidate_limit", None), options.pop("reporting", None)
    retain_every = options.pop("retain_every", None)

    def run(batch: DataFrame, i: int) -> None:
        if retain_every and i and i % retain_every == 0:
            spark = batch.sparkSession
            now = read_changes(spark, root, "observation", before=i).agg(F.max("observed_at")).first()[0]
            if now is not None:
                retain(spark, root, now, i - 1, registry if "opt_out" in registry.columns else None)
        collect_batch(batch, i, root, tags, registry, salt, suppressed, candidate_limit, reporting)

    writer = pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return writer.trigger(**(options or {"availableNow": True})).start()


def update_rollups(spark: SparkSession, root: str, batch_id: int, reporting: int) -> None:
    """Recounts the minutes that a batch touched, from the posts of their days, and stores them as its change.

    Counting is never incremental, so a post reported by a second server later is
    not counted twice; the days that no touched minute lies in are not read.
    """
    touched = read_batch(spark, root, "touched_minute", batch_id)
    day = F.to_date(F.timestamp_seconds(F.col("minute") * 60))
    days = [row["day"] for row in touched.select(day.alias("day")).distinct().collect()]  # days, not minutes
    posts = current_observations(spark, root, before=batch_id + 1, days=days)
    write_change(minute_rollup(posts, F.lit(reporting), touched), root, "tag_minute", batch_id)


def suppress(spark: SparkSession, root: str, hashes: DataFrame) -> None:
    """Takes authors' posts out of the stored tables, those of batches to come as well."""
    entomb(spark, root, tombstones_of(hashes))


def refresh_rollups(spark: SparkSession, root: str, reporting: int) -> DataFrame:
    """Minute counts of every bucket any batch touched, recomputed from the folded posts.

    Counting is never incremental, so a post reported by a second server later
    is not counted twice, and a late post reopens its own minute.
    """
    touched = read_changes(spark, root, "touched_minute").select("tag_id", "minute").distinct()
    return minute_rollup(current_observations(spark, root), F.lit(reporting), touched)


def fold_health_batch(polls: DataFrame, batch_id: int, root: str, start: DataFrame) -> None:
    """Carries server health over one batch of polls.

    The state before batch ``n`` is the one written by batch ``n - 1``; running a
    batch again reads that same state, so the result does not change. Polls that
    have the columns of the poll log are kept in it.
    """
    spark = polls.sparkSession
    before = start if batch_id == 0 else spark.read.parquet(f"{root}/health/batch={batch_id - 1}")
    staged = fresh_folder(spark, "polls")
    polls.write.parquet(staged)
    polls = spark.read.parquet(staged)
    patches = health.fold_health(polls, before)
    write_change(merges.apply_health(before, patches), root, "health", batch_id)
    log = [c.split()[0] for c in schemas.POLL_LOG.split(", ")]
    if set(log) <= set(polls.columns):
        write_change(polls.select(*log), root, "poll_log", batch_id)
    tables._remove(spark, staged)


def start_health(polls: DataFrame, root: str, checkpoint: str, registry: DataFrame) -> StreamingQuery:
    writer = polls.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, i: fold_health_batch(batch, i, root, registry)
    )
    return writer.trigger(availableNow=True).start()


def latest_health(spark: SparkSession, root: str) -> DataFrame:
    changes = read_changes(spark, root, "health")
    newest = changes.agg(F.max("batch")).scalar()
    return changes.filter(F.col("batch") == newest).drop("batch")


def sweep(
    stored: dict[str, DataFrame], registry: DataFrame, now: int, root: str, run_id: int
) -> DataFrame:
    """The hourly retention run over folded tables: what it keeps takes the place of all batches up to ``run_id``.

    Returns the counts of what went.
    """
    spark = registry.sparkSession
    kept, report = merges.retention_sweep(stored, registry, now)
    for name, rows in kept.items():
        write_base(rows, root, name, run_id)
        drop_superseded(spark, root, name)
    return report


def run_to_table(stream: DataFrame, mode: str, purpose: str) -> DataFrame:
    """Drains a stream into a table in the shared folder and reads it back.

    In update mode a row replaces the one of the same (tag_id, uri) that an
    earlier batch wrote; a batch that runs again overwrites its own folder.
    """
    spark = stream.sparkSession
    out = fresh_folder(spark, purpose)
    if mode == "append":
        writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/table")
        query = writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    else:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state")
            .foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/table/batch={i}"))
            .trigger(availableNow=True).start()
        )
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{out}/table")
    changes = spark.read.parquet(f"{out}/table")
    newest = F.max_by(F.struct(*stream.columns), "batch").alias("_row")
    return changes.groupBy("tag_id", "uri").agg(newest).select("_row.*")
