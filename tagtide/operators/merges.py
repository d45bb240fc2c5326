"""Keyed merges: each takes the stored table and a batch and returns the new table.

None of them relies on a transactional format. They are plain aggregations over
old and new rows, so Spark pre-aggregates before the shuffle and a repeated
batch leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtide import constants as C
from tagtide.operators.ingest import _ATTRIBUTES
from tagtide.operators.ranking import global_rank, top_rows


# Name and count of this many rows stay far below the size Spark broadcasts.
_BROADCAST_ROWS = 100_000


def upsert_observations(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Widens the masks of known posts, adds new ones; nothing else of a known post changes."""
    cols = ["tag_id", "uri", *_ATTRIBUTES, "seen_mask"]
    both = stored.select(*cols, F.lit(0).alias("_gen")).unionByName(batch.select(*cols, F.lit(1).alias("_gen")))
    first = F.min_by(F.struct(*_ATTRIBUTES), F.struct("_gen", "observed_at"))
    return (
        both.groupBy("tag_id", "uri")
        .agg(first.alias("_first"), F.bit_or("seen_mask").alias("seen_mask"))
        .select("tag_id", "uri", "_first.*", "seen_mask")
    )


def candidate_batch(sightings: DataFrame, now: int | Column) -> DataFrame:
    """One row per (name, author) of a batch; the author's last sighting supplies the detail."""
    last = F.max_by(F.struct("origin_host", "tags_on_post"), F.struct("observed_at", "host", "seq"))
    stamp = now if isinstance(now, Column) else F.lit(now)
    return (
        sightings.groupBy("name", "author_hash")
        .agg(last.alias("_last"), F.count("*").alias("occurrences"))
        .select(
            "name", "author_hash", stamp.cast("bigint").alias("first_seen"),
            "_last.origin_host", "_last.tags_on_post", "occurrences",
        )
    )


def cap_candidates(batch: DataFrame, limit: int = C.CANDIDATE_WRITES) -> DataFrame:
    """The write allowance, spent on the names occurring most, then by name and author.

    Every name has at least one author, so only the ``limit`` leading names can
    get a write; they are found first and the rows are joined to that short list.
    """
    names = batch.groupBy("name").agg(F.sum("occurrences").alias("name_occurrences"))
    leading = top_rows(names, [F.desc("name_occurrences"), F.asc("name")], limit, rank=None)
    order = [F.desc("name_occurrences"), F.asc("name"), F.asc("author_hash")]
    # The list is as long as the allowance at most; a very large allowance is left to Spark.
    short = F.broadcast(leading) if limit <= _BROADCAST_ROWS else leading
    return top_rows(batch.join(short, "name"), order, limit, rank="write_rank")


def upsert_candidates(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds unknown (name, author) pairs; a known pair gains one sighting per batch."""
    detail = ["first_seen", "origin_host", "tags_on_post"]
    both = stored.select("name", "author_hash", *detail, "posts_seen", F.lit(0).alias("_gen")).unionByName(
        batch.select("name", "author_hash", *detail, F.lit(1).cast("bigint").alias("posts_seen"), F.lit(1).alias("_gen"))
    )
    return (
        both.groupBy("name", "author_hash")
        .agg(F.min_by(F.struct(*detail), F.struct("_gen", "first_seen")).alias("_kept"),
             F.sum("posts_seen").alias("posts_seen"))
        .select("name", "author_hash", "_kept.*", "posts_seen")
    )


def upsert_cursors(stored: DataFrame, patches: DataFrame) -> DataFrame:
    """Last patch wins, except that a missing ``min_id`` never erases a known one."""
    cols = ["host", "tag_id", "min_id", "polled_at", "behind", "updated_at"]
    old = stored.select(*cols, F.lit(0).alias("_gen"), F.lit(0).cast("bigint").alias("_seq"))
    new = patches.select(
        "host", "tag_id", "min_id", "polled_at", "behind", F.col("polled_at").alias("updated_at"),
        F.lit(1).alias("_gen"), F.col("seq").cast("bigint").alias("_seq"),
    )
    when = F.struct("_gen", "polled_at", "_seq")
    known = F.max(F.when(F.col("min_id").isNotNull(), F.struct("_gen", "polled_at", "_seq", "min_id")))
    return (
        old.unionByName(new)
        .groupBy("host", "tag_id")
        .agg(F.max_by(F.struct("polled_at", "behind", "updated_at"), when).alias("_last"), known.alias("_known"))
        .select("host", "tag_id", F.col("_known.min_id").alias("min_id"), "_last.*")
    )


def append_poll_log(stored: DataFrame, entries: DataFrame) -> DataFrame:
    return stored.unionByName(entries.select(*stored.columns))


def upsert_tag_history(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """A fetched day replaces the stored one."""
    cols = ["tag_id", "host", "day", "uses", "accounts", "fetched_at"]
    both = stored.select(*cols, F.lit(0).alias("_gen")).unionByName(batch.select(*cols, F.lit(1).alias("_gen")))
    last = F.max_by(F.struct("uses", "accounts", "fetched_at"), F.struct("_gen", "fetched_at", "uses", "accounts"))
    return both.groupBy("tag_id", "host", "day").agg(last.alias("_last")).select("tag_id", "host", "day", "_last.*")


def upsert_rollups(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Recomputed minutes replace the count; the reporting figure only ever rises."""
    cols = ["tag_id", "minute", "posts", "instances_reporting"]
    both = stored.select(*cols, F.lit(0).alias("_gen")).unionByName(recomputed.select(*cols, F.lit(1).alias("_gen")))
    return both.groupBy("tag_id", "minute").agg(
        F.max_by("posts", "_gen").alias("posts"), F.max("instances_reporting").alias("instances_reporting")
    )


def register_tag_queries(tags: DataFrame, queries: DataFrame, max_tracked: int = C.MAX_TRACKED) -> DataFrame:
    """Applies a log of searches (name, display, asked_at, seq) to the tag table.

    Unknown names are added as cold tags in the order they were first asked for;
    the first of them take the free tracking slots. A known tag only gains
    interest: it is neither promoted nor retired.
    """
    asked = queries.groupBy("name").agg(
        F.min(F.struct("asked_at", "seq")).alias("_first"),
        F.min_by("display", F.struct("asked_at", "seq")).alias("_display"),
        F.max("asked_at").alias("_last_asked"),
        F.count("*").alias("_asks"),
    )
    known = tags.join(asked, "name", "left").select(
        "id", "name",
        F.coalesce("display", "_display").alias("display"),
        "tier", "first_seen_at",
        F.coalesce("_last_asked", "last_query_at").alias("last_query_at"),
        (F.col("query_count") + F.coalesce("_asks", F.lit(0))).alias("query_count"),
        "blocked", "tracked", "retired_at",
    )
    unknown = global_rank(asked.join(tags.select("name"), "name", "left_anti"), [F.asc("_first")], "_order")
    facts = tags.agg(
        F.struct(
            F.coalesce(F.max("id"), F.lit(0)).alias("last_id"),
            F.count_if(F.col("tracked") & ~F.col("blocked")).alias("tracked"),
        )
    ).scalar()
    added = unknown.select(
        (facts["last_id"] + F.col("_order")).alias("id"), "name", F.col("_display").alias("display"),
        F.lit("cold").alias("tier"), F.col("_first.asked_at").alias("first_seen_at"),
        F.col("_last_asked").alias("last_query_at"), F.col("_asks").alias("query_count"),
        F.lit(False).alias("blocked"), (F.col("_order") <= F.lit(max_tracked) - facts["tracked"]).alias("tracked"),
        F.lit(None).cast("bigint").alias("retired_at"),
    )
    return known.unionByName(added)


def promote_tags(tags: DataFrame, names: DataFrame, now: int) -> DataFrame:
    """Starts tracking the named tags, adding those the table does not hold yet."""
    chosen = names.select("name").distinct().withColumn("_chosen", F.lit(True))
    known = tags.join(chosen, "name", "left").select(
        *[c for c in tags.columns if c not in ("tracked", "retired_at")],
        (F.col("tracked") | F.col("_chosen").isNotNull()).alias("tracked"),
        F.when(F.col("_chosen").isNull(), F.col("retired_at")).alias("retired_at"),
    )
    last_id = tags.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    added = global_rank(chosen.join(tags.select("name"), "name", "left_anti"), [F.asc("name")], "_order").select(
        (last_id + F.col("_order")).alias("id"), "name", F.col("name").alias("display"), F.lit("cold").alias("tier"),
        F.lit(now).cast("bigint").alias("first_seen_at"), F.lit(None).cast("bigint").alias("last_query_at"),
        F.lit(0).cast("bigint").alias("query_count"), F.lit(False).alias("blocked"), F.lit(True).alias("tracked"),
        F.lit(None).cast("bigint").alias("retired_at"),
    )
    return known.unionByName(added)


def retire_tags(tags: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Stops tracking; the row stays so a returning tag keeps its history."""
    marks = ids.select("id").distinct().withColumn("_retire", F.lit(True))
    gone = F.col("_retire").isNotNull()
    return tags.join(marks, "id", "left").select(
        *[c for c in tags.columns if c not in ("tracked", "retired_at")],
        (F.col("tracked") & ~gone).alias("tracked"),
        F.when(gone, F.lit(now).cast("bigint")).otherwise(F.col("retired_at")).alias("retired_at"),
    )


def set_tiers(tags: DataFrame, tiers: DataFrame) -> DataFrame:
    return (
        tags.join(tiers.select("id", F.col("tier").alias("_tier")), "id", "left")
        .withColumn("tier", F.coalesce("_tier", "tier"))
        .select(*tags.columns)
    )


def apply_health(registry: DataFrame, patches: DataFrame) -> DataFrame:
    """Failure count and pause are replaced; last success and capability only when known."""
    p = patches.select(
        "host", F.col("consecutive_failures").alias("_failures"), F.col("backoff_until").alias("_backoff"),
        F.col("last_ok_at").alias("_ok"), F.col("capability").alias("_capability"), F.lit(True).alias("_patched"),
    )
    patched = F.col("_patched").isNotNull()
    return (
        registry.join(p, "host", "left")
        .withColumn("consecutive_failures", F.when(patched, F.col("_failures")).otherwise(F.col("consecutive_failures")))
        .withColumn("backoff_until", F.when(patched, F.col("_backoff")).otherwise(F.col("backoff_until")))
        .withColumn("last_ok_at", F.coalesce("_ok", "last_ok_at"))
        .withColumn("capability", F.coalesce("_capability", "capability"))
        .select(*registry.columns)
    )


def record_probes(registry: DataFrame, results: DataFrame, now: int) -> DataFrame:
    """Replaces software, version and capability of probed servers."""
    r = results.select("host", *[F.col(c).alias(f"_{c}") for c in ("software", "version", "capability")],
                       F.lit(True).alias("_probed"))
    probed = F.col("_probed").isNotNull()
    out = registry.join(r, "host", "left")
    for c in ("software", "version", "capability"):
        out = out.withColumn(c, F.when(probed, F.col(f"_{c}")).otherwise(F.col(c)))
    stamp = F.when(probed, F.lit(now).cast("bigint")).otherwise(F.col("probed_at"))
    return out.withColumn("probed_at", stamp).select(*registry.columns)


def set_opt_out(registry: DataFrame, hosts: DataFrame) -> DataFrame:
    """Flags the given (host, reason) rows."""
    marks = hosts.select("host", F.col("reason").alias("_reason"), F.lit(True).alias("_out"))
    out = F.col("_out").isNotNull()
    return (
        registry.join(marks, "host", "left")
        .withColumn("opt_out", F.col("opt_out") | out)
        .withColumn("opt_out_reason", F.when(out, F.col("_reason")).otherwise(F.col("opt_out_reason")))
        .select(*registry.columns)
    )


def add_servers(registry: DataFrame, hosts: DataFrame, now: int, width: int = C.MASK_BITS) -> DataFrame:
    """Adds unknown hosts in the order given by ``seq``, each on the lowest free bit.

    A host finding no free bit is not added; ``rejected_servers`` names those.
    At most ``width`` bits exist, so both sides of the pairing are bounded by it.
    """
    spark = registry.sparkSession
    free = spark.range(width).select(F.col("id").cast("int").alias("bit")).join(
        registry.select("bit").filter(F.col("bit").isNotNull()), "bit", "left_anti"
    )
    free = top_rows(free, [F.asc("bit")], width, "_place")
    new = hosts.groupBy("host").agg(F.min("seq").alias("seq")).join(registry.select("host"), "host", "left_anti")
    new = top_rows(new, [F.asc("seq"), F.asc("host")], width, "_place")
    added = new.join(free, "_place").select(
        "host", F.lit(None).cast("string").alias("software"), F.lit(None).cast("string").alias("version"),
        F.lit("unknown").alias("capability"), "bit", F.lit(False).alias("opt_out"),
        F.lit(None).cast("string").alias("opt_out_reason"), F.lit(None).cast("bigint").alias("probed_at"),
        F.lit(None).cast("bigint").alias("last_ok_at"), F.lit(0).alias("consecutive_failures"),
        F.lit(None).cast("bigint").alias("backoff_until"), F.lit(now).cast("bigint").alias("added_at"),
    )
    return registry.unionByName(added)


def rejected_servers(registry: DataFrame, hosts: DataFrame, after: DataFrame) -> DataFrame:
    """(host, reason) of the asked-for hosts that ``add_servers`` could not place."""
    asked = hosts.select("host").distinct().join(registry.select("host"), "host", "left_anti")
    return asked.join(after.select("host"), "host", "left_anti").withColumn("reason", F.lit("no_free_bit"))


def suppress_authors(
    suppression: DataFrame, observed: DataFrame, hashes: DataFrame, now: int
) -> tuple[DataFrame, DataFrame]:
    """Adds the hashes to the list and removes their observations."""
    new = hashes.select("author_hash").distinct().join(suppression, "author_hash", "left_anti")
    listed = suppression.select("author_hash", "added_at").unionByName(
        new.withColumn("added_at", F.lit(now).cast("bigint"))
    )
    return listed, observed.join(hashes.select("author_hash"), "author_hash", "left_anti").select(*observed.columns)


def remove_opted_out(observed: DataFrame, registry: DataFrame, clear_bits: bool = False) -> DataFrame:
    """Drops posts whose origin opted out; optionally clears those servers' mask bits too."""
    out = registry.filter(F.col("opt_out"))
    gone = out.select(F.col("host").alias("origin_host"))
    kept = observed.join(gone, "origin_host", "left_anti").select(*observed.columns)
    if clear_bits:
        from tagtide.functions.numbers import bit_mask

        closed = out.agg(F.coalesce(F.bit_or(bit_mask(F.col("bit"))), F.lit(0).cast("bigint"))).scalar()
        kept = kept.withColumn("seen_mask", F.col("seen_mask").bitwiseAND(F.bitwise_not(closed)))
    return kept


def retention_sweep(
    tables: dict[str, DataFrame], registry: DataFrame, now: int, observation_hours: int = C.OBSERVATION_HOURS
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Expires the four timed tables and opted-out origins; returns them and the removal counts.

    ``tables`` holds observation, tag_candidate, poll_log and tag_minute.
    """
    cut = {
        "observation": F.col("created_at") >= now - observation_hours * C.HOUR,
        "tag_candidate": F.col("first_seen") >= now - C.POOL_HOURS * C.HOUR,
        "poll_log": F.col("at") >= now - C.POLL_LOG_DAYS * C.DAY,
        "tag_minute": F.col("minute") >= (now - C.ROLLUP_DAYS * C.DAY) // 60,
    }
    label = {"observation": "observations", "tag_candidate": "candidates", "poll_log": "poll_log",
             "tag_minute": "rollups"}
    kept = {name: tables[name].filter(cond) for name, cond in cut.items()}
    counts = [
        tables[name].agg(F.count_if(~cond).alias("removed")).select(F.lit(label[name]).alias("what"), "removed")
        for name, cond in cut.items()
    ]
    gone = registry.filter(F.col("opt_out")).select(F.col("host").alias("origin_host"))
    fresh = kept["observation"]
    counts.append(
        fresh.join(gone, "origin_host", "left_semi").agg(F.count("*").alias("removed"))
        .select(F.lit("opted_out").alias("what"), "removed")
    )
    kept["observation"] = fresh.join(gone, "origin_host", "left_anti").select(*fresh.columns)
    report = counts[0]
    for part in counts[1:]:
        report = report.unionByName(part)
    return kept, report
