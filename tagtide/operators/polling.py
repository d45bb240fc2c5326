"""Due work, cursors and budgets over tables of servers, tags and poll results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagtide import constants as C
from tagtide.functions.numbers import header_int, previous_page_cursor, reset_seconds, snowflake
from tagtide.functions.ratings import tier_rank, tier_seconds
from tagtide.functions.servers import is_collectable
from tagtide.operators.overview import active_tags
from tagtide.operators.ranking import running_total_before, top_rows, top_rows_per_group

_NEVER_POLLED = 9_007_199_254_740_991
_BEHIND = _NEVER_POLLED - 1


def collectable_hosts(registry: DataFrame, now: int) -> DataFrame:
    """Hosts that may be polled now, one per mask bit and so never more than 63."""
    rows = registry.filter(is_collectable(now) & F.col("bit").between(0, 62))
    return rows.groupBy("bit").agg(F.min("host").alias("host"))


def due_pairs(registry: DataFrame, tags: DataFrame, cursors: DataFrame, now: int) -> DataFrame:
    """(host, tag) pairs whose polling interval has passed.

    The host list is bounded by the mask width, so it is carried into the tag
    rows as one array value instead of through a product of two tables.
    """
    hosts = collectable_hosts(registry, now).agg(F.sort_array(F.collect_list("host"))).scalar()
    pairs = active_tags(tags).select(
        F.col("id").alias("tag_id"), "tier", F.explode(hosts).alias("host")
    )
    state = cursors.select("host", "tag_id", "min_id", "polled_at", "behind")
    overdue = (
        F.when(F.col("polled_at").isNull(), F.lit(_NEVER_POLLED))
        .when(F.col("behind"), F.lit(_BEHIND))
        .otherwise(F.lit(now) - F.col("polled_at") - tier_seconds(F.col("tier")))
    )
    return (
        pairs.join(state, ["host", "tag_id"], "left").withColumn("overdue", overdue)
        .filter(F.col("overdue") >= 0).select("host", "tag_id", "tier", "min_id", "overdue")
    )


def oldest_cursor(min_id: Column, order: Column) -> Column:
    """Aggregate: numerically smallest id; NULL if any is missing; malformed ids only win alone."""
    usable = F.min(F.when(snowflake(min_id).isNotNull(), F.struct(snowflake(min_id).alias("n"), min_id.alias("text"))))
    return F.when(~F.bool_or(min_id.isNull()), F.coalesce(usable["text"], F.min_by(min_id, order)))


def poll_plan(
    due: DataFrame, budget: int = C.REQUEST_BUDGET, batch_size: int = C.TAGS_PER_BATCH
) -> DataFrame:
    """The first ``budget`` batches of due work, in order.

    Hot tags go alone, others in batches of one tier and host, most overdue
    first. Tiers come in priority order; inside a tier every host gets its first
    batch before any gets its second. A host can contribute at most ``budget``
    batches, which bounds what is ranked per group.
    """
    budget = max(0, budget)
    size = max(1, batch_size)
    keep = max(1, budget * size)
    order = [F.desc("overdue"), F.asc("tag_id")]
    near = top_rows_per_group(due, ["tier", "host"], order, keep, "_place")
    per_batch = F.when(F.col("tier") == "hot", F.lit(1)).otherwise(F.lit(size))
    batches = (
        near.withColumn("batch_no", F.floor((F.col("_place") - 1) / per_batch))
        .groupBy("tier", "host", "batch_no").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_place", "tag_id"))), lambda t: t["tag_id"]).alias("tag_ids"),
            oldest_cursor(F.col("min_id"), F.col("_place")).alias("min_id"),
        )
    )
    cut = [tier_rank(F.col("tier")).asc(), F.asc("batch_no"), F.asc("host")]
    return top_rows(batches, cut, budget, "position")


def byte_budget_cut(jobs: DataFrame, keys: list[str], budget: int = C.BYTE_BUDGET, wave: int = C.WAVE_SIZE) -> DataFrame:
    """Marks which jobs (position from 1, bytes) run before the byte budget is spent.

    Jobs run in waves; a wave starts only while the bytes read so far are below
    the budget, and then runs whole.
    """
    waves = jobs.withColumn("wave", F.floor((F.col("position") - 1) / wave))
    totals = waves.groupBy(*keys, "wave").agg(F.sum("bytes").alias("_bytes"))
    started = running_total_before(totals, keys, "wave", "_bytes", "bytes_before")
    return waves.join(started.select(*keys, "wave", "bytes_before"), [*keys, "wave"]).withColumn(
        "run", F.col("bytes_before") < budget
    )


def next_cursor(responses: DataFrame, statuses: DataFrame) -> DataFrame:
    """Where the next poll of each page's query starts.

    ``responses`` has page_id and link_header, ``statuses`` page_id and the id
    of every status. The server's own previous-page link wins; otherwise the
    numerically newest id of the page.
    """
    ids = statuses.groupBy("page_id").agg(
        F.max(F.when(snowflake(F.col("id")).isNotNull(), F.struct(snowflake(F.col("id")).alias("n"), F.col("id").alias("t")))).alias("_new")
    )
    return responses.join(ids, "page_id", "left").select(
        *responses.columns, F.coalesce(previous_page_cursor(F.col("link_header")), F.col("_new.t")).alias("next_cursor")
    )


def rate_limit_columns(responses: DataFrame) -> DataFrame:
    return responses.withColumn("remaining", header_int(F.col("remaining_header"))).withColumn(
        "reset", reset_seconds(F.col("reset_header"))
    )


def cursor_patches(results: DataFrame, page_limit: int = C.PAGE_LIMIT) -> DataFrame:
    """Cursor rows of the polls that succeeded; a failed poll moves nothing.

    ``results`` has host, at, seq, ok, returned, next_cursor and tag_ids.
    """
    return results.filter(F.col("ok")).select(
        "host", F.explode("tag_ids").alias("tag_id"), F.col("next_cursor").alias("min_id"),
        F.col("at").alias("polled_at"), (F.col("returned") >= page_limit).alias("behind"), "seq",
    )


def due_probes(registry: DataFrame, now: int, limit: int = 1, after: int = C.REPROBE_SECONDS) -> DataFrame:
    """Servers whose capability should be asked again, least recently probed first."""
    stale = F.col("probed_at").isNull() | (F.lit(now) - F.col("probed_at") >= after)
    rows = registry.filter(~F.col("opt_out") & stale).select("host", "probed_at")
    return top_rows(rows, [F.coalesce("probed_at", F.lit(0)).asc(), F.asc("host")], limit)


def counter_sources(registry: DataFrame, now: int, limit: int = C.COUNTER_SOURCES) -> DataFrame:
    """The servers whose own daily counters are asked for."""
    usable = ~F.col("opt_out") & F.col("capability").isin("timeline", "tags_only")
    rested = F.coalesce(F.col("backoff_until"), F.lit(0)) <= now
    return top_rows(registry.filter(usable & rested).select("host", "capability"), [F.asc("host")], limit)


def tags_needing_counters(
    tags: DataFrame, history: DataFrame, now: int, fresh: int = C.COUNTER_FRESH_SECONDS, by: str = "day"
) -> DataFrame:
    """Tags without recent server counters; ``by`` picks the day or the fetch time as their age."""
    newest = history.groupBy("tag_id").agg(F.max(by).alias("_newest"))
    aged = F.col("_newest").isNull() | (F.lit(now) - F.col("_newest") >= fresh)
    return tags.join(newest, F.col("id") == F.col("tag_id"), "left").filter(aged).select("id", "name")
