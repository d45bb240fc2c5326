"""Checks of the streaming forms, fed from the event table as a file stream of several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.functions import text as X
from tagtide.operators import ingest
from tagtide.session import fresh_folder
from tagtide.streaming import changes, jobs
from workload import bindings as B
from workload.catalog import check
from workload.sql import EV, NOW, OBS, POLLS, TAG, q
from workload.operations import _FOLD

_ACTIVE = OBS.replace("JOIN tag t ON t.name = v.name", "JOIN active t ON t.name = v.name")
_ARRIVALS = """
span AS (SELECT min(created_at) AS low, max(created_at) AS high FROM ev),
arrival AS (SELECT ev.*, least(CAST(floor(4 * (created_at - low) / (high - low + 1)) AS INTEGER)
                   + CASE WHEN event_id % 50 = 0 THEN 3 ELSE 0 END, 4) AS batch FROM ev, span)"""
# An event is too late if what it counts for ended before the watermark of the batch before its own.
_LATE = _ARRIVALS + """,
reached AS (SELECT b, (SELECT max(created_at) - 25 * 3600 FROM arrival WHERE event_id % 11 <> 0 AND batch < b - {lag}) AS t
            FROM (SELECT unnest(range(5)) AS b)),
late AS (SELECT 'h' || (event_id % 13) || '.example/p/' || event_id AS post, coalesce(t, 0) AS t FROM arrival JOIN reached ON b = batch),
arrived AS (SELECT o.*, late.t AS t FROM {table} o JOIN late ON o.uri = 'https://' || late.post)"""
_MARK = "wm AS (SELECT max(created_at) - 25 * 3600 AS t FROM ev WHERE NOT (event_id % 11 = 0))"


_FILES = 4  # of each micro-batch


def event_stream(spark, sf, messy=True):
    """The event table as a stream of five micro-batches: four quarters of its time, then what is left over.

    If ``messy``, one event in 50 comes three batches late, most of these behind the
    watermark, and one in 20 comes again in the batch after its own.
    """
    events = B.table(spark, sf, "events")
    at = B.seconds(F.col("ts"))
    low, high = events.agg(F.min(at), F.max(at)).first()
    quarter = F.floor(4 * (at - low) / (high - low + 1)).cast("int")
    late = (F.col("event_id") % 50 == 0) & F.lit(messy)
    rows = events.withColumn("_batch", F.least(quarter + F.when(late, 3).otherwise(0), F.lit(4)))
    if messy:
        again = rows.filter(F.col("event_id") % 20 == 1).withColumn("_batch", F.least(F.col("_batch") + 1, F.lit(4)))
        rows = rows.unionByName(again)
    folder = fresh_folder(spark, "events")
    for k in range(5):  # one after another: a stream takes files by age
        rows.filter(F.col("_batch") == k).drop("_batch").repartition(_FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", _FILES).parquet(folder)


def sighting_stream(spark, sf):
    views = B.event_views_of(B.event_rows(event_stream(spark, sf))).drop("mask")
    return jobs.credit_stream(views, B.event_tags(spark, sf), B.registry(spark, sf))


@check("stream_observations", q(_ACTIVE, _LATE.format(table="obs", lag=1), """
SELECT tag_id, uri, created_at, observed_at, is_boost, seen_mask FROM arrived WHERE created_at > t"""))
def _(spark, sf):
    rows = jobs.run_to_table(jobs.stream_observations(sighting_stream(spark, sf)), "update", "observations")
    return rows.select("tag_id", "uri", "created_at", "observed_at", "is_boost", "seen_mask")


@check("stream_minute_counts", q(_ACTIVE, _MARK, _LATE.format(table="orig", lag=1), """
SELECT tag_id, created_at // 60 AS minute, count(*) AS posts FROM arrived
WHERE (created_at // 60 + 1) * 60 <= (SELECT t FROM wm) AND (created_at // 60 + 1) * 60 > t GROUP BY 1, 2"""))
def _(spark, sf):
    return jobs.run_to_table(jobs.stream_minute_counts(sighting_stream(spark, sf)), "append", "minutes")


@check("stream_exact_authors", q(_ACTIVE, _MARK, _LATE.format(table="orig", lag=1), """
SELECT tag_id, created_at // 3600 * 3600 AS "start", created_at // 3600 * 3600 + 3600 AS "end", count(DISTINCT author_hex) AS authors
FROM arrived WHERE created_at // 3600 * 3600 + 3600 <= (SELECT t FROM wm) AND created_at // 3600 * 3600 + 3600 > t GROUP BY ALL"""))
def _(spark, sf):
    return jobs.run_to_table(jobs.stream_exact_authors(sighting_stream(spark, sf)), "append", "authors")


@check("stream_sliding_authors", q(_ACTIVE, _MARK, _LATE.format(table="orig", lag=1), """
hop AS (SELECT *, created_at // 3600 * 3600 - 3600 * unnest([0, 1]) AS "start" FROM arrived)""", """
SELECT tag_id, "start", "start" + 7200 AS "end", count(DISTINCT author_hex) AS authors FROM hop
WHERE "start" + 7200 <= (SELECT t FROM wm) AND "start" + 7200 > t GROUP BY ALL"""))
def _(spark, sf):
    stream = jobs.stream_exact_authors(sighting_stream(spark, sf), "2 hours", "1 hour")
    return jobs.run_to_table(stream, "append", "sliding")


# What came in time: the window's end lay ahead of the watermark that the batch filtered by.
_IN_TIME = """
come AS (SELECT event_id, batch FROM arrival UNION ALL SELECT event_id, least(batch + 1, 4) FROM arrival WHERE event_id % 20 = 1),
reached AS (SELECT b, coalesce((SELECT max(created_at) - 25 * 3600 FROM arrival WHERE event_id % 11 <> 0 AND batch < b - 1), 0) AS t
            FROM (SELECT unnest(range(5)) AS b)),
hour AS (SELECT o.tag_id, o.author_hex, o.created_at // 3600 * 3600 AS "start", o.uri, come.batch, t FROM orig o
         JOIN come ON o.uri = 'https://h' || (event_id % 13) || '.example/p/' || event_id JOIN reached ON b = come.batch)"""


def author_counts(spark, sf):
    root = fresh_folder(spark, "authors")
    query = jobs.start_author_counts(sighting_stream(spark, sf), f"{root}/tables", f"{root}/state")
    query.awaitTermination()
    return query, f"{root}/tables"


@check("stream_current_authors", q(_ACTIVE, _ARRIVALS, _IN_TIME, """
SELECT b AS batch, tag_id, "start", "start" + 3600 AS "end", count(DISTINCT author_hex) AS authors
FROM hour JOIN (SELECT unnest(range(5)) AS b) ON batch <= b WHERE "start" + 3600 > t GROUP BY ALL"""))
def _(spark, sf):
    """The exact authors of every hour, as they stood after each batch."""
    _, root = author_counts(spark, sf)
    out = None
    for batch in range(5):
        rows = jobs.current_authors(spark, root, before=batch + 1).select(F.lit(batch).alias("batch"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@check("stream_late_rows", q(_ACTIVE, _ARRIVALS, _IN_TIME, """
views AS (SELECT tag_id, uri, count(*) AS n FROM credited JOIN active ON tag_id = id WHERE NOT is_boost GROUP BY ALL)""", """
SELECT b AS batch, coalesce(sum(n), 0) AS late_rows FROM (SELECT unnest(range(5)) AS b)
LEFT JOIN (SELECT hour.*, n FROM hour JOIN views USING (tag_id, uri) WHERE "start" + 3600 <= t) ON batch = b GROUP BY b"""))
def _(spark, sf):
    """Views that came behind the watermark, by batch."""
    query, _ = author_counts(spark, sf)
    late = [(batch, rows) for batch, rows in jobs.late_rows(query) if batch < 5]
    return spark.createDataFrame(late, "batch BIGINT, late_rows BIGINT")


def collection_views(spark, sf):
    return B.event_views_of(B.event_rows(event_stream(spark, sf))).drop("mask").withColumn(
        "skip_reason", F.when(F.col("seq") % 17 == 1, "non_public"))


def collected(spark, sf, before=None, replayed=None, between=None, tags=True, **options):
    """The collection job over the event stream; returns its folder.

    ``before`` is called with a batch's number and the tables' folder before the
    batch; the ``replayed`` batch runs twice, as after a lost driver, and ``between``
    is called after the first time.
    """
    root = fresh_folder(spark, "collection")
    tags, registry = B.event_tags(spark, sf) if tags else None, B.registry(spark, sf)
    views = collection_views(spark, sf)
    if before is None and replayed is None:
        jobs.start_collection(views, f"{root}/tables", f"{root}/state", tags, registry, B.SALT, **options).awaitTermination()
        return f"{root}/tables"

    def run(batch, i):
        if before:
            before(i, f"{root}/tables")
        for k in range(2 if i == replayed else 1):
            if k and between:
                between(f"{root}/tables")
            jobs.collect_batch(batch, i, f"{root}/tables", tags, registry, B.SALT, **options)

    views.writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(run).trigger(availableNow=True).start().awaitTermination()
    return f"{root}/tables"


@check("stream_collection", q(_ACTIVE, """
SELECT tag_id, uri, created_at, observed_at, seen_mask FROM obs WHERE CAST(regexp_extract(uri, '([0-9]+)$', 1) AS BIGINT) % 17 <> 1"""))
def _(spark, sf):
    rows = jobs.current_observations(spark, collected(spark, sf))
    return rows.select("tag_id", "uri", "created_at", "observed_at", "seen_mask")


@check("stream_candidate_pool", q(EV, TAG, _ARRIVALS, """
batches AS (SELECT event_id, batch FROM arrival UNION SELECT event_id, least(batch + 1, 4) FROM arrival WHERE event_id % 20 = 1)""", """
SELECT name, author_hex, count(DISTINCT batch) AS posts_seen
FROM (SELECT *, unnest(tags) AS name FROM epost WHERE seq % 17 <> 1 AND len(servers) > 0) p JOIN batches b ON b.event_id = p.seq
WHERE name NOT IN (SELECT name FROM active) GROUP BY 1, 2"""))
def _(spark, sf):
    rows = jobs.current_candidates(spark, collected(spark, sf))
    return rows.select("name", X.hash_hex(F.col("author_hash")).alias("author_hex"), "posts_seen")


@check("compacted_candidates", q(EV, TAG, _ARRIVALS, """
batches AS (SELECT event_id, batch FROM arrival UNION SELECT event_id, least(batch + 1, 4) FROM arrival WHERE event_id % 20 = 1)""", """
SELECT name, author_hex, count(DISTINCT batch) AS posts_seen
FROM (SELECT *, unnest(tags) AS name FROM epost WHERE seq % 17 <> 1 AND len(servers) > 0) p JOIN batches b ON b.event_id = p.seq
WHERE name NOT IN (SELECT name FROM active) GROUP BY 1, 2"""))
def _(spark, sf):
    root = collected(spark, sf)
    jobs.compact(spark, root, "tag_candidate", jobs.current_candidates, f"{root}-compact")
    rows = jobs.current_candidates(spark, f"{root}-compact")
    return rows.select("name", X.hash_hex(F.col("author_hash")).alias("author_hex"), "posts_seen")


_ROLLUPS = """
SELECT tag_id, created_at // 60 AS minute, count(*) AS posts, 9 AS instances_reporting FROM orig
WHERE CAST(regexp_extract(uri, '([0-9]+)$', 1) AS BIGINT) % 17 <> 1 GROUP BY 1, 2"""


@check("stream_rollups", q(_ACTIVE, _ROLLUPS))
def _(spark, sf):
    """The stored minutes, kept up batch by batch."""
    return jobs.current_rollups(spark, collected(spark, sf, reporting=9, replayed=2))


@check("refreshed_rollups", q(_ACTIVE, _ROLLUPS))
def _(spark, sf):
    """The same minutes, recounted from all posts."""
    return jobs.refresh_rollups(spark, collected(spark, sf), 9)


_BATCHES = _ARRIVALS + """,
batches AS (SELECT event_id, batch FROM arrival UNION ALL SELECT event_id, least(batch + 1, 4) FROM arrival WHERE event_id % 20 = 1)"""


@check("stream_tick_report", q(EV, TAG, _BATCHES, """
seen AS (SELECT v.*, b.batch, seq % 17 = 1 AS skipped FROM eview v JOIN batches b ON b.event_id = v.seq),
named AS (SELECT n.*, t.id AS tag_id FROM (SELECT *, unnest(tags) AS name FROM seen WHERE NOT skipped) n LEFT JOIN active t ON t.name = n.name),
a AS (SELECT batch, count(*) FILTER (WHERE NOT skipped) AS posts_observed, count(*) FILTER (WHERE skipped) AS non_public,
             count(DISTINCT host) AS hosts_ok FROM seen GROUP BY batch),
w AS (SELECT batch, count(DISTINCT (tag_id, uri)) FILTER (WHERE tag_id IS NOT NULL) AS observations_written,
             count(DISTINCT (tag_id, created_at // 60)) FILTER (WHERE tag_id IS NOT NULL AND NOT is_boost) AS rollup_buckets,
             count(DISTINCT name) FILTER (WHERE tag_id IS NULL) AS candidates_seen,
             count(DISTINCT (name, author_hex)) FILTER (WHERE tag_id IS NULL) AS candidates_written FROM named GROUP BY batch)""", """
SELECT batch, posts_observed, non_public, 0 AS malformed, 0 AS suppressed, observations_written, rollup_buckets, candidates_seen,
       candidates_written, hosts_ok FROM a JOIN w USING (batch)"""))
def _(spark, sf):
    return jobs.read_changes(spark, collected(spark, sf, replayed=2), "tick_report")


@check("stream_poll_log", q(EV, POLLS, """
SELECT host, "at", status, 1 AS tags, 0 AS new_observations, latency_ms, remaining AS ratelimit_remaining FROM poll"""))
def _(spark, sf):
    return jobs.current_poll_log(spark, polled(spark, sf, replayed=1))


def polled(spark, sf, root=None, replayed=None):
    """The health job over the polls of the event stream; returns its folder."""
    folder = fresh_folder(spark, "health")
    root = root or f"{folder}/tables"
    polls = B.polls_of(B.event_rows(event_stream(spark, sf, messy=False)))  # polls come in order
    start = B.registry(spark, sf)

    def run(batch, i):
        for _ in range(2 if i == replayed else 1):
            jobs.fold_health_batch(batch, i, root, start)

    polls.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(run).trigger(availableNow=True).start().awaitTermination()
    return root


_SUPPRESSED = """
sup AS (SELECT DISTINCT substr(sha256('test-salt u' || doc_id), 1, 32) AS author_hex FROM labels WHERE quality = 0)"""


@check("stream_tombstones", q(_ACTIVE, POLLS, _BATCHES, _SUPPRESSED, """
last AS (SELECT event_id, max(batch) AS batch FROM batches GROUP BY 1)""", """
SELECT tag_id, uri, created_at, seen_mask FROM obs JOIN last ON event_id = CAST(regexp_extract(uri, '([0-9]+)$', 1) AS BIGINT)
WHERE event_id % 17 <> 1 AND author_hex NOT IN (SELECT author_hex FROM sup)
  AND (origin_host NOT IN (SELECT host FROM registry WHERE opt_out) OR batch > 1)"""))
def _(spark, sf):
    """Authors and an origin are removed after two batches; the posts are folded without them after three."""
    from workload.posts import suppressed_authors

    def before(i, root):
        if i == 2:
            jobs.suppress(spark, root, suppressed_authors(spark, sf))
            changes.entomb(spark, root, changes.tombstones_of_origins(B.registry(spark, sf), 1))
        if i == 3:
            changes.consolidate(spark, root, "observation", 2)

    rows = jobs.current_observations(spark, collected(spark, sf, before=before))
    return rows.select("tag_id", "uri", "created_at", "seen_mask")


@check("stream_changing_tags", q(EV, TAG, _BATCHES, """
last AS (SELECT event_id, max(batch) AS batch FROM batches GROUP BY 1),
credited AS (SELECT t.id AS tag_id, t.tracked, v.* FROM (SELECT *, unnest(tags) AS name FROM eview) v JOIN tag t ON t.name = v.name
             WHERE NOT blocked AND seq % 17 <> 1)""", """
SELECT tag_id, uri, bit_or(CAST(1 AS BIGINT) << s) AS seen_mask FROM credited JOIN last ON event_id = seq
WHERE tracked OR batch > 2 GROUP BY 1, 2"""))
def _(spark, sf):
    """All tags are promoted while batch 2 is lost and runs again: it keeps its version, the next batch has the new one."""
    def before(i, root):
        if i == 0:
            jobs.publish_tags(spark, root, B.event_tags(spark, sf))

    def between(root):
        jobs.publish_tags(spark, root, B.event_tags(spark, sf).withColumn("tracked", F.lit(True)))

    root = collected(spark, sf, before=before, replayed=2, between=between, tags=False)
    return jobs.current_observations(spark, root).select("tag_id", "uri", "seen_mask")


RETAIN_AT = NOW + 129_600  # 1 February, 00:00 UTC


@check("stream_retention", q(_ACTIVE, POLLS, _BATCHES, f"""
kept AS (SELECT * FROM obs WHERE CAST(regexp_extract(uri, '([0-9]+)$', 1) AS BIGINT) % 17 <> 1),
fresh AS (SELECT v.name, v.author_hex, v.observed_at, b.batch FROM (SELECT *, unnest(tags) AS name FROM eview WHERE seq % 17 <> 1) v
          JOIN batches b ON b.event_id = v.seq WHERE v.name NOT IN (SELECT name FROM active)),
stamp AS (SELECT batch, max(observed_at) AS latest FROM fresh GROUP BY 1),
pair AS (SELECT name, author_hex, min(batch) AS batch FROM fresh GROUP BY 1, 2)""", f"""
SELECT 'observation' AS what, tag_id || ' ' || uri AS id FROM kept WHERE created_at >= {RETAIN_AT} - 25 * 3600
  AND origin_host NOT IN (SELECT host FROM registry WHERE opt_out)
UNION ALL SELECT 'post_index', tag_id || ' ' || uri FROM kept WHERE created_at >= {RETAIN_AT} - 25 * 3600
UNION ALL SELECT 'tag_candidate', name || ' ' || author_hex FROM pair JOIN stamp USING (batch) WHERE latest >= {RETAIN_AT} - 48 * 3600
UNION ALL SELECT 'poll_log', host || ' ' || "at" || ' ' || status FROM poll WHERE "at" >= {RETAIN_AT} - 7 * 86400
UNION ALL SELECT DISTINCT 'tag_minute', tag_id || ' ' || (created_at // 60) FROM kept
  WHERE NOT is_boost AND created_at // 60 >= ({RETAIN_AT} - 30 * 86400) // 60"""))
def _(spark, sf):
    """What is left of each stored table after a retention run over all five batches, read again from storage."""
    root = polled(spark, sf, collected(spark, sf))
    jobs.retain(spark, root, RETAIN_AT, 4, B.registry(spark, sf))
    spaced = lambda *columns: F.concat_ws(" ", *columns)
    parts = [
        ("observation", jobs.current_observations(spark, root), spaced("tag_id", "uri")),
        ("post_index", changes.current_index(spark, root), spaced("tag_id", "uri")),
        ("tag_candidate", jobs.current_candidates(spark, root), spaced("name", X.hash_hex(F.col("author_hash")))),
        ("poll_log", jobs.current_poll_log(spark, root), spaced("host", "at", "status")),
        ("tag_minute", jobs.current_rollups(spark, root), spaced("tag_id", "minute")),
    ]
    out = None
    for what, rows, name in parts:
        rows = rows.select(F.lit(what).alias("what"), name.alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return out


@check("stream_health", q(EV, POLLS, _FOLD, """
SELECT r.host, f.consecutive_failures, f.backoff_until, coalesce(f.last_ok_at, r.last_ok_at) AS last_ok_at,
  coalesce(f.capability, r.capability) AS capability FROM registry r JOIN folded f USING (host)"""))
def _(spark, sf):
    return jobs.latest_health(spark, polled(spark, sf)).select(
        "host", "consecutive_failures", "backoff_until", "last_ok_at", "capability")
