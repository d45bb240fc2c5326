"""Checks of polling, cursors, budgets, server health, probing and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.functions import servers as S
from tagtide.operators import health, merges, polling, robots
from tagtide.plans import maintenance, reports
from workload import bindings as B
from workload.catalog import check
from workload.sql import EV, NOW, OBS, POLLS, TAG, q

# -- registry ----------------------------------------------------------------


@check("scan_registry", q(EV, POLLS, "SELECT * FROM registry"))
def _(spark, sf):
    from tagtide.sources.tables import scan_registry

    return scan_registry(B.registry(spark, sf))


@check("server_predicates", q(EV, POLLS, f"""
SELECT host, host IN (SELECT host FROM monitored) AS monitored, host IN (SELECT host FROM collectable) AS collectable,
  software = 'mastodon' OR software = 'pleroma' AS federating,
  CASE WHEN opt_out THEN 'opted_out' WHEN backoff_until > {NOW} THEN 'paused' WHEN consecutive_failures > 0 THEN 'failing'
       ELSE 'ok' END AS state FROM registry"""))
def _(spark, sf):
    return B.registry(spark, sf).select(
        "host", S.is_monitored().alias("monitored"), S.is_collectable(NOW).alias("collectable"),
        S.is_federating_software(F.col("software")).alias("federating"), S.server_state(NOW).alias("state"),
    )


@check("degraded_hosts", q(EV, POLLS, """
SELECT host FROM monitored WHERE host NOT IN (SELECT host FROM collectable)"""))
def _(spark, sf):
    return reports.degraded_hosts(B.registry(spark, sf), NOW)


@check("last_successful_update", q(EV, POLLS, "SELECT max(last_ok_at) AS last_successful_update FROM registry"))
def _(spark, sf):
    return reports.last_successful_update(B.registry(spark, sf))


@check("servers_by_capability", q(EV, POLLS, """
SELECT CASE WHEN opt_out THEN 'opted_out' ELSE capability END AS capability, string_agg(host, ',' ORDER BY host) AS hosts
FROM registry GROUP BY 1"""))
def _(spark, sf):
    rows = reports.servers_by_capability(B.registry(spark, sf))
    return rows.select("capability", F.array_join("hosts", ",").alias("hosts"))


@check("server_groups", q(EV, POLLS, """
SELECT CASE WHEN opt_out THEN 'opted_out' ELSE capability END AS capability, host FROM registry"""))
def _(spark, sf):
    return reports.server_groups(B.registry(spark, sf))


@check("coverage_report", q(EV, POLLS, """
SELECT CASE WHEN opt_out THEN 'opted_out' ELSE capability END AS capability, host FROM registry"""))
def _(spark, sf):
    rows = reports.coverage_report(B.registry(spark, sf)).select(F.explode("servers_by_capability").alias("capability", "hosts"))
    return rows.select("capability", F.explode("hosts").alias("host"))


@check("backoff_seconds", q(EV, """
SELECT event_id, CASE WHEN k - 3 <= 0 THEN 0 ELSE CAST(least(3600, 60 * pow(2, k - 4)) AS BIGINT) END AS wait FROM ev"""))
def _(spark, sf):
    return B.events(spark, sf).select("event_id", S.backoff_seconds(F.col("k") - 3).alias("wait"))


@check("classify_probe", q(EV, """
SELECT event_id, CASE WHEN k % 3 = 0 THEN 'timeline' WHEN k % 5 = 0 THEN 'tags_only' WHEN k % 7 = 0 THEN 'unknown'
  WHEN k % 4 = 1 THEN 'activitypub' ELSE 'blocked' END AS capability,
  CASE WHEN k IN (1, 3, 22) THEN 'tags_only' END AS after_failure FROM ev"""))
def _(spark, sf):
    k = F.col("k")
    software = F.when(k % 4 == 1, " Misskey ").when(k % 4 == 2, "webserver")
    status = F.when(k % 7 == 0, 0).otherwise(404)
    return B.events(spark, sf).select(
        "event_id", S.classify_probe(k % 3 == 0, status, k % 5 == 0, software).alias("capability"),
        S.reclassify_on_failure(k + 400).alias("after_failure"),
    )


@check("set_opt_out", q(EV, POLLS, """
SELECT host, opt_out OR bit % 2 = 1 AS opt_out, CASE WHEN bit % 2 = 1 THEN 'asked' ELSE opt_out_reason END AS opt_out_reason
FROM registry"""))
def _(spark, sf):
    registry = B.registry(spark, sf)
    hosts = registry.filter(F.col("bit") % 2 == 1).select("host", F.lit("asked").alias("reason"))
    return merges.set_opt_out(registry, hosts).select("host", "opt_out", "opt_out_reason")


@check("add_servers", q(EV, POLLS, """
cand AS (SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, min(page_id) AS seq FROM pages GROUP BY 1),
new AS (SELECT host, row_number() OVER (ORDER BY seq, host) AS rn FROM cand),
free AS (SELECT b AS bit, row_number() OVER (ORDER BY b) AS rn FROM (SELECT unnest(range(63)) AS b)
         WHERE b NOT IN (SELECT bit FROM registry))""", """
SELECT host, bit, capability FROM registry UNION ALL
SELECT new.host, free.bit, 'unknown' FROM new JOIN free USING (rn)"""))
def _(spark, sf):
    from tagtide.functions.text import origin_host

    hosts = B.table(spark, sf, "pages").select(origin_host(F.col("url")).alias("host"), F.col("page_id").alias("seq"))
    return merges.add_servers(B.registry(spark, sf), hosts, NOW).select("host", "bit", "capability")


# -- health ------------------------------------------------------------------

_SUMMARY = f"""
summary AS (SELECT r.host, any_value(capability) AS capability, any_value(opt_out) AS opt_out,
  any_value(last_ok_at) AS last_ok_at, any_value(consecutive_failures) AS consecutive_failures,
  any_value(backoff_until) AS backoff_until, count(p.host) AS polls,
  count(*) FILTER (WHERE p.host IS NOT NULL AND p.status <> 200) AS failures,
  floor(avg(latency_ms) + 0.5) AS mean_latency_ms, min(remaining) AS lowest_headroom
  FROM registry r LEFT JOIN poll p ON p.host = r.host AND p."at" >= {NOW} - 3600 GROUP BY r.host)"""


@check("health_summary", q(EV, POLLS, _SUMMARY, "SELECT * FROM summary"))
def _(spark, sf):
    return health.health_summary(B.registry(spark, sf), B.polls(spark, sf), NOW - 3600)


@check("instances_report", q(EV, POLLS, _SUMMARY, f"""
SELECT host, capability, opt_out AS opted_out, last_ok_at AS last_successful_poll, consecutive_failures,
  CASE WHEN backoff_until > {NOW} THEN backoff_until END AS paused_until, polls, failures, mean_latency_ms, lowest_headroom,
  CASE WHEN opt_out THEN 'opted_out' WHEN backoff_until > {NOW} THEN 'paused' WHEN consecutive_failures > 0 THEN 'failing'
       ELSE 'ok' END AS state FROM summary"""))
def _(spark, sf):
    return reports.instances_report(B.registry(spark, sf), B.polls(spark, sf), NOW)


_FOLD = """
okp AS (SELECT host, max("at" * 100000000 + seq) AS ok_key, max("at") AS ok_at FROM poll WHERE status = 200 GROUP BY host),
lastp AS (SELECT * FROM poll QUALIFY row_number() OVER (PARTITION BY host ORDER BY "at" DESC, seq DESC) = 1),
fails AS (SELECT p.host, count(*) AS n FROM poll p LEFT JOIN okp o USING (host)
  WHERE p.status NOT IN (200, 429) AND (ok_key IS NULL OR p."at" * 100000000 + p.seq > ok_key) GROUP BY p.host),
base AS (SELECT l.*, o.ok_at, coalesce(f.n, 0) + CASE WHEN o.ok_key IS NULL THEN r.consecutive_failures ELSE 0 END AS n
  FROM lastp l LEFT JOIN okp o USING (host) LEFT JOIN fails f USING (host) LEFT JOIN registry r ON r.host = l.host),
folded AS (SELECT b.host, n AS consecutive_failures,
  CASE WHEN status = 429 THEN coalesce(reset, "at" + 60)
       WHEN status = 200 THEN CASE WHEN remaining < 30 THEN coalesce(reset, "at" + 60) END
       ELSE "at" + CASE WHEN n <= 0 THEN 0 ELSE CAST(least(3600, 60 * pow(2, least(n, 20) - 1)) AS BIGINT) END END
    AS backoff_until, ok_at AS last_ok_at,
  CASE WHEN host IN (SELECT host FROM poll WHERE status IN (401, 403, 422)) THEN 'tags_only' END AS capability FROM base b)"""


@check("fold_health", q(EV, POLLS, _FOLD, "SELECT * FROM folded"))
def _(spark, sf):
    return health.fold_health(B.polls(spark, sf), B.registry(spark, sf))


@check("fold_health_last_per_batch", q(EV, POLLS, _FOLD, """
tail AS (SELECT * FROM poll QUALIFY row_number() OVER (PARTITION BY host, "at" ORDER BY seq DESC) = 1)""", """
SELECT host, consecutive_failures, backoff_until,
  (SELECT max("at") FROM tail t WHERE t.host = f.host AND status = 200) AS last_ok_at,
  (SELECT max('tags_only') FROM tail t WHERE t.host = f.host AND status = 422) AS capability FROM folded f"""))
def _(spark, sf):
    return health.fold_health(B.polls(spark, sf), B.registry(spark, sf), last_per_batch=True)


@check("apply_health", q(EV, POLLS, _FOLD, """
SELECT r.host, CASE WHEN f.host IS NULL THEN r.consecutive_failures ELSE f.consecutive_failures END AS consecutive_failures,
  CASE WHEN f.host IS NULL THEN r.backoff_until ELSE f.backoff_until END AS backoff_until,
  coalesce(f.last_ok_at, r.last_ok_at) AS last_ok_at, coalesce(f.capability, r.capability) AS capability
FROM registry r LEFT JOIN (SELECT * FROM folded WHERE host <> 'h1.example') f USING (host)"""))
def _(spark, sf):
    registry = B.registry(spark, sf)
    patches = health.fold_health(B.polls(spark, sf), registry).filter(F.col("host") != "h1.example")
    return merges.apply_health(registry, patches).select(
        "host", "consecutive_failures", "backoff_until", "last_ok_at", "capability")


# -- robots and probes -------------------------------------------------------


def bodies(spark, sf):
    """Robots files made from the captured pages; one kind in eight is a page served in place of one."""
    i = F.col("page_id") % 8
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    body = (
        F.when(i == 0, "User-agent: *\nDisallow: /")
        .when(i == 1, "User-agent: *\nDisallow: /api/\nAllow: /api/v1/")
        .when(i == 2, "User-agent: tagtide\r\nDisallow:\r\n\r\nUser-agent: *\r\nDisallow: /")
        .when(i == 3, F.concat(F.lit("  <"), F.col("html")))
        .when(i == 5, "# note\nUser-agent: other\nCrawl-delay: 5\nUSER-AGENT: TagTide # us\nDisallow: /api/v1/tags/")
        .when(i == 6, "Disallow: /api\nUser-agent: *\nAllow: /x")
        .when(i == 7, F.concat(F.lit("User-agent: *\nDisallow: "), path))
    )
    return B.table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("host"), body.alias("robots_body"), "page_id"
    )


_CLOSED = """
closed AS (SELECT page_id, 'p' || page_id AS host, CASE WHEN page_id % 8 IN (0, 5, 6) THEN TRUE
  WHEN page_id % 8 = 7 THEN regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) = '/' ELSE FALSE END AS opted_out FROM pages)"""


@check("robots_opt_outs", q(_CLOSED, "SELECT host, opted_out FROM closed"))
def _(spark, sf):
    return robots.robots_opt_outs(bodies(spark, sf))


def probe_results(spark, sf):
    i = F.col("page_id")
    return bodies(spark, sf).select(
        "host", "robots_body", (i % 3 == 0).alias("timeline_ok"), F.when(i % 3 == 0, 200).otherwise(401).alias("timeline_status"),
        (i % 5 < 2).alias("tags_ok"), F.when(i % 2 == 0, "gotosocial").alias("software"), F.lit("1.0").alias("version"),
    )


_VERDICT = """
verdict AS (SELECT host, opted_out, CASE WHEN opted_out THEN 'blocked' WHEN page_id % 3 = 0 THEN 'timeline'
    WHEN page_id % 5 < 2 THEN 'tags_only' WHEN page_id % 2 = 0 THEN 'activitypub' ELSE 'blocked' END AS capability,
  CASE WHEN NOT opted_out AND page_id % 2 = 0 THEN 'gotosocial' END AS software,
  CASE WHEN NOT opted_out THEN '1.0' END AS version,
  CASE WHEN opted_out THEN 'robots_disallow' WHEN page_id % 3 <> 0 THEN 'http_401' END AS reason FROM closed)"""


@check("judge_probes", q(_CLOSED, _VERDICT, "SELECT * FROM verdict"))
def _(spark, sf):
    return health.judge_probes(probe_results(spark, sf))


@check("probe_pass", q(EV, POLLS, _CLOSED, _VERDICT, f"""
SELECT r.host, CASE WHEN v.host IS NULL THEN r.software ELSE v.software END AS software,
  CASE WHEN v.host IS NULL THEN r.capability ELSE v.capability END AS capability,
  r.opt_out OR coalesce(v.opted_out, FALSE) AS opt_out,
  CASE WHEN v.opted_out THEN 'robots_disallow' ELSE r.opt_out_reason END AS opt_out_reason,
  CASE WHEN v.host IS NULL THEN r.probed_at ELSE {NOW} END AS probed_at
FROM registry r LEFT JOIN (SELECT 'h' || substr(host, 2) || '.example' AS host, * EXCLUDE host FROM verdict) v USING (host)"""))
def _(spark, sf):
    results = probe_results(spark, sf).withColumn("host", F.concat(F.lit("h"), F.substring("host", 2, 20), F.lit(".example")))
    after, _ = maintenance.probe_pass(B.registry(spark, sf), results, NOW)
    return after.select("host", "software", "capability", "opt_out", "opt_out_reason", "probed_at")


@check("due_probes", q(EV, POLLS, f"""
SELECT host, probed_at, row_number() OVER (ORDER BY coalesce(probed_at, 0), host) AS rank FROM registry
WHERE NOT opt_out AND (probed_at IS NULL OR {NOW} - probed_at >= 604800) QUALIFY rank <= 3"""))
def _(spark, sf):
    return polling.due_probes(B.registry(spark, sf), NOW, 3)


@check("counter_sources", q(EV, POLLS, f"""
SELECT host, capability, row_number() OVER (ORDER BY host) AS rank FROM registry
WHERE NOT opt_out AND capability IN ('timeline', 'tags_only') AND coalesce(backoff_until, 0) <= {NOW} QUALIFY rank <= 2"""))
def _(spark, sf):
    return polling.counter_sources(B.registry(spark, sf), NOW)


@check("tags_needing_counters", q(OBS, f"""
hist AS (SELECT tag_id, max(created_at // 86400 * 86400) AS newest FROM credited WHERE created_at < {NOW} - 43200 GROUP BY 1)""", f"""
SELECT id, name FROM tag LEFT JOIN hist ON tag_id = id WHERE newest IS NULL OR {NOW} - newest >= 21600 + 86400"""))
def _(spark, sf):
    history = B.tag_history(spark, sf).filter(F.col("day") < NOW - 43200)
    return polling.tags_needing_counters(B.event_tags(spark, sf), history, NOW, fresh=21600 + 86400)


@check("scan_tag_history", q(OBS, """
SELECT tag_id, host, created_at // 86400 * 86400 AS day, count(*) AS uses, count(DISTINCT author_hex) AS accounts
FROM credited WHERE tag_id IN (SELECT id FROM active) GROUP BY ALL"""))
def _(spark, sf):
    from tagtide.operators.overview import active_tags
    from tagtide.sources.tables import scan_tag_history

    ids = active_tags(B.event_tags(spark, sf)).select(F.col("id").alias("tag_id"))
    return scan_tag_history(B.tag_history(spark, sf), ids)


# -- plans of work -----------------------------------------------------------

CURSOR = f"""
lastc AS (SELECT 'h' || (k % 9) || '.example' AS host, event_type AS name, arg_max(created_at, event_id) AS polled_at,
    arg_max(k, event_id) AS k, max(event_id) AS event_id FROM ev WHERE created_at < {NOW} GROUP BY 1, 2),
cursors AS (SELECT host, t.id AS tag_id, polled_at, k % 4 = 0 AS behind, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN 'bad'
    ELSE '11199' || lpad(CAST(event_id AS VARCHAR), 12, '0') END AS min_id FROM lastc JOIN tag t USING (name)),
due AS (SELECT * FROM (SELECT c.host, t.id AS tag_id, t.tier, x.min_id,
    CASE WHEN x.polled_at IS NULL THEN 9007199254740991 WHEN x.behind THEN 9007199254740990
         ELSE {NOW} - x.polled_at - CASE t.tier WHEN 'hot' THEN 60 WHEN 'warm' THEN 300 ELSE 1800 END END AS overdue
  FROM collectable c, active t LEFT JOIN cursors x ON x.host = c.host AND x.tag_id = t.id) WHERE overdue >= 0)"""


@check("scan_cursors", q(EV, TAG, CURSOR.split("due AS")[0].rstrip().rstrip(","), "SELECT * FROM cursors"))
def _(spark, sf):
    return B.cursors(spark, sf).select("host", "tag_id", "polled_at", "behind", "min_id")


def due(spark, sf):
    return polling.due_pairs(B.registry(spark, sf), B.event_tags(spark, sf), B.cursors(spark, sf), NOW)


@check("due_pairs", q(EV, TAG, POLLS, CURSOR, "SELECT * FROM due"))
def _(spark, sf):
    return due(spark, sf)


@check("poll_plan", q(EV, TAG, POLLS, CURSOR, """
numbered AS (SELECT *, row_number() OVER (PARTITION BY tier, host ORDER BY overdue DESC, tag_id) AS place FROM due),
batched AS (SELECT *, CASE WHEN tier = 'hot' THEN place - 1 ELSE (place - 1) // 4 END AS batch_no FROM numbered),
jobs AS (SELECT tier, host, batch_no, string_agg(CAST(tag_id AS VARCHAR), ',' ORDER BY place) AS tag_ids,
  CASE WHEN count(*) = count(min_id)
    THEN coalesce(arg_min(min_id, try_cast(min_id AS HUGEINT)), arg_min(min_id, place)) END AS min_id
  FROM batched GROUP BY ALL)""", """
SELECT *, row_number() OVER (ORDER BY CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, batch_no, host) AS position
FROM jobs QUALIFY position <= 43"""))
def _(spark, sf):
    plan = polling.poll_plan(due(spark, sf))
    return plan.withColumn("tag_ids", F.array_join(F.transform("tag_ids", lambda x: x.cast("string")), ","))


def jobs(spark, sf):
    """Polls as jobs of ticks of 43."""
    return B.polls(spark, sf).select(
        F.floor(F.col("seq") / 43).alias("tick"), (F.col("seq") % 43 + 1).alias("position"), "bytes", "host"
    )


JOBS = """
job AS (SELECT seq // 43 AS tick, seq % 43 + 1 AS position, bytes, host FROM poll),
wave AS (SELECT tick, (position - 1) // 6 AS wave, sum(bytes) AS b FROM job GROUP BY 1, 2),
before AS (SELECT tick, wave, coalesce(sum(b) OVER (PARTITION BY tick ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           AS bytes_before FROM wave),
cut AS (SELECT j.*, w.wave, w.bytes_before, w.bytes_before < 1000000 AS run
        FROM job j JOIN before w ON w.tick = j.tick AND w.wave = (j.position - 1) // 6)"""


@check("byte_budget_cut", q(EV, POLLS, JOBS, "SELECT tick, position, wave, bytes_before, run FROM cut"))
def _(spark, sf):
    cut = polling.byte_budget_cut(jobs(spark, sf), ["tick"], 1_000_000)
    return cut.select("tick", "position", "wave", "bytes_before", "run")


@check("next_cursor", q(EV, """
page AS (SELECT event_id // 40 AS page_id, min(k) AS k, max(event_id) FILTER (WHERE event_id % 6 <> 0) AS newest FROM ev GROUP BY 1)""", """
SELECT page_id, CASE k % 3 WHEN 0 THEN CAST(page_id * 7 AS VARCHAR) WHEN 1 THEN CAST(newest + 1000000000000000000000 AS VARCHAR)
  ELSE CAST(newest + 1000000000000000000000 AS VARCHAR) END AS next_cursor FROM page"""))
def _(spark, sf):
    page = F.floor(F.col("event_id") / 40).alias("page_id")
    big = F.concat(F.lit("1"), F.lpad(F.col("event_id").cast("string"), 21, "0"))
    statuses = B.events(spark, sf).select(page, F.when(F.col("event_id") % 6 == 0, "x").otherwise(big).alias("id"))
    link = F.concat(F.lit('<https://a.example/t?max_id=1>; rel="next", <https://a.example/t?x=1&min_id='),
                    (F.col("page_id") * 7).cast("string"), F.lit('>; rel="prev"'))
    responses = B.events(spark, sf).groupBy(page).agg(F.min("k").alias("k")).select(
        "page_id", F.when(F.col("k") % 3 == 0, link).when(F.col("k") % 3 == 1, '<https://a.example/t?max_id=1>; rel="next"')
        .alias("link_header"))
    return polling.next_cursor(responses, statuses).select("page_id", "next_cursor")


@check("rate_limit_columns", q(EV, """
SELECT event_id, CASE WHEN k % 4 <> 3 THEN k END AS remaining,
  CASE k % 3 WHEN 0 THEN created_at WHEN 1 THEN created_at END AS reset FROM ev"""))
def _(spark, sf):
    k, at = F.col("k"), F.col("created_at")
    iso = F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    rows = B.events(spark, sf).select(
        "event_id", F.when(k % 4 == 3, "soon").otherwise(F.concat(k.cast("string"), F.lit(" left"))).alias("remaining_header"),
        F.when(k % 3 == 0, iso).when(k % 3 == 1, F.concat(at.cast("string"), F.lit(".7"))).otherwise("later").alias("reset_header"),
    )
    return polling.rate_limit_columns(rows).select("event_id", "remaining", "reset")


@check("tick_report", q(OBS, POLLS, JOBS, """
done AS (SELECT *, CASE WHEN seq % 17 = 1 THEN 'non_public' WHEN seq % 19 = 2 THEN 'malformed' END AS skip_reason, seq // 43 AS tick
         FROM eview),
tagged AS (SELECT d.*, t.id AS tag_id FROM (SELECT *, unnest(tags) AS name FROM done WHERE skip_reason IS NULL) d
           LEFT JOIN active t ON t.name = d.name),
a AS (SELECT tick, count(*) AS jobs_planned, count(*) FILTER (WHERE run) AS jobs_run, count(*) FILTER (WHERE NOT run) AS jobs_deferred,
  coalesce(sum(bytes) FILTER (WHERE run), 0) AS bytes_parsed FROM cut GROUP BY 1),
h AS (SELECT seq // 43 AS tick, count(DISTINCT host) FILTER (WHERE status = 200) AS hosts_ok,
  count(DISTINCT host) FILTER (WHERE status <> 200) AS hosts_failed FROM poll GROUP BY 1),
s AS (SELECT tick, count(*) FILTER (WHERE skip_reason IS NULL) AS posts_observed,
  count(*) FILTER (WHERE skip_reason = 'non_public') AS non_public, count(*) FILTER (WHERE skip_reason = 'malformed') AS malformed,
  0 AS suppressed FROM done GROUP BY 1),
w AS (SELECT tick, count(DISTINCT (tag_id, uri)) FILTER (WHERE tag_id IS NOT NULL) AS observations_written,
  count(DISTINCT (tag_id, created_at // 60)) FILTER (WHERE tag_id IS NOT NULL AND NOT is_boost) AS rollup_buckets,
  count(DISTINCT name) FILTER (WHERE tag_id IS NULL) AS candidates_seen,
  least(60, count(DISTINCT (name, author_hex)) FILTER (WHERE tag_id IS NULL)) AS candidates_written FROM tagged GROUP BY 1)""", """
SELECT tick, jobs_planned, jobs_run, jobs_deferred, bytes_parsed, hosts_ok, hosts_failed, coalesce(posts_observed, 0) AS posts_observed,
  coalesce(non_public, 0) AS non_public, coalesce(malformed, 0) AS malformed, coalesce(suppressed, 0) AS suppressed,
  coalesce(observations_written, 0) AS observations_written, coalesce(rollup_buckets, 0) AS rollup_buckets,
  coalesce(candidates_seen, 0) AS candidates_seen, coalesce(candidates_written, 0) AS candidates_written
FROM a LEFT JOIN h USING (tick) LEFT JOIN s USING (tick) LEFT JOIN w USING (tick)"""))
def _(spark, sf):
    from tagtide.operators import ingest

    tick = F.floor(F.col("seq") / 43)
    reason = F.when(F.col("seq") % 17 == 1, "non_public").when(F.col("seq") % 19 == 2, "malformed")
    done = B.event_views(spark, sf).withColumn("skip_reason", reason).withColumn("tick", tick)
    sightings = ingest.tag_sightings(ingest.kept_posts(done))
    cut = polling.byte_budget_cut(jobs(spark, sf), ["tick"], 1_000_000)
    polls = B.polls(spark, sf).withColumn("tick", tick)
    return maintenance.tick_report(cut, polls, done, sightings, B.event_tags(spark, sf), ["tick"])
