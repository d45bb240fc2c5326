"""Checks of evaluation, claims and the published reports, on flattened columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide import constants as C
from tagtide.functions import ratings as R
from tagtide.operators import overview as O, pool as P, trust, windows as W
from tagtide.plans import reports
from workload import bindings as B
from workload.activity import TRENDING, WINDOWED, overview
from workload.catalog import check
from workload.posts import REQUESTS, requests
from workload.sql import CANDIDATES, COUNTERS, NOW, OBS, OVERVIEW, POLLS, POOL, ROLLUP, q

DAY_AGO = NOW - 86400

# -- evaluation --------------------------------------------------------------

_SUMMARY = """
persrv AS (SELECT tag, host, sum(uses) AS u, sum(accounts) AS a, max(accounts) AS p FROM counters GROUP BY 1, 2),
told AS (SELECT tag, sum(u) AS uses_7d, sum(a) AS accounts_7d, max(p) AS peak_day_accounts, count(*) AS source_count
         FROM persrv GROUP BY 1)"""


@check("summarise_server_reports", q(POOL, COUNTERS, _SUMMARY, """
SELECT t.*, s.servers FROM told t JOIN (SELECT tag, string_agg(host || ':' || u || ':' || a, ',' ORDER BY host) AS servers
  FROM persrv GROUP BY 1) s USING (tag)"""))
def _(spark, sf):
    rows = trust.summarise_server_reports(B.counters(spark, sf))
    line = F.transform("per_server", lambda s: F.concat_ws(":", s["host"], s["uses_7d"].cast("string"), s["accounts_7d"].cast("string")))
    return rows.withColumn("servers", F.array_join(line, ",")).drop("per_server")


_EVALUATED = """
ev0 AS (SELECT c.request_id, c.tag, coalesce(o.display, c.display) AS display, c.place,
  CASE WHEN o.id IS NOT NULL THEN 'tracked' WHEN f.name IS NOT NULL THEN 'discovered' ELSE 'unseen' END AS standing,
  CASE WHEN o.id IS NOT NULL THEN o.authors_24h ELSE f.distinct_authors END AS authors_24h, o.posts_24h,
  CASE WHEN o.id IS NOT NULL THEN o.origin_servers_24h ELSE f.distinct_origin_servers END AS origin_servers_24h,
  CASE WHEN o.id IS NOT NULL THEN CASE WHEN o.authors_24h > 0 THEN floor(o.posts_24h / o.authors_24h * 10 + 0.5) / 10 END
       ELSE f.posts_per_author END AS posts_per_author, o.authors_1h
  FROM cand c LEFT JOIN overview o ON o.name = c.tag LEFT JOIN figures f ON f.name = c.tag),
ev1 AS (SELECT *, CASE WHEN origin_servers_24h > 0 THEN floor(authors_24h / origin_servers_24h * 10 + 0.5) / 10 END
  AS authors_per_server FROM ev0),
ev2 AS (SELECT e.*, t.uses_7d AS reported_uses_7d, t.accounts_7d AS reported_accounts_7d, t.source_count AS reported_sources,
  CASE WHEN standing = 'unseen' THEN CASE WHEN t.tag IS NULL THEN 'no_evidence' WHEN t.accounts_7d = 0 THEN 'reported_unused'
                                          ELSE 'reported_in_use' END
       WHEN coalesce(authors_24h, 0) = 0 THEN 'known_but_silent' WHEN authors_per_server > 5 THEN 'publisher'
       WHEN authors_24h < 10 AND posts_per_author >= 5 THEN 'few_repeating' ELSE 'many_accounts' END AS shape
  FROM ev1 e LEFT JOIN told t ON t.tag = e.tag AND e.standing = 'unseen'),
evaluated AS (SELECT *, CASE WHEN standing <> 'unseen' AND shape <> 'known_but_silent'
    THEN CASE WHEN coalesce(origin_servers_24h, 0) <= 1 THEN 'one_server' ELSE 'several_servers' END END AS spread,
  CASE WHEN standing <> 'unseen' AND shape <> 'known_but_silent' AND authors_1h IS NOT NULL
    THEN CASE WHEN authors_1h > 0 THEN 'active_last_hour' ELSE 'quiet_last_hour' END END AS recency,
  row_number() OVER (PARTITION BY request_id ORDER BY coalesce(authors_24h, -1) DESC, coalesce(origin_servers_24h, -1) DESC, tag)
    AS rank FROM ev2)"""
_EVAL_COLS = ["request_id", "rank", "tag", "display", "standing", "authors_24h", "posts_24h", "origin_servers_24h",
              "authors_per_server", "posts_per_author", "authors_1h", "shape", "spread", "recency", "reported_uses_7d",
              "reported_accounts_7d", "reported_sources"]


def _evaluated(spark, sf, *parts):
    return reports.evaluate_report(
        requests(spark, sf), B.observed(spark, sf), B.event_tags(spark, sf), B.pool(spark, sf), B.counters(spark, sf), NOW
    )


@check("evaluate_report", q(OBS, POOL, COUNTERS, _SUMMARY, CANDIDATES, OVERVIEW, REQUESTS, _EVALUATED,
                            f"SELECT {', '.join(_EVAL_COLS)} FROM evaluated"))
def _(spark, sf):
    return _evaluated(spark, sf).select(*_EVAL_COLS)


@check("candidate_standing", q(OBS, POOL, CANDIDATES, OVERVIEW, """
SELECT DISTINCT w.name AS tag, CASE WHEN o.id IS NOT NULL THEN 'tracked' WHEN f.name IS NOT NULL THEN 'discovered'
  ELSE 'unseen' END AS standing, CASE WHEN o.id IS NOT NULL THEN o.authors_24h ELSE f.distinct_authors END AS authors_24h
FROM (SELECT name FROM words UNION SELECT name FROM tag) w LEFT JOIN overview o USING (name) LEFT JOIN figures f USING (name)"""))
def _(spark, sf):
    names = B.word_rows(spark, sf).select("name").union(B.event_tags(spark, sf).select("name")).distinct()
    asked = names.select(F.col("name").alias("tag"), F.col("name").alias("display"))
    stats = P.candidate_stats(B.pool(spark, sf), names, NOW - 172800)
    evidence = trust.name_evidence(asked.select("tag"), overview(spark, sf), stats)
    return trust.candidate_standing(asked, evidence).select("tag", "standing", "authors_24h")


@check("compare_report", q(OBS, POOL, COUNTERS, _SUMMARY, CANDIDATES, OVERVIEW, ROLLUP,
    REQUESTS.replace("item AS (SELECT request_id, unnest(l) AS raw0, generate_subscripts(l, 1) - 1 AS position FROM req)",
                     "item AS (SELECT request_id, unnest(l[1:4]) AS raw0, generate_subscripts(l[1:4], 1) - 1 AS position FROM req)"),
    _EVALUATED, f"""
day AS (SELECT t.name AS tag, sum(r.posts) AS posts FROM active t JOIN rollup r ON r.tag_id = t.id
  AND r.minute > {NOW} // 60 - 1440 AND r.minute <= {NOW} // 60 GROUP BY 1)""", """
SELECT e.request_id, e.rank, e.tag, e.standing, e.authors_24h,
  CASE WHEN e.standing = 'tracked' THEN coalesce(d.posts, 0) END AS hourly_total,
  (SELECT count(DISTINCT standing) FROM evaluated x WHERE x.request_id = e.request_id) <= 1 AS comparable
FROM evaluated e LEFT JOIN day d USING (tag)"""))
def _(spark, sf):
    rows = reports.compare_report(
        requests(spark, sf), B.observed(spark, sf), B.event_tags(spark, sf), B.pool(spark, sf), B.counters(spark, sf),
        B.rollups(spark, sf), NOW,
    )
    total = F.aggregate("hourly", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("request_id", "rank", "tag", "standing", "authors_24h", total.alias("hourly_total"), "comparable")


# -- claims ------------------------------------------------------------------


def claims(spark, sf):
    """Every claim and scope for the known tags, and one of each kind per word of the documents."""
    every = F.explode(F.array(*[F.lit(c) for c in (*C.CLAIMS, "best")])).alias("claim")
    scopes = F.explode(F.array(F.lit("index"), F.lit("fediverse"))).alias("scope")
    tags = B.event_tags(spark, sf).select(F.col("name").alias("tag"), every).select("tag", "claim", scopes)
    n = F.length("name")
    words = B.word_rows(spark, sf).select("name").distinct().select(
        F.col("name").alias("tag"), F.get(F.array(*[F.lit(c) for c in C.CLAIMS]), n % 6).alias("claim"),
        F.when(n % 5 == 0, "fediverse").otherwise("elsewhere").alias("scope"))
    both = tags.unionByName(words)
    return both.withColumn("claim_id", F.concat_ws("|", "tag", "claim", "scope"))


_CLAIMS = """
asked AS (SELECT tag || '|' || claim || '|' || scope AS claim_id, tag, claim,
    CASE WHEN scope = 'fediverse' THEN scope ELSE 'index' END AS scope FROM (
  SELECT name AS tag, claim, scope FROM tag,
    (SELECT unnest(['rising', 'falling', 'busy', 'quiet', 'in_use', 'unused']) AS claim), (SELECT unnest(['index', 'fediverse']) AS scope)
  UNION ALL SELECT DISTINCT name, (['rising', 'falling', 'busy', 'quiet', 'in_use', 'unused'])[len(name) % 6 + 1],
    CASE WHEN len(name) % 5 = 0 THEN 'fediverse' ELSE 'elsewhere' END FROM words)),
med AS (SELECT tag_id, quantile_cont(CAST(bit_count(seen_mask) AS DOUBLE), 0.5) AS m FROM orig
        WHERE created_at >= {day} AND created_at < {now} GROUP BY 1),
evid AS (SELECT a.*, CASE WHEN o.id IS NOT NULL THEN 'tracked' WHEN f.name IS NOT NULL THEN 'discovered' ELSE 'unseen' END AS standing,
    o.authors_24h, o.authors_1h, o.authors_prev_1h, c.ok,
    CASE WHEN o.id IS NOT NULL THEN CASE WHEN m / (SELECT count(*) FROM monitored) >= 0.5 THEN 'good'
      WHEN m / (SELECT count(*) FROM monitored) >= 0.2 THEN 'partial' ELSE 'thin' END END AS coverage,
    CASE WHEN o.id IS NULL THEN f.distinct_authors END AS sighting_authors,
    CASE WHEN o.id IS NULL THEN t.accounts_7d END AS reported_accounts_7d
  FROM asked a LEFT JOIN overview o ON o.name = a.tag LEFT JOIN med ON med.tag_id = o.id LEFT JOIN figures f ON f.name = a.tag
  LEFT JOIN told t ON t.tag = a.tag, comparable c),
facts AS (SELECT *, CASE WHEN standing = 'discovered' AND coalesce(sighting_authors, 0) > 0 THEN 'sighted'
      WHEN coalesce(reported_accounts_7d, 0) > 0 THEN 'server_reported' ELSE 'no_evidence' END AS fallback,
    coalesce(authors_24h, 0) > 0 AS seen,
    CASE WHEN authors_prev_1h = 0 THEN 1 ELSE (authors_1h - authors_prev_1h) / authors_prev_1h END AS change FROM evid),
moved AS (SELECT *, CASE WHEN abs(change) < 0.1 THEN 'flat' WHEN change > 0 THEN 'rising' ELSE 'falling' END AS actual FROM facts),
judged AS (SELECT *, CASE WHEN scope = 'fediverse' THEN 'blocked|no_complete_view|' || CASE WHEN standing = 'tracked' AND seen THEN 'observed' ELSE fallback END
  WHEN claim IN ('rising', 'falling') THEN CASE WHEN standing <> 'tracked' THEN 'blocked|not_polled|' || fallback
      WHEN NOT ok THEN 'blocked|coverage_changed|observed' WHEN greatest(authors_1h, authors_prev_1h) < 5 THEN 'blocked|too_few_authors|observed'
      WHEN actual = claim THEN 'allowed|direction_matches|' || actual WHEN actual = 'flat' THEN 'blocked|data_says_flat|flat'
      ELSE 'blocked|data_says_opposite|' || actual END
  WHEN claim = 'busy' THEN CASE WHEN standing <> 'tracked' OR NOT seen THEN 'blocked|nothing_observed|' || fallback
      WHEN coverage = 'thin' THEN 'qualified|judgement_thin_coverage|observed' ELSE 'qualified|judgement|observed' END
  WHEN claim = 'quiet' THEN CASE WHEN standing <> 'tracked' THEN 'blocked|not_polled|' || fallback
      WHEN coalesce(coverage, 'thin') = 'thin' THEN 'blocked|coverage_thin|observed' ELSE 'qualified|judgement|observed' END
  WHEN claim = 'in_use' THEN CASE WHEN seen THEN 'allowed|positive_evidence|observed'
      WHEN coalesce(sighting_authors, 0) > 0 OR coalesce(reported_accounts_7d, 0) > 0 THEN 'allowed|positive_evidence|' || fallback
      ELSE 'blocked|no_evidence|' || fallback END
  ELSE CASE WHEN seen THEN 'blocked|observed_in_use|observed' ELSE 'blocked|absence_is_not_evidence|' || fallback END END AS v FROM moved)"""
_CLAIMS = _CLAIMS.replace("{day}", str(DAY_AGO)).replace("{now}", str(NOW))


@check("check_claims", q(OBS, POLLS, POOL, COUNTERS, _SUMMARY, CANDIDATES, OVERVIEW, _CLAIMS, """
SELECT claim_id, tag, claim, scope, split_part(v, '|', 1) AS verdict, split_part(v, '|', 2) AS reason, split_part(v, '|', 3) AS may_say,
  standing, coverage, sighting_authors, reported_accounts_7d FROM judged"""))
def _(spark, sf):
    rows = reports.check_claims(
        claims(spark, sf), B.observed(spark, sf), B.event_tags(spark, sf), B.registry(spark, sf), B.polls(spark, sf),
        B.pool(spark, sf), B.counters(spark, sf), NOW,
    )
    return rows.select("claim_id", "tag", "claim", "scope", "verdict", "reason", "may_say", "standing", "coverage",
                       "sighting_authors", "reported_accounts_7d")


# -- reports -----------------------------------------------------------------


def tag_reports(spark, sf):
    return reports.tag_report(
        B.observed(spark, sf), B.event_tags(spark, sf), B.registry(spark, sf), B.polls(spark, sf), B.tag_history(spark, sf), NOW
    )


_REPORT = f"""
med AS (SELECT tag_id, quantile_cont(CAST(bit_count(seen_mask) AS DOUBLE), 0.5) AS m FROM orig
        WHERE created_at >= {DAY_AGO} AND created_at < {NOW} GROUP BY 1),
org AS (SELECT tag_id, origin_host, count(*) AS n FROM orig WHERE created_at >= {DAY_AGO} AND created_at < {NOW} GROUP BY 1, 2),
orgs AS (SELECT tag_id, count(*) AS unique_origin_servers, arg_max(origin_host, n * 1000 - CAST(regexp_extract(origin_host, '[0-9]+') AS INTEGER))
         AS by_number, max(n) AS top_posts FROM org GROUP BY 1),
hist AS (SELECT tag_id, count(DISTINCT (host, created_at // 86400)) AS days FROM credited GROUP BY 1),
w24 AS (SELECT * FROM windowst WHERE "window" = '24h'), w1 AS (SELECT * FROM windowst WHERE "window" = '1h')"""


@check("tag_report", q(OBS, POLLS, WINDOWED, _REPORT, """
SELECT t.id AS tag_id, t.name AS tag, coalesce(t.display, t.name) AS display, t.tracked,
  CASE WHEN tracked THEN 'tracked' WHEN retired_at IS NOT NULL THEN 'retired' ELSE 'queued' END AS tracking_state, t.tier,
  CASE t.tier WHEN 'cold' THEN 1800 ELSE 300 END AS poll_interval_seconds, w24.posts_observed AS posts_24h,
  w24.authors_observed AS authors_24h, w24.trend AS trend_24h, w1.posts_observed AS posts_1h, w1.trend AS trend_1h,
  w24.instances_reporting, (SELECT count(*) FROM monitored) AS instances_monitored,
  (SELECT string_agg(host, ',' ORDER BY host) FROM monitored WHERE host NOT IN (SELECT host FROM collectable)) AS degraded,
  m AS median_instances_per_post, CASE WHEN m / (SELECT count(*) FROM monitored) >= 0.5 THEN 'good'
    WHEN m / (SELECT count(*) FROM monitored) >= 0.2 THEN 'partial' ELSE 'thin' END AS quality,
  coalesce(unique_origin_servers, 0) AS unique_origin_servers, top_posts,
  (SELECT max(last_ok_at) FROM registry) AS last_successful_update,
  CASE WHEN w24.posts_observed = 0 THEN days END AS counter_days
FROM tag t JOIN w24 ON w24.id = t.id JOIN w1 ON w1.id = t.id LEFT JOIN med ON med.tag_id = t.id LEFT JOIN orgs ON orgs.tag_id = t.id
LEFT JOIN hist ON hist.tag_id = t.id"""))
def _(spark, sf):
    day, hour = F.col("windows")["24h"], F.col("windows")["1h"]
    return tag_reports(spark, sf).select(
        "tag_id", "tag", "display", "tracked", "tracking_state", "tier", "poll_interval_seconds",
        day["posts_observed"].alias("posts_24h"), day["authors_observed"].alias("authors_24h"), day["trend"].alias("trend_24h"),
        hour["posts_observed"].alias("posts_1h"), hour["trend"].alias("trend_1h"), "instances_reporting", "instances_monitored",
        F.array_join("instances_degraded", ",").alias("degraded"), "median_instances_per_post", "quality",
        "unique_origin_servers", F.get("origins", F.lit(0))["posts_observed"].alias("top_posts"), "last_successful_update",
        F.size("server_counters").alias("counter_days"),
    )


@check("lookup_report", q(OBS, POLLS, WINDOWED, _REPORT, f"""
SELECT t.id AS tag_id, CASE WHEN w24.posts_observed > 0 THEN 'ok' ELSE 'insufficient_data' END AS status,
  w1.posts_observed, w1.authors_observed,
  CASE WHEN w1.authors_observed > 0 THEN floor(w1.posts_observed / w1.authors_observed * 10 + 0.5) / 10 END AS posts_per_author,
  CASE WHEN NOT w1.coverage_comparable THEN 'not_comparable' WHEN w1.trend IS NULL THEN 'insufficient'
       WHEN w1.trend > 0.1 THEN 'up' WHEN w1.trend < -0.1 THEN 'down' ELSE 'flat' END AS direction,
  floor(w1.trend * 100 + 0.5) / 100 AS change,
  CASE WHEN w24.posts_observed = 0 THEN CASE WHEN NOT t.tracked THEN 'no_capacity' WHEN t.first_seen_at = {NOW} THEN 'just_registered'
    ELSE 'nothing_observed' END END AS reason,
  CASE WHEN w24.posts_observed = 0 THEN CASE WHEN t.tracked THEN 'ask_after_next_collection' ELSE 'wait_for_free_slot' END END
    AS what_would_change_it
FROM tag t JOIN w24 ON w24.id = t.id JOIN w1 ON w1.id = t.id"""))
def _(spark, sf):
    return reports.lookup_report(tag_reports(spark, sf), "1h").drop("tag", "quality")


@check("tracked_listing", q(OBS, OVERVIEW, """
SELECT row_number() OVER (ORDER BY authors_24h DESC, posts_24h DESC, name) AS rank, name AS tag, coalesce(display, name) AS display, tier,
  posts_24h AS posts_observed, authors_24h AS authors_observed,
  CASE WHEN authors_24h > 0 THEN floor(posts_24h / authors_24h * 10 + 0.5) / 10 END AS posts_per_author,
  posts_1h AS posts_observed_1h, authors_1h AS authors_observed_1h, origin_servers_24h AS origin_servers, first_seen_at,
  least(1, greatest(0, authors_24h / (SELECT greatest(1, max(authors_24h)) FROM overview))) AS share_of_peak FROM overview"""))
def _(spark, sf):
    return reports.tracked_listing(overview(spark, sf))


@check("discovered_listing", q(OBS, POOL, CANDIDATES, """
SELECT row_number() OVER (ORDER BY distinct_origin_servers DESC, distinct_authors DESC, name) AS rank, name AS tag,
  distinct_authors AS authors_observed, distinct_origin_servers AS origin_servers, posts_per_author, mean_tags_per_post,
  coalesce(mean_tags_per_post >= 10, FALSE) AS looks_like_tag_spam,
  floor(distinct_authors / distinct_origin_servers * 10 + 0.5) / 10 AS authors_per_server,
  distinct_origin_servers >= 3 AND distinct_authors / distinct_origin_servers <= 5 AS would_promote, first_seen
FROM figures WHERE distinct_authors >= 5 AND name NOT IN (SELECT name FROM tag WHERE tracked OR blocked) QUALIFY rank <= 60"""))
def _(spark, sf):
    return reports.discovered_listing(B.pool(spark, sf), B.event_tags(spark, sf), NOW)


@check("trending_report", q(OBS, POLLS, OVERVIEW, TRENDING.format(ok="ok"), f"""
posts AS (SELECT tag_id, string_agg(url, ',' ORDER BY created_at DESC, uri) AS recent FROM (
  SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY created_at DESC, uri) AS rn FROM orig
  WHERE NOT sensitive AND url IS NOT NULL AND created_at >= {NOW} - 3600) WHERE rn <= 2 GROUP BY 1)""", """
SELECT t.rank, t.tag, t.display, t.authors_1h, t.posts_1h, t.direction, t.authors_previous_1h, t.change, t.reason,
  coalesce(p.recent, '') AS recent, (SELECT ok FROM comparable) AS hours_comparable FROM trended t LEFT JOIN posts p ON p.tag_id = t.id"""))
def _(spark, sf):
    rows = reports.trending_report(
        B.observed(spark, sf), B.event_tags(spark, sf), B.registry(spark, sf), B.polls(spark, sf), NOW, 10)
    recent = F.array_join(F.transform("recent_posts", lambda p: p["url"]), ",")
    return rows.select("rank", "tag", "display", "authors_1h", "posts_1h", "direction", "authors_previous_1h", "change", "reason",
                       recent.alias("recent"), "hours_comparable")


@check("timeseries_report", q(OBS, ROLLUP, f"""
SELECT t.name AS tag, minute * 60 AS "at", posts AS posts_observed, instances_reporting FROM rollup JOIN tag t ON t.id = tag_id
WHERE minute >= {DAY_AGO} // 60 AND minute < {NOW} // 60 + 1"""))
def _(spark, sf):
    return reports.timeseries_report(B.rollups(spark, sf), B.event_tags(spark, sf), NOW)


@check("posts_report", q(OBS, f"""
SELECT t.name AS tag, row_number() OVER (PARTITION BY tag_id ORDER BY created_at DESC, uri) AS rank, url, created_at, origin_host
FROM orig JOIN tag t ON t.id = tag_id WHERE NOT sensitive AND url IS NOT NULL AND created_at >= {DAY_AGO} QUALIFY rank <= 10"""))
def _(spark, sf):
    return reports.posts_report(B.observed(spark, sf), B.event_tags(spark, sf), NOW)


_SHAPES = """
act AS (SELECT *, CASE WHEN origin_servers_24h > 0 THEN floor(authors_24h / origin_servers_24h * 10 + 0.5) / 10 ELSE 0 END AS r
        FROM overview WHERE authors_24h > 0),
peaks AS (SELECT max(authors_24h) AS ma, greatest(10, max(r)) AS mr, greatest(1, max(posts_24h)) AS mp FROM act),
shapes AS (SELECT id, r AS authors_per_server,
  CASE WHEN ma > 1 THEN (ln(1 + authors_24h) - ln(2)) / (ln(1 + ma) - ln(2)) ELSE 0.5 END AS authors_share,
  (ln(1 + r) - ln(2)) / (ln(1 + mr) - ln(2)) AS concentration_share, sqrt(posts_24h / mp) AS volume_share,
  (ln(6) - ln(2)) / (ln(1 + mr) - ln(2)) AS threshold_share, r > 5 AS above_threshold FROM act, peaks)"""
_R6 = lambda c: f"floor({c} * 1000000 + 0.5) / 1000000 AS {c}"


def _six(col):
    return (F.floor(F.col(col) * 1000000 + 0.5) / 1000000).alias(col)


@check("shape_features", q(OBS, OVERVIEW, _SHAPES, f"""
SELECT id, authors_per_server, {_R6('authors_share')}, {_R6('concentration_share')}, {_R6('volume_share')}, {_R6('threshold_share')},
       above_threshold FROM shapes"""))
def _(spark, sf):
    return reports.shape_features(overview(spark, sf)).select(
        "id", "authors_per_server", _six("authors_share"), _six("concentration_share"), _six("volume_share"),
        _six("threshold_share"), "above_threshold")


@check("explore_report", q(OBS, OVERVIEW, ROLLUP, _SHAPES, f"""
grid AS (SELECT t.id, b.bucket, coalesce(sum(r.posts), 0) AS posts FROM active t, (SELECT unnest(range(24)) AS bucket) b
  LEFT JOIN rollup r ON r.tag_id = t.id AND r.minute // 60 = {NOW} // 3600 - 23 + b.bucket GROUP BY ALL),
peak AS (SELECT id, greatest(1, max(posts)) AS p FROM grid GROUP BY 1)""", f"""
SELECT o.id, o.name, o.tier, o.authors_24h, g.bucket, floor(g.posts / p.p * 1000000 + 0.5) / 1000000 AS rhythm,
  {_R6('authors_share')}, s.above_threshold
FROM overview o JOIN grid g USING (id) JOIN peak p USING (id) LEFT JOIN shapes s USING (id)"""))
def _(spark, sf):
    rows = reports.explore_report(B.observed(spark, sf), B.rollups(spark, sf), B.event_tags(spark, sf), NOW)
    long = rows.select("id", "name", "tier", "authors_24h", "authors_share", "above_threshold",
                       F.posexplode("rhythm").alias("bucket", "rhythm"))
    return long.select("id", "name", "tier", "authors_24h", "bucket", _six("rhythm"), _six("authors_share"), "above_threshold")
