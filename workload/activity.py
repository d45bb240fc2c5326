"""Checks of windows, overviews, the pool and the policies over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide import constants as C
from tagtide.functions import ratings as R, text as X
from tagtide.operators import overview as O, policy, pool as P, windows as W
from tagtide.plans import maintenance, reports
from workload import bindings as B
from workload.catalog import check
from workload.sql import CANDIDATES, NOW, OBS, OVERVIEW, POLLS, POOL, ROLLUP, TRADE, TRADE_NOW, q

DAY_AGO, YEAR_AGO = NOW - 86400, TRADE_NOW - 365 * 86400

# -- counts and masks --------------------------------------------------------


@check("window_counts_trade", q(TRADE, f"""
SELECT t.id, t.name, count(*) FILTER (WHERE NOT is_boost) AS posts_observed,
  count(DISTINCT acct) FILTER (WHERE NOT is_boost) AS authors_observed, count(*) FILTER (WHERE is_boost) AS boosts_observed
FROM ttag t LEFT JOIN tobs o ON o.tag_id = t.id AND created_at >= {YEAR_AGO} AND created_at < {TRADE_NOW} GROUP BY t.id, t.name"""))
def window_counts_trade(spark, sf):
    return W.window_counts(B.trade_observed(spark, sf), B.trade_tags(spark, sf), YEAR_AGO, TRADE_NOW)


@check("window_counts_events", q(OBS, f"""
SELECT t.id, t.name, count(*) FILTER (WHERE NOT is_boost) AS posts_observed,
  count(DISTINCT author_hex) FILTER (WHERE NOT is_boost) AS authors_observed,
  count(*) FILTER (WHERE is_boost) AS boosts_observed
FROM tag t LEFT JOIN obs o ON o.tag_id = t.id AND created_at >= {NOW} - 3600 AND created_at < {NOW} GROUP BY t.id, t.name"""))
def _(spark, sf):
    return W.window_counts(B.observed(spark, sf), B.event_tags(spark, sf), NOW - 3600, NOW)


@check("mask_distribution", q(TRADE, f"""
SELECT tag_id, seen_mask AS mask, count(*) AS posts FROM torig
WHERE created_at >= {YEAR_AGO} AND created_at < {TRADE_NOW} GROUP BY 1, 2"""))
def _(spark, sf):
    return W.mask_distribution(B.trade_observed(spark, sf), YEAR_AGO, TRADE_NOW)


_MEDIAN = "quantile_cont(CAST(bit_count(seen_mask) AS DOUBLE), 0.5)"


@check("weighted_median_popcount", q(TRADE, f"""
SELECT tag_id, {_MEDIAN} AS median_instances_per_post FROM torig
WHERE created_at >= {YEAR_AGO} AND created_at < {TRADE_NOW} GROUP BY 1"""))
def _(spark, sf):
    return W.weighted_median_popcount(W.mask_distribution(B.trade_observed(spark, sf), YEAR_AGO, TRADE_NOW))


@check("median_instances_per_post", q(OBS, f"""
SELECT tag_id, {_MEDIAN} AS median_instances_per_post FROM orig
WHERE created_at >= {DAY_AGO} AND created_at < {NOW} GROUP BY 1"""))
def _(spark, sf):
    return W.median_instances_per_post(B.observed(spark, sf), DAY_AGO, NOW)


_GRADE = "CASE WHEN m / {n} >= 0.5 THEN 'good' WHEN m / {n} >= 0.2 THEN 'partial' ELSE 'thin' END"


@check("coverage_grades_nations", q(TRADE, f"""
SELECT tag_id, m AS median_instances_per_post, {_GRADE.format(n='(SELECT count(*) FROM treg WHERE NOT opt_out AND capability = $$timeline$$)')} AS quality
FROM (SELECT tag_id, {_MEDIAN} AS m FROM torig WHERE created_at >= {YEAR_AGO} AND created_at < {TRADE_NOW} GROUP BY 1)"""))
def _(spark, sf):
    monitored = reports.monitored_count(B.trade_registry(spark, sf))
    return W.coverage_grades(B.trade_observed(spark, sf), monitored, YEAR_AGO, TRADE_NOW)


@check("coverage_grades_regions", q(TRADE, f"""
rseen AS (SELECT l_orderkey, bit_or(CAST(1 AS BIGINT) << n_regionkey) AS seen_mask FROM tline
          JOIN nation ON n_nationkey = s GROUP BY 1),
robs AS (SELECT n.name, x.seen_mask FROM rseen x JOIN tpost p ON p.o_orderkey = x.l_orderkey
         JOIN tname n ON n.o_orderkey = p.o_orderkey
         WHERE NOT is_boost AND created_at >= {YEAR_AGO} AND created_at < {TRADE_NOW})""", f"""
SELECT t.id AS tag_id, m AS median_instances_per_post, {_GRADE.format(n='5')} AS quality
FROM (SELECT name, {_MEDIAN} AS m FROM robs GROUP BY 1) JOIN ttag t USING (name)"""))
def _(spark, sf):
    """Regions as servers: few enough that grades differ from thin."""
    from tagtide.operators import ingest

    nation = B.trade_registry(spark, sf).select("host", "region")
    views = B.trade_views(spark, sf).join(nation, "host").withColumn("host", F.concat(F.lit("r"), F.col("region").cast("string")))
    servers = B.table(spark, sf, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("host"), F.col("r_regionkey").cast("int").alias("bit")
    )
    observed = ingest.observations(views.drop("region"), B.trade_tags(spark, sf), servers)
    return W.coverage_grades(observed, servers.agg(F.count("*")).scalar(), YEAR_AGO, TRADE_NOW)


@check("origin_breakdown", q(TRADE, f"""
SELECT tag_id, origin_host AS host, count(*) AS posts_observed,
  row_number() OVER (PARTITION BY tag_id ORDER BY count(*) DESC, origin_host) AS rank FROM torig
WHERE created_at >= {YEAR_AGO} AND created_at < {TRADE_NOW} GROUP BY 1, 2 QUALIFY rank <= 20"""))
def _(spark, sf):
    return W.origin_breakdown(B.trade_observed(spark, sf), YEAR_AGO, TRADE_NOW)


@check("distinct_origins", q(TRADE, f"""
SELECT tag_id, count(DISTINCT origin_host) AS unique_origin_servers FROM torig
WHERE created_at >= {YEAR_AGO} AND created_at < {TRADE_NOW} GROUP BY 1"""))
def _(spark, sf):
    return W.distinct_origins(B.trade_observed(spark, sf), YEAR_AGO, TRADE_NOW)


@check("instances_reporting", q(OBS, POLLS, f"""
SELECT count(DISTINCT host) AS instances_reporting FROM poll WHERE "at" >= {NOW} - 3600 AND "at" < {NOW} AND status = 200"""))
def _(spark, sf):
    return W.instances_reporting(B.polls(spark, sf), NOW - 3600, NOW)


@check("reporting_counts", q(OBS, POLLS, "SELECT cur AS current, prev AS previous FROM hours"))
def _(spark, sf):
    return W.reporting_counts(B.polls(spark, sf), {"current": (NOW - 3600, NOW), "previous": (NOW - 7200, NOW - 3600)})


@check("coverage_comparable", q(OBS, POLLS, "SELECT ok AS comparable FROM comparable"))
def _(spark, sf):
    flag = reports.hours_comparable(B.registry(spark, sf), B.polls(spark, sf), NOW)
    return B.registry(spark, sf).agg(F.count("*").alias("n")).select(flag.alias("comparable"))


@check("reporting_masks", q(OBS, f"""
SELECT DISTINCT tag_id, seen_mask AS mask FROM obs WHERE created_at >= {DAY_AGO} AND created_at < {NOW}"""))
def _(spark, sf):
    return W.reporting_masks(B.observed(spark, sf), DAY_AGO, NOW)


@check("reporting_hosts", q(OBS, f"""
SELECT DISTINCT tag_id, host FROM credited WHERE created_at >= {DAY_AGO} AND created_at < {NOW}"""))
def _(spark, sf):
    return W.reporting_hosts(B.observed(spark, sf), B.registry(spark, sf), DAY_AGO, NOW)


@check("coverage_overlap", q(OBS, f"""
per AS (SELECT tag_id, host, count(DISTINCT uri) AS n FROM credited
        WHERE NOT is_boost AND created_at >= {DAY_AGO} AND created_at < {NOW} GROUP BY 1, 2),
tot AS (SELECT tag_id, count(*) AS unique_posts FROM orig WHERE created_at >= {DAY_AGO} AND created_at < {NOW} GROUP BY 1)""", """
SELECT tag_id, any_value(unique_posts) AS unique_posts, max(n) AS largest_server_posts,
       any_value(unique_posts) - max(n) AS extra_posts FROM tot JOIN per USING (tag_id) GROUP BY 1"""))
def _(spark, sf):
    return W.coverage_overlap(B.observed(spark, sf), B.registry(spark, sf), DAY_AGO, NOW)


@check("server_overlap", q(TRADE, f"""
v AS (SELECT DISTINCT l_orderkey, s FROM tline JOIN tpost ON o_orderkey = l_orderkey
      WHERE NOT is_boost AND created_at >= {YEAR_AGO} AND created_at < {TRADE_NOW})""", """
SELECT 'n' || a.s || '.example' AS server_a, 'n' || b.s || '.example' AS server_b, count(*) AS shared_posts
FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND a.s < b.s GROUP BY 1, 2"""))
def _(spark, sf):
    return W.server_overlap(B.trade_observed(spark, sf), B.trade_registry(spark, sf), YEAR_AGO, TRADE_NOW)


@check("lag_stats", q(OBS, f"""
SELECT tag_id, quantile_cont(CAST(observed_at - created_at AS DOUBLE), 0.5) AS median_lag,
  floor(sum(observed_at - created_at) / count(*) * 10 + 0.5) / 10 AS mean_lag, max(observed_at - created_at) AS max_lag
FROM orig WHERE created_at >= {NOW} - 604800 AND created_at < {NOW} GROUP BY 1"""))
def _(spark, sf):
    return W.lag_stats(B.observed(spark, sf), NOW - 604800, NOW)


@check("language_mix", q(OBS, f"""
SELECT tag_id, language, count(*) AS posts, count(*) FILTER (WHERE sensitive) AS sensitive_posts FROM orig
WHERE created_at >= {NOW} - 604800 AND created_at < {NOW} GROUP BY 1, 2"""))
def _(spark, sf):
    return W.language_mix(B.observed(spark, sf), NOW - 604800, NOW)


@check("corroboration_gap", q(OBS, f"""
hist AS (SELECT tag_id, host, created_at // 86400 * 86400 AS day, count(*) AS uses, count(DISTINCT author_hex) AS accounts
         FROM credited GROUP BY ALL),
daily AS (SELECT tag_id, created_at // 86400 * 86400 AS day, count(*) AS posts_observed,
                 count(DISTINCT author_hex) AS authors_observed FROM orig
          WHERE created_at >= {NOW} - 604800 AND created_at < {NOW} GROUP BY 1, 2)""", """
SELECT tag_id, day, posts_observed, authors_observed, host, uses, accounts, uses - posts_observed AS uses_gap
FROM daily LEFT JOIN hist USING (tag_id, day)"""))
def _(spark, sf):
    return W.corroboration_gap(B.observed(spark, sf), B.tag_history(spark, sf), NOW - 604800, NOW)


@check("minute_rollup", q(OBS, """
touched AS (SELECT DISTINCT tag_id, created_at // 60 AS minute FROM obs)""", """
SELECT t.tag_id, t.minute, count(o.uri) AS posts, 9 AS instances_reporting
FROM touched t LEFT JOIN orig o ON o.tag_id = t.tag_id AND o.created_at // 60 = t.minute GROUP BY 1, 2"""))
def _(spark, sf):
    observed = B.observed(spark, sf)
    touched = observed.select("tag_id", F.floor(F.col("created_at") / 60).alias("minute")).distinct()
    return W.minute_rollup(observed, F.lit(9), touched)


@check("upsert_rollups", q(OBS, ROLLUP, """
SELECT tag_id, minute, CASE WHEN minute % 2 = 0 THEN posts + 1 ELSE posts END AS posts, 9 AS instances_reporting FROM rollup"""))
def _(spark, sf):
    from tagtide.operators import merges

    stored = B.rollups(spark, sf)
    again = stored.filter(F.col("minute") % 2 == 0).withColumns(
        {"posts": F.col("posts") + 1, "instances_reporting": F.lit(4).cast("bigint")}
    )
    return merges.upsert_rollups(stored, again)


@check("timeseries", q(OBS, ROLLUP, f"""
SELECT * FROM rollup WHERE minute >= {DAY_AGO} // 60 AND minute < {NOW} // 60 + 1"""))
def _(spark, sf):
    return W.timeseries(B.rollups(spark, sf), DAY_AGO // 60, NOW // 60 + 1)


def _windows_sql(table: str, author: str, tags: str, spans: dict, now: int, reporting: str) -> str:
    parts = []
    for key, sec in spans.items():
        a, b, c = now - sec, now, now - 2 * sec
        parts.append(f"""
SELECT t.id, t.name, '{key}' AS "window", {sec} AS seconds,
  count(*) FILTER (WHERE NOT is_boost AND created_at >= {a}) AS posts_observed,
  count(DISTINCT {author}) FILTER (WHERE NOT is_boost AND created_at >= {a}) AS authors_observed,
  count(*) FILTER (WHERE is_boost AND created_at >= {a}) AS boosts_observed,
  count(*) FILTER (WHERE NOT is_boost AND created_at < {a}) AS posts_previous, any_value(r.cur) AS cur,
  any_value(r.prev) AS prev
FROM {tags} t LEFT JOIN {table} o ON o.tag_id = t.id AND created_at >= {c} AND created_at < {b},
  (SELECT count(DISTINCT host) FILTER (WHERE "at" >= {a} AND "at" < {b}) AS cur,
          count(DISTINCT host) FILTER (WHERE "at" >= {c} AND "at" < {a}) AS prev FROM {reporting}) r
GROUP BY t.id, t.name""")
    return "raww AS (" + " UNION ALL ".join(parts) + """),
windowed AS (SELECT * EXCLUDE (cur, prev), cur AS instances_reporting,
  cur / mon >= 0.6 AND prev / mon >= 0.6 AND abs(cur - prev) / mon <= 0.25 AS coverage_comparable
  FROM raww, (SELECT count(*) AS mon FROM monitored)),
windowst AS (SELECT *, CASE WHEN coverage_comparable AND posts_previous > 0
  THEN (posts_observed - posts_previous) / posts_previous END AS trend FROM windowed)"""


WINDOWED = _windows_sql("obs", "author_hex", "tag", C.WINDOWS, NOW, "(SELECT * FROM poll WHERE status = 200)")


@check("multi_window_report", q(OBS, POLLS, WINDOWED, """
SELECT id, name, "window", seconds, posts_observed, authors_observed, boosts_observed, posts_previous, trend,
       coverage_comparable, instances_reporting FROM windowst"""))
def _(spark, sf):
    monitored = reports.monitored_count(B.registry(spark, sf))
    return W.multi_window_report(B.observed(spark, sf), B.event_tags(spark, sf), B.polls(spark, sf), monitored, NOW)


@check("window_direction", q(OBS, POLLS, WINDOWED, """
SELECT id, "window", CASE WHEN NOT coverage_comparable THEN 'not_comparable' WHEN trend IS NULL THEN 'insufficient'
  WHEN trend > 0.1 THEN 'up' WHEN trend < -0.1 THEN 'down' ELSE 'flat' END AS direction FROM windowst"""))
def _(spark, sf):
    monitored = reports.monitored_count(B.registry(spark, sf))
    rows = W.multi_window_report(B.observed(spark, sf), B.event_tags(spark, sf), B.polls(spark, sf), monitored, NOW)
    return rows.select("id", "window", R.window_direction(F.col("trend"), F.col("coverage_comparable")).alias("direction"))


@check("representative_posts", q(OBS, f"""
SELECT tag_id, uri, url, created_at, origin_host, seen_mask,
  row_number() OVER (PARTITION BY tag_id ORDER BY created_at DESC, uri) AS rank
FROM orig WHERE NOT sensitive AND url IS NOT NULL AND created_at >= {NOW} - 604800 QUALIFY rank <= 10"""))
def _(spark, sf):
    return O.representative_posts(B.observed(spark, sf), NOW - 604800, 10)


# -- overviews ---------------------------------------------------------------

_OVERVIEW_SQL = q(OBS, OVERVIEW, "SELECT * FROM overview")


def overview(spark, sf):
    return O.tag_overview(B.observed(spark, sf), B.event_tags(spark, sf), NOW)


check("tag_overview", _OVERVIEW_SQL)(overview)


@check("tag_overview_expanded", _OVERVIEW_SQL)
def _(spark, sf):
    return O.tag_overview_expanded(B.observed(spark, sf), B.event_tags(spark, sf), NOW)


@check("tracked_breadth", q(OBS, OVERVIEW, """
SELECT id, name, last_query_at, posts_24h, authors_24h, origin_servers_24h FROM overview"""))
def _(spark, sf):
    return O.tracked_breadth(B.observed(spark, sf), B.event_tags(spark, sf), NOW)


_RETIRE = f"""
retirable AS (SELECT t.id, any_value(t.name) AS name, any_value(t.last_query_at) AS last_query_at,
    any_value(t.first_seen_at) AS first_seen_at, count(o.uri) AS posts_24h
  FROM active t LEFT JOIN obs o ON o.tag_id = t.id AND o.created_at >= {DAY_AGO} GROUP BY t.id)"""


@check("tracked_for_retirement", q(OBS, _RETIRE, "SELECT * FROM retirable"))
def _(spark, sf):
    return O.tracked_for_retirement(B.observed(spark, sf), B.event_tags(spark, sf), NOW)


_RATES = f"""
rates AS (SELECT t.id, any_value(t.name) AS name, count(o.uri) AS posts_per_hour FROM tag t
  LEFT JOIN orig o ON o.tag_id = t.id AND o.created_at >= {NOW} - 3600 WHERE NOT t.blocked GROUP BY t.id)"""


@check("posts_per_hour", q(OBS, _RATES, "SELECT * FROM rates"))
def _(spark, sf):
    return O.posts_per_hour(B.observed(spark, sf), B.event_tags(spark, sf), NOW)


def _hours(series):
    return series.select("id", "name", F.posexplode("hourly").alias("bucket", "posts"))


@check("hourly_posts", q(OBS, ROLLUP, f"""
SELECT t.id, t.name, b.bucket, coalesce(sum(r.posts), 0) AS posts
FROM active t, (SELECT unnest(range(24)) AS bucket) b
LEFT JOIN rollup r ON r.tag_id = t.id AND r.minute // 60 = {NOW} // 3600 - 23 + b.bucket GROUP BY ALL"""))
def _(spark, sf):
    return _hours(O.hourly_posts(B.rollups(spark, sf), O.active_tags(B.event_tags(spark, sf)), NOW))


@check("hourly_by_age", q(OBS, ROLLUP, f"""
SELECT t.id, t.name, b.bucket, coalesce(sum(r.posts), 0) AS posts
FROM active t, (SELECT unnest(range(24)) AS bucket) b
LEFT JOIN rollup r ON r.tag_id = t.id AND r.minute <= {NOW} // 60 AND ({NOW} // 60 - r.minute) // 60 = 23 - b.bucket
GROUP BY ALL"""))
def _(spark, sf):
    return _hours(O.hourly_by_age(B.rollups(spark, sf), O.active_tags(B.event_tags(spark, sf)), NOW))


# -- pool --------------------------------------------------------------------

_LOADED = """
loaded AS (SELECT *, row_number() OVER (ORDER BY distinct_origin_servers DESC, distinct_authors DESC, name) AS rank
  FROM figures WHERE distinct_authors >= 5 AND name NOT IN (SELECT name FROM tag WHERE tracked OR blocked) QUALIFY rank <= {n})"""


@check("load_candidates", q(OBS, POOL, CANDIDATES, _LOADED.format(n=100), "SELECT * FROM loaded"))
def _(spark, sf):
    return P.load_candidates(B.pool(spark, sf), B.event_tags(spark, sf), NOW - 172800)


@check("candidate_stats", q(OBS, POOL, CANDIDATES, """
SELECT * FROM figures WHERE len(name) % 3 = 0 OR name IN (SELECT name FROM tag)"""))
def _(spark, sf):
    pool = B.pool(spark, sf)
    names = pool.filter(F.length("name") % 3 == 0).select("name").unionByName(B.event_tags(spark, sf).select("name"))
    return P.candidate_stats(pool, names, NOW - 172800)


_STATS = f"""
sizes AS (SELECT name, count(*) AS n FROM pool WHERE first_seen >= {NOW} - 172800 GROUP BY name),
fresh AS (SELECT * FROM sizes WHERE name NOT IN (SELECT name FROM tag WHERE tracked OR blocked)),
stats AS (SELECT (SELECT count(*) FROM sizes) AS pool_names, (SELECT coalesce(sum(n), 0) FROM sizes) AS pool_rows,
  (SELECT coalesce(max(n), 0) FROM fresh) AS strongest_authors, (SELECT count(*) FROM fresh WHERE n >= 5) AS ready_to_promote,
  (SELECT count(*) FROM tag WHERE NOT blocked AND tracked) AS tracked_count,
  (SELECT count(*) FROM tag WHERE NOT blocked AND NOT tracked AND retired_at IS NOT NULL) AS retired_count,
  (SELECT count(*) FROM tag WHERE NOT blocked AND NOT tracked AND retired_at IS NULL) AS queued_count)"""


@check("discovery_stats", q(OBS, POOL, _STATS, "SELECT * FROM stats"))
def _(spark, sf):
    return P.discovery_stats(B.pool(spark, sf), B.event_tags(spark, sf), NOW)


@check("meta_report", q(OBS, POLLS, POOL, _STATS, """
SELECT *, (SELECT count(*) FROM monitored) AS instances_monitored,
  (SELECT max(last_ok_at) FROM registry) AS last_successful_update FROM stats"""))
def _(spark, sf):
    return reports.meta_report(B.registry(spark, sf), B.pool(spark, sf), B.event_tags(spark, sf), NOW)


# -- tag table reads ---------------------------------------------------------


@check("scan_tracked_tags", q(OBS, "SELECT id, name, display, tier, last_query_at, query_count FROM active"))
def _(spark, sf):
    return policy.scan_tracked_tags(B.event_tags(spark, sf)).select(
        "id", "name", "display", "tier", "last_query_at", "query_count")


@check("find_tags", q(OBS, "SELECT id, name FROM tag WHERE name IN (SELECT event_type FROM ev)"))
def _(spark, sf):
    asked = B.events(spark, sf).select(X.clean_tag_input(F.concat(F.lit(" %23"), F.upper("event_type"))).alias("name"))
    return policy.find_tags(B.event_tags(spark, sf), asked).select("id", "name")


@check("count_tracked", q(OBS, "SELECT count(*) AS tracked FROM active"))
def _(spark, sf):
    return policy.count_tracked(B.event_tags(spark, sf))


_QUEUED = f"""
queued AS (SELECT name, last_query_at, query_count,
    row_number() OVER (ORDER BY last_query_at DESC, query_count DESC, name) AS rank
  FROM {{t}} WHERE NOT tracked AND NOT blocked AND last_query_at >= {NOW} - 604800 QUALIFY rank <= 50)"""


@check("queried_untracked", q(OBS, _QUEUED.format(t="tag"), "SELECT * FROM queued"))
def _(spark, sf):
    return policy.queried_untracked(B.event_tags(spark, sf), NOW - 604800)


@check("tracking_state", q(OBS, """
SELECT id, CASE WHEN tracked THEN 'tracked' WHEN retired_at IS NOT NULL THEN 'retired' ELSE 'queued' END AS state,
  CASE tier WHEN 'hot' THEN 300 WHEN 'warm' THEN 300 ELSE 1800 END AS poll_interval_seconds FROM tag"""))
def _(spark, sf):
    return B.event_tags(spark, sf).select(
        "id", R.tracking_state(F.col("tracked"), F.col("retired_at")).alias("state"),
        R.effective_interval(F.col("tier")).alias("poll_interval_seconds"),
    )


# -- policy ------------------------------------------------------------------

for _order, _by in {"authors": "authors_24h DESC, posts_24h DESC, name", "posts": "posts_24h DESC, name", "name": "name"}.items():
    def _ranked(spark, sf, order=_order):
        return policy.rank_tags(overview(spark, sf), order).select("rank", "id", "name", "posts_24h", "authors_24h")

    check(f"rank_tags_by_{_order}", q(OBS, OVERVIEW, f"""
SELECT row_number() OVER (ORDER BY {_by}) AS rank, id, name, posts_24h, authors_24h FROM overview"""))(_ranked)


_GATED = """
gated AS (SELECT name, distinct_authors, distinct_origin_servers,
    row_number() OVER (ORDER BY distinct_origin_servers DESC, distinct_authors DESC, name) AS rank FROM figures
  WHERE distinct_authors >= 5 AND distinct_origin_servers >= 3 AND distinct_authors / distinct_origin_servers <= 5)"""


@check("select_promotions", q(OBS, POOL, CANDIDATES, _GATED, """
SELECT name, rank FROM gated WHERE rank <= greatest(0, 50 - (SELECT count(*) FROM active))"""))
def _(spark, sf):
    tracked = policy.count_tracked(B.event_tags(spark, sf)).scalar()
    figures = P.candidate_figures(B.pool(spark, sf).filter(F.col("first_seen") >= NOW - 172800))
    return policy.select_promotions(figures, F.greatest(F.lit(0), F.lit(50) - tracked)).select("name", "rank")


_WANTED = """
slots AS (SELECT greatest(0, 50 - (SELECT count(*) FROM {active})) AS n),
wanted AS (SELECT name, rank FROM queued WHERE rank <= (SELECT n FROM slots)),
gated AS (SELECT name, row_number() OVER (ORDER BY distinct_origin_servers DESC, distinct_authors DESC, name) AS rank
  FROM loaded WHERE distinct_origin_servers >= 3 AND distinct_authors / distinct_origin_servers <= 5),
chosen AS (SELECT name, 'requested' AS source, rank FROM wanted UNION ALL
  SELECT name, 'discovered', rank FROM gated WHERE rank <= (SELECT n FROM slots) - (SELECT count(*) FROM wanted)
    AND name NOT IN (SELECT name FROM wanted))"""


@check("select_promotions_with_queried", q(OBS, POOL, CANDIDATES, _LOADED.format(n=100), _QUEUED.format(t="tag"),
                                           _WANTED.format(active="active"), "SELECT * FROM chosen"))
def _(spark, sf):
    tags = B.event_tags(spark, sf)
    candidates = P.load_candidates(B.pool(spark, sf), tags, NOW - 172800)
    return policy.select_promotions_with_queried(
        policy.queried_untracked(tags, NOW - 604800), candidates, policy.count_tracked(tags).scalar()
    )


_QUIET = f"""
quiet AS (SELECT id, name FROM retirable WHERE {NOW} - first_seen_at >= 86400 AND posts_24h = 0
  AND (last_query_at IS NULL OR {NOW} - last_query_at >= 604800))"""
_NARROW = f"""
narrow AS (SELECT id, name FROM overview WHERE posts_24h >= 20
  AND (origin_servers_24h < 3 OR authors_24h / origin_servers_24h > 5)
  AND (last_query_at IS NULL OR {NOW} - last_query_at >= 86400))"""
_EXCESS = f"""
remaining AS (SELECT * FROM retirable WHERE id NOT IN (SELECT id FROM quiet) AND id NOT IN (SELECT id FROM narrow)),
excess AS (SELECT id, name FROM (SELECT *, row_number() OVER (ORDER BY posts_24h, name) AS rn FROM remaining
    WHERE last_query_at IS NULL OR {NOW} - last_query_at >= 86400)
  WHERE rn <= (SELECT count(*) FROM remaining) - {{max}})"""


LATER = NOW + 3 * 86400


@check("select_quiet_retirements", q(OBS, (_RETIRE + ", " + _QUIET.strip()).replace(str(DAY_AGO), str(LATER - 86400)).replace(
    f"{NOW} -", f"{LATER} -"), "SELECT id, name FROM quiet"))
def _(spark, sf):
    """Judged three days on, when nothing new has come in."""
    tracked = O.tracked_for_retirement(B.observed(spark, sf), B.event_tags(spark, sf), LATER)
    return policy.select_quiet_retirements(tracked, LATER).select("id", "name")


@check("select_non_community_retirements", q(OBS, OVERVIEW, _NARROW.replace(">= 20", ">= 3").replace("> 5", "> 1"),
                                            "SELECT id, name FROM narrow"))
def _(spark, sf):
    breadth = O.tracked_breadth(B.observed(spark, sf), B.event_tags(spark, sf), NOW)
    return policy.select_non_community_retirements(breadth, NOW, max_ratio=1, min_posts=3).select("id", "name")


@check("select_excess_retirements", q(OBS, _RETIRE, f"""
pick AS (SELECT id, name, row_number() OVER (ORDER BY posts_24h, name) AS rn FROM retirable
         WHERE last_query_at IS NULL OR {NOW} - last_query_at >= 86400)""", """
SELECT id, name FROM pick WHERE rn <= (SELECT count(*) FROM retirable) - 20"""))
def _(spark, sf):
    tracked = O.tracked_for_retirement(B.observed(spark, sf), B.event_tags(spark, sf), NOW)
    return policy.select_excess_retirements(tracked, NOW, 20).select("id", "name")


_PASS = q(OBS, POOL, CANDIDATES, OVERVIEW, _RETIRE, _QUIET, _NARROW, _EXCESS.format(max=20), """
retiring AS (SELECT 'quiet' AS reason, id, name FROM quiet
  UNION ALL SELECT 'not_community', id, name FROM narrow WHERE id NOT IN (SELECT id FROM quiet)
  UNION ALL SELECT 'over_ceiling', id, name FROM excess),
after AS (SELECT * EXCLUDE (tracked), tracked AND id NOT IN (SELECT id FROM retiring) AS tracked FROM tag),
still AS (SELECT * FROM after WHERE tracked AND NOT blocked)""",
    _LOADED.format(n=1_000_000_000).replace("FROM tag WHERE", "FROM after WHERE"), _QUEUED.format(t="after"),
    _WANTED.format(active="still").replace("50 -", "20 -"), """
SELECT 'retire' AS action, reason, id, name, NULL AS place FROM retiring
UNION ALL SELECT 'promote', source, NULL, name, rank FROM chosen""")


@check("discovery_pass", _PASS)
def _(spark, sf):
    return maintenance.discovery_decisions(
        B.observed(spark, sf), B.event_tags(spark, sf), B.pool(spark, sf), NOW, max_tracked=20
    )


_TIERS = f"""
scored AS (SELECT t.id, t.name, t.tier, CASE WHEN last_query_at IS NOT NULL AND {NOW} - last_query_at <= 900
    THEN 1000000 ELSE 0 END + r.posts_per_hour AS score FROM active t JOIN rates r USING (id)),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rn FROM scored),
tiers AS (SELECT id, name, tier, score, CASE WHEN score = 0 THEN 'cold' WHEN rn <= {{hot}} THEN 'hot'
    WHEN rn <= {{hot}} + {{warm}} THEN 'warm' ELSE 'cold' END AS new_tier FROM placed)"""


@check("assign_tiers", q(OBS, _RATES, _TIERS.format(hot=3, warm=5), "SELECT id, score, new_tier AS tier FROM tiers"))
def _(spark, sf):
    tags = O.active_tags(B.event_tags(spark, sf)).select("id", "last_query_at")
    rates = O.posts_per_hour(B.observed(spark, sf), B.event_tags(spark, sf), NOW)
    return policy.assign_tiers(tags.join(rates, "id"), NOW, 3, 5)


@check("retier", q(OBS, _RATES, _TIERS.format(hot=3, warm=40), """
SELECT id, name, tier, new_tier FROM tiers WHERE tier <> new_tier"""))
def _(spark, sf):
    return maintenance.retier_pass(B.observed(spark, sf), B.event_tags(spark, sf), NOW)


@check("set_tiers", q(OBS, _RATES, _TIERS.format(hot=3, warm=40), """
SELECT t.id, coalesce(x.new_tier, t.tier) AS tier FROM tag t LEFT JOIN tiers x USING (id)"""))
def _(spark, sf):
    from tagtide.operators import merges

    tags = B.event_tags(spark, sf)
    changes = maintenance.retier_pass(B.observed(spark, sf), tags, NOW).select("id", F.col("new_tier").alias("tier"))
    return merges.set_tiers(tags, changes).select("id", "tier")


TRENDING = """
trending AS (SELECT *, row_number() OVER (ORDER BY authors_1h DESC, origin_servers_24h DESC, name) AS rank
  FROM overview WHERE authors_1h > 0 QUALIFY rank <= 10),
trended AS (SELECT rank, id, name AS tag, coalesce(display, name) AS display, authors_1h, posts_1h, authors_24h,
  origin_servers_24h, authors_prev_1h AS authors_previous_1h,
  CASE WHEN NOT ok THEN 'not_comparable' WHEN greatest(authors_1h, authors_prev_1h) < 5 THEN 'insufficient'
       WHEN authors_prev_1h = 0 THEN 'up' WHEN abs((authors_1h - authors_prev_1h) / authors_prev_1h) < 0.1 THEN 'flat'
       WHEN authors_1h > authors_prev_1h THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN ok AND greatest(authors_1h, authors_prev_1h) >= 5 AND authors_prev_1h > 0
       THEN floor((authors_1h - authors_prev_1h) / authors_prev_1h * 100 + 0.5) / 100 END AS change,
  CASE WHEN NOT ok THEN 'coverage_changed' WHEN greatest(authors_1h, authors_prev_1h) < 5 THEN 'too_few_authors'
       WHEN authors_prev_1h = 0 THEN 'nothing_before' END AS reason
FROM trending, (SELECT {ok} AS ok FROM comparable))"""


@check("rank_trending", q(OBS, POLLS, OVERVIEW, TRENDING.format(ok="TRUE"), "SELECT * FROM trended"))
def _(spark, sf):
    return policy.rank_trending(overview(spark, sf), F.lit(True), 10)


@check("register_tag_queries", q(OBS, POOL, f"""
asked AS (SELECT name, min(observed_at * 100000000 + seq) AS first_key, max(observed_at) AS last_asked, count(*) AS asks
          FROM sighting GROUP BY name),
fresh AS (SELECT *, row_number() OVER (ORDER BY first_key, name) AS o FROM asked WHERE name NOT IN (SELECT name FROM tag))""", f"""
SELECT id, name, query_count + coalesce(asks, 0) AS query_count, coalesce(last_asked, last_query_at) AS last_query_at, tracked
FROM tag LEFT JOIN asked USING (name)
UNION ALL SELECT (SELECT max(id) FROM tag) + o, name, asks, last_asked, o <= 50 - (SELECT count(*) FROM active) FROM fresh"""))
def _(spark, sf):
    """Every word of every document as a search; each word of a document is one arrival."""
    from tagtide.operators import merges

    asked = B.word_sightings(spark, sf).select(
        "name", F.col("name").alias("display"), F.col("observed_at").alias("asked_at"), "seq"
    )
    # Names first asked for in one document arrive in name order.
    asked = asked.withColumn("seq", F.struct("seq", "name"))
    out = merges.register_tag_queries(B.event_tags(spark, sf), asked)
    return out.select("id", "name", "query_count", "last_query_at", "tracked")


@check("apply_discovery", _PASS.rsplit("\nSELECT 'retire'", 1)[0] + f""",
done AS (SELECT id, name, CASE WHEN name IN (SELECT name FROM chosen) THEN TRUE ELSE tracked END AS tracked,
    CASE WHEN name IN (SELECT name FROM chosen) THEN NULL WHEN id IN (SELECT id FROM retiring) THEN {NOW} ELSE retired_at END
    AS retired_at FROM after)
SELECT * FROM done UNION ALL
SELECT (SELECT max(id) FROM tag) + row_number() OVER (ORDER BY name), name, TRUE, NULL FROM chosen
WHERE name NOT IN (SELECT name FROM tag)""")
def _(spark, sf):
    tags = B.event_tags(spark, sf)
    decisions = maintenance.discovery_decisions(B.observed(spark, sf), tags, B.pool(spark, sf), NOW, max_tracked=20)
    return maintenance.apply_discovery(tags, decisions, NOW).select("id", "name", "tracked", "retired_at")
