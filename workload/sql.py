"""The same bindings as DuckDB common table expressions."""

from __future__ import annotations

NOW = 1706616000
TRADE_NOW = 996710400

EV = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
              epoch_us(ts) // 1000000 AS created_at FROM events),
epost AS (SELECT 'h' || (event_id % 13) || '.example' AS origin_host,
                 'https://h' || (event_id % 13) || '.example/p/' || event_id AS uri,
                 CASE WHEN event_id % 5 <> 0 THEN 'https://h' || (event_id % 13) || '.example/p/' || event_id END AS url,
                 substr(sha256('test-salt u' || user_id), 1, 32) AS author_hex,
                 created_at, event_id % 11 = 0 AS is_boost, event_id % 7 = 0 AS sensitive,
                 CASE event_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS language,
                 [event_type, event_type || '_' || (k // 10)] AS tags,
                 list_distinct([k % 9, (k * 7 + 3) % 9, (k // 10) % 9]) AS servers, event_id AS seq, k FROM ev),
eview AS (SELECT * EXCLUDE (servers, s), 'h' || s || '.example' AS host, s,
                 created_at + 5 + s * 7 + seq % 50 AS observed_at
          FROM (SELECT *, unnest(servers) AS s FROM epost))"""

TAG = f"""
etagnames AS (SELECT event_type AS name, 0 AS slot, event_id FROM ev
              UNION ALL SELECT event_type || '_' || (k // 10), 1 + k // 10, event_id FROM ev),
etagmin AS (SELECT name, slot, min(event_id) AS m FROM etagnames GROUP BY name, slot),
tag AS (SELECT m * 16 + slot AS id, name, CASE WHEN m % 2 = 0 THEN upper(name) END AS display,
               CASE m % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'warm' ELSE 'cold' END AS tier,
               {NOW} - (m % 5 + 1) * 43200 AS first_seen_at,
               CASE WHEN m % 3 = 0 THEN {NOW} - (m % 100) * 600 END AS last_query_at, m % 7 AS query_count,
               slot = 7 AS blocked, (m + slot) % 4 <> 0 AS tracked,
               CASE WHEN (m + slot) % 4 = 0 AND m % 2 = 0 THEN {NOW} - 86400 END AS retired_at FROM etagmin),
active AS (SELECT * FROM tag WHERE tracked AND NOT blocked)"""

OBS = f"""{EV}, {TAG},
credited AS (SELECT t.id AS tag_id, v.* FROM (SELECT *, unnest(tags) AS name FROM eview) v JOIN tag t ON t.name = v.name),
obs AS (SELECT tag_id, uri, any_value(url) AS url, any_value(origin_host) AS origin_host,
               any_value(author_hex) AS author_hex, any_value(created_at) AS created_at, min(observed_at) AS observed_at,
               bool_or(is_boost) AS is_boost, bool_or(sensitive) AS sensitive, any_value(language) AS language,
               bit_or(CAST(1 AS BIGINT) << s) AS seen_mask FROM credited GROUP BY tag_id, uri),
orig AS (SELECT * FROM obs WHERE NOT is_boost)"""

POLLS = f"""
poll AS (SELECT 'h' || (k % 9) || '.example' AS host, created_at AS "at", event_id AS seq,
                CASE WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 429
                     WHEN event_type = 'click' AND k < 30 THEN 422 ELSE 200 END AS status,
                value AS latency_ms, 300 - 3 * k AS remaining,
                CASE WHEN event_id % 4 = 0 THEN created_at + 120 END AS reset, k, event_type,
                CAST(k AS BIGINT) * 1000 AS bytes, k % 50 AS returned FROM ev),
reg0 AS (SELECT host, CAST(regexp_extract(host, '^h([0-9]+)', 1) AS INTEGER) AS s, min("at") AS added_at,
                max("at") FILTER (WHERE status = 200 AND "at" < {NOW}) AS ok_at FROM poll GROUP BY host),
registry AS (SELECT host, CASE WHEN s % 2 = 0 THEN 'mastodon' ELSE 'pleroma' END AS software, '4.' || s AS version,
                    CASE WHEN s = 7 THEN 'tags_only' WHEN s = 8 THEN 'activitypub' ELSE 'timeline' END AS capability,
                    s AS bit, s = 6 AS opt_out, CASE WHEN s = 6 THEN 'requested' END AS opt_out_reason,
                    CASE WHEN s % 3 <> 0 THEN {NOW} - CAST(s AS BIGINT) * 172800 END AS probed_at,
                    CASE WHEN s <> 5 THEN ok_at END AS last_ok_at, s % 4 AS consecutive_failures,
                    CASE WHEN s = 3 THEN {NOW} + 600 WHEN s = 4 THEN {NOW} - 600 END AS backoff_until, added_at FROM reg0),
monitored AS (SELECT * FROM registry WHERE NOT opt_out AND capability = 'timeline' AND bit IS NOT NULL),
collectable AS (SELECT * FROM monitored WHERE coalesce(backoff_until, 0) <= {NOW}),
hours AS (SELECT count(DISTINCT host) FILTER (WHERE "at" >= {NOW} - 3600 AND "at" < {NOW}) AS cur,
                 count(DISTINCT host) FILTER (WHERE "at" >= {NOW} - 7200 AND "at" < {NOW} - 3600) AS prev,
                 (SELECT count(*) FROM monitored) AS mon FROM poll WHERE status = 200),
comparable AS (SELECT cur / mon >= 0.6 AND prev / mon >= 0.6 AND abs(cur - prev) / mon <= 0.25 AS ok FROM hours)"""

OVERVIEW = f"""
overview AS (SELECT t.id, any_value(t.name) AS name, any_value(t.display) AS display, any_value(t.tier) AS tier,
    any_value(t.first_seen_at) AS first_seen_at, any_value(t.last_query_at) AS last_query_at,
    count(o.uri) AS posts_24h, count(DISTINCT o.author_hex) AS authors_24h,
    count(*) FILTER (WHERE o.created_at >= {NOW} - 3600) AS posts_1h,
    count(DISTINCT o.author_hex) FILTER (WHERE o.created_at >= {NOW} - 3600) AS authors_1h,
    count(DISTINCT o.author_hex) FILTER (WHERE o.created_at >= {NOW} - 7200 AND o.created_at < {NOW} - 3600) AS authors_prev_1h,
    count(DISTINCT o.origin_host) AS origin_servers_24h
  FROM active t LEFT JOIN orig o ON o.tag_id = t.id AND o.created_at >= {NOW} - 86400 GROUP BY t.id)"""

WORDS = rf"""
words AS (SELECT doc_id, source, len(w) AS n_words, unnest(w) AS name FROM (
    SELECT doc_id, source, list_distinct(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))) AS w
    FROM documents)),
sighting AS (SELECT name, substr(sha256('test-salt d' || (doc_id % 37)), 1, 32) AS author_hex, source AS origin_host,
    least(n_words, 20) AS tags_on_post, {NOW} - (doc_id % 72) * 3600 AS observed_at, doc_id AS seq FROM words)"""

POOL = f"""{WORDS},
pool AS (SELECT name, author_hex, arg_min(observed_at, seq) AS first_seen, arg_min(origin_host, seq) AS origin_host,
    arg_min(tags_on_post, seq) AS tags_on_post, count(*) AS posts_seen FROM sighting GROUP BY name, author_hex)"""

CANDIDATES = f"""
figures AS (SELECT name, count(*) AS distinct_authors, count(DISTINCT origin_host) AS distinct_origin_servers,
    CASE WHEN sum(posts_seen) > count(*) THEN floor(sum(posts_seen) / count(*) * 10 + 0.5) / 10 END AS posts_per_author,
    floor(sum(tags_on_post) / count(tags_on_post) * 10 + 0.5) / 10 AS mean_tags_per_post, min(first_seen) AS first_seen
  FROM pool WHERE first_seen >= {NOW} - 172800 GROUP BY name)"""

COUNTERS = f"""
counters AS (SELECT name AS tag, 'h' || (doc_id % 2) || '.example' AS host, {NOW} - 43200 - (doc_id % 7) * 86400 AS day,
    count(*) AS uses, count(DISTINCT doc_id % 5) AS accounts FROM words GROUP BY 1, 2, 3)"""

ROLLUP = """
rollup AS (SELECT tag_id, created_at // 60 AS minute, count(*) AS posts, 9 AS instances_reporting
           FROM orig GROUP BY 1, 2)"""

TRADE = f"""
tpost AS (SELECT o_orderkey, 'n' || c_nationkey || '.example' AS origin_host,
    'https://n' || c_nationkey || '.example/o/' || o_orderkey AS uri,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'https://n' || c_nationkey || '.example/o/' || o_orderkey END AS url,
    'c' || o_custkey AS acct, epoch_us(o_orderdate) // 1000000 AS created_at, o_orderkey % 11 = 0 AS is_boost,
    o_orderkey % 7 = 0 AS sensitive,
    CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END AS language,
    [lower(c_mktsegment), lower(o_orderpriority), lower(o_orderstatus)] AS tags
  FROM orders JOIN customer ON o_custkey = c_custkey),
tname AS (SELECT o_orderkey, unnest(tags) AS name, unnest([0, 1, 2]) AS slot FROM tpost),
ttag AS (SELECT min(o_orderkey) * 4 + slot AS id, name FROM tname GROUP BY name, slot),
tline AS (SELECT l_orderkey, s_nationkey AS s, epoch_us(l_shipdate) // 1000000 AS observed_at, l_linenumber AS seq
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
tseen AS (SELECT l_orderkey, bit_or(CAST(1 AS BIGINT) << s) AS seen_mask, min(observed_at) AS observed_at
          FROM tline GROUP BY l_orderkey),
tobs AS (SELECT t.id AS tag_id, p.uri, p.url, p.origin_host, p.acct, p.created_at, x.observed_at, x.seen_mask, p.is_boost,
                p.sensitive, p.language
         FROM tseen x JOIN tpost p ON p.o_orderkey = x.l_orderkey JOIN tname n ON n.o_orderkey = p.o_orderkey
         JOIN ttag t ON t.name = n.name),
torig AS (SELECT * FROM tobs WHERE NOT is_boost),
treg AS (SELECT 'n' || n_nationkey || '.example' AS host, n_nationkey AS bit, n_regionkey = 4 AS opt_out,
                CASE WHEN n_nationkey % 5 = 4 THEN 'tags_only' ELSE 'timeline' END AS capability, n_regionkey AS region
         FROM nation)"""


def q(*parts: str) -> str:
    """WITH the given fragments, then the last part as the query."""
    return "WITH " + ", ".join(p.strip() for p in parts[:-1]) + "\n" + parts[-1].strip()
