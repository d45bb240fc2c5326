"""Checks of capture, normalisation and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagtide.functions import numbers as N, text as X
from tagtide.functions.arrays import unfold
from tagtide.operators import ingest, merges, polling, trust
from tagtide.session import fresh_folder
from tagtide.sources import raw, tables
from workload import bindings as B
from workload.catalog import check
from workload.sql import EV, NOW, OBS, POLLS, TAG, TRADE, WORDS, q

# -- capture -----------------------------------------------------------------


def captured_pages(spark, sf):
    """Events as pages of at most 40 statuses, with every kind of bad status among them."""
    rows = B.events(spark, sf)
    i = F.col("event_id")
    origin = F.concat(F.lit("h"), (i % 13).cast("string"), F.lit(".example"))
    uri = (
        F.when(i % 19 == 2, F.lit(None).cast("string")).when(i % 31 == 5, "nonsense")
        .otherwise(F.concat(F.lit("https://"), origin, F.lit("/p/"), i.cast("string")))
    )
    created = F.when(i % 23 == 3, "not a date").otherwise(
        F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    )
    acct = F.when(i % 29 == 4, "").otherwise(F.concat(F.lit("U"), F.col("user_id").cast("string")))
    tag = lambda c: F.struct(c.alias("name"))
    post = [
        i.cast("string").alias("id"), uri.alias("uri"), uri.alias("url"), created.alias("created_at"),
        F.when(i % 17 == 1, "unlisted").otherwise("public").alias("visibility"), F.lit("en").alias("language"),
        (i % 7 == 0).alias("sensitive"), F.struct(acct.alias("acct")).alias("account"),
        F.array(tag(F.upper("event_type")), tag(F.col("event_type")), tag(F.concat("event_type", F.lit("_"), F.col("k"))))
        .alias("tags"),
    ]
    boost = F.struct(
        F.concat(F.lit("b"), i.cast("string")).alias("id"),
        F.when(i % 22 == 0, "private").otherwise("public").alias("visibility"), F.struct(*post).alias("reblog"),
    )
    status = F.when(i % 11 == 0, F.to_json(boost)).otherwise(F.to_json(F.struct(*post)))
    page = F.floor(i / 40)
    pages = rows.select(page.alias("page_id"), i, status.alias("s")).groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "s"))).alias("l")
    )
    array = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["s"]), ","), F.lit("]"))
    return pages.select("page_id", F.when(F.col("page_id") % 10 == 9, '{"error": "busy"}').otherwise(array).alias("body"))


def suppressed_authors(spark, sf):
    bad = B.table(spark, sf, "labels").filter(F.col("quality") == 0)
    return bad.select(X.author_hash(F.concat(F.lit("u"), F.col("doc_id").cast("string")), B.SALT).alias("author_hash"))


def normalised(spark, sf):
    return ingest.normalise(raw.parse_statuses(captured_pages(spark, sf)), B.SALT, suppressed_authors(spark, sf))


_NORMALISED = """
sup AS (SELECT substr(sha256('test-salt u' || doc_id), 1, 32) AS author_hex FROM labels WHERE quality = 0),
raw AS (SELECT event_id // 40 AS page_id, event_id % 40 AS pos,
    CASE WHEN event_id % 19 = 2 THEN NULL WHEN event_id % 31 = 5 THEN 'nonsense'
         ELSE 'https://h' || (event_id % 13) || '.example/p/' || event_id END AS uri,
    event_id % 11 = 0 AS is_boost, event_id AS i, created_at, event_type, k,
    substr(sha256('test-salt ' || CASE WHEN event_id % 29 = 4 THEN '' ELSE 'u' || user_id END), 1, 32) AS author_hex
  FROM ev WHERE (event_id // 40) % 10 <> 9),
done AS (SELECT *, CASE WHEN uri IS NULL THEN 'malformed' WHEN i % 17 = 1 OR (is_boost AND i % 22 = 0) THEN 'non_public'
       WHEN uri = 'nonsense' OR i % 23 = 3 THEN 'malformed' WHEN i % 29 = 4 THEN 'malformed'
       WHEN author_hex IN (SELECT author_hex FROM sup) THEN 'suppressed' END AS skip_reason FROM raw)"""


@check("normalise_statuses", q(EV, _NORMALISED, """
SELECT page_id, pos, uri, CASE WHEN uri <> 'nonsense' THEN 'h' || (i % 13) || '.example' END AS origin_host, author_hex,
  CASE WHEN i % 23 <> 3 THEN created_at END AS created_at, is_boost, i % 7 = 0 AS sensitive,
  event_type || ',' || event_type || '_' || k AS tags, skip_reason FROM done"""))
def _(spark, sf):
    return normalised(spark, sf).select(
        "page_id", "pos", "uri", "origin_host", X.hash_hex(F.col("author_hash")).alias("author_hex"), "created_at",
        "is_boost", "sensitive", F.array_join("tags", ",").alias("tags"), "skip_reason",
    )


@check("skip_counts", q(EV, _NORMALISED, """
SELECT page_id, count(*) FILTER (WHERE skip_reason IS NULL) AS posts,
  count(*) FILTER (WHERE skip_reason = 'non_public') AS non_public,
  count(*) FILTER (WHERE skip_reason = 'malformed') AS malformed,
  count(*) FILTER (WHERE skip_reason = 'suppressed') AS suppressed FROM done GROUP BY page_id"""))
def _(spark, sf):
    return ingest.skip_counts(normalised(spark, sf), ["page_id"])


@check("rejected_pages", q(EV, "SELECT DISTINCT event_id // 40 AS page_id FROM ev WHERE (event_id // 40) % 10 = 9"))
def _(spark, sf):
    return raw.rejected_pages(captured_pages(spark, sf)).select("page_id")


def page_files(spark, sf):
    """The captured pages as files of JSON lines: one in eight lines is cut, one list in nine."""
    page = F.col("page_id")
    body = F.when(page % 9 == 4, F.expr("substring(body, 1, length(body) - 3)")).otherwise(F.col("body"))
    line = F.to_json(F.struct(F.lit("h0.example").alias("server"), F.lit(NOW).cast("bigint").alias("batch_at"),
                              page.cast("string").alias("page_id"), body.alias("body")))
    folder = fresh_folder(spark, "pages")
    cut = F.when(page % 8 == 3, F.substring(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    captured_pages(spark, sf).select(cut.alias("value")).write.text(folder)
    return folder


@check("read_statuses", q(EV, _NORMALISED, """
SELECT page_id, count(*) AS statuses, count(uri) AS uris FROM raw WHERE page_id % 8 <> 3 AND page_id % 9 <> 4 GROUP BY page_id"""))
def _(spark, sf):
    """Statuses of the pages that can be read, from files."""
    rows = raw.parse_statuses(raw.sound_pages(raw.capture_records(spark, page_files(spark, sf))))
    uri = F.coalesce("status.reblog.uri", "status.uri")
    return rows.groupBy(F.col("page_id").cast("bigint").alias("page_id")).agg(F.count("*").alias("statuses"), F.count(uri).alias("uris"))


@check("quarantined_pages", q(EV, """
page AS (SELECT DISTINCT event_id // 40 AS page_id FROM ev)""", """
SELECT page_id, CASE WHEN page_id % 8 = 3 THEN 'no_record' WHEN page_id % 10 = 9 THEN 'no_list' ELSE 'unreadable_list' END AS reason
FROM page WHERE page_id % 8 = 3 OR page_id % 10 = 9 OR page_id % 9 = 4"""))
def _(spark, sf):
    aside = raw.quarantined(raw.capture_records(spark, page_files(spark, sf)))
    known = F.coalesce("page_id", F.regexp_extract("record", r'"page_id":"(\d+)"', 1))
    return aside.select(known.cast("bigint").alias("page_id"), "reason")


@check("read_tag_counters", q(EV, """
SELECT 'h' || (event_id % 9) AS host, event_type AS tag, created_at AS day, k AS uses, k // 2 AS accounts
FROM ev WHERE k % 6 <> 1"""))
def _(spark, sf):
    k = F.col("k")
    day = F.struct(
        F.concat(F.lit(" "), F.col("created_at").cast("string"), F.lit("s")).alias("day"),
        F.when(k % 6 == 1, "n/a").otherwise(k.cast("string")).alias("uses"),
        F.floor(k / 2).cast("string").alias("accounts"),
    )
    captured = B.events(spark, sf).select(
        F.concat(F.lit("h"), (F.col("event_id") % 9).cast("string")).alias("server"), F.col("event_type").alias("name"),
        F.array(day).alias("history"),
    )
    return raw.parse_counters(captured)


_HOST = r"(?i)^https?:[/\\]*(?:[^/?#]*@)?([^\s/:?#@<>\[\]\\^|%]+)(?::[0-9]*)?(?:[/?#]|$)"


@check("origin_host", rf"""
SELECT page_id, nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') AS origin_host FROM pages""")
def _(spark, sf):
    return B.table(spark, sf, "pages").select("page_id", X.origin_host(F.col("url")).alias("origin_host"))


@check("author_hash", """
SELECT event_id, substr(sha256('test-salt u' || user_id), 1, 32) AS author_hex FROM events""")
def _(spark, sf):
    acct = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return B.table(spark, sf, "events").select("event_id", X.hash_hex(X.author_hash(acct, B.SALT)).alias("author_hex"))


@check("casefold_words", r"""
SELECT DISTINCT doc_id, lower(nfc_normalize(w)) AS tag
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)""")
def _(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    rows = unfold(B.spread(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), words, "w")
    return rows.select("doc_id", X.casefold_tag(F.col("w")).alias("tag")).distinct()


@check("clean_tag_input", q(WORDS, r"""
SELECT DISTINCT name, CASE WHEN len(name) <= 100 THEN CASE len(name) % 4 WHEN 0 THEN name WHEN 1 THEN name WHEN 2 THEN name END END AS tag
FROM (SELECT name FROM words UNION ALL SELECT repeat(name, 40) FROM words)"""))
def _(spark, sf):
    n = F.col("name")
    spelled = (
        # Capitals, where they lead back to the same word.
        F.when(F.length(n) % 4 == 0, F.concat(F.lit("%23"), F.when(F.length(F.upper(n)) == F.length(n), F.upper(n)).otherwise(n))).when(F.length(n) % 4 == 1, F.concat(F.lit(" #"), n))
        .when(F.length(n) % 4 == 2, F.concat(n, F.lit("%20"))).otherwise(F.concat(n, F.lit("-x")))
    )
    rows = unfold(B.word_rows(spark, sf), F.array("name", F.repeat("name", 40)), "name").select("name")  # also names that are too long
    # A tag depends on its name alone: the DISTINCT is taken first, so that each name is cleaned once.
    return rows.distinct().select("name", X.clean_tag_input(spelled).alias("tag"))


def requests(spark, sf):
    """One request per document: two known tags, then every word of the text."""
    text = F.concat(F.lit("#View,click_"), (F.col("doc_id") % 10).cast("string"), F.lit(","),
                    F.regexp_replace("text", r"[ \t\n\r\f]+", ","))
    docs = B.spread(B.table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select(F.col("doc_id").alias("request_id"), text.alias("tags"))


REQUESTS = r"""
req AS (SELECT doc_id AS request_id, string_split('#View,click_' || (doc_id % 10) || ',' ||
               regexp_replace(text, '[ \t\n\r\f]+', ',', 'g'), ',') AS l FROM documents),
item AS (SELECT request_id, unnest(l) AS raw0, generate_subscripts(l, 1) - 1 AS position FROM req),
shown AS (SELECT request_id, position, regexp_replace(regexp_replace(raw0,
    '^[\s\p{Z}\x{FEFF}\x{85}]+|[\s\p{Z}\x{FEFF}\x{85}]+$', '', 'g'), '^#', '') AS display FROM item),
named AS (SELECT *, lower(nfc_normalize(display)) AS tag FROM shown
          WHERE len(display) BETWEEN 1 AND 100 AND regexp_full_match(display, '[\p{L}\p{N}_]+')),
firsts AS (SELECT request_id, tag, min(position) AS position, arg_min(display, position) AS display
           FROM named GROUP BY request_id, tag),
cand AS (SELECT request_id, tag, display, row_number() OVER (PARTITION BY request_id ORDER BY position) AS place
         FROM firsts QUALIFY place <= 10)"""


@check("clean_candidates", q(REQUESTS, "SELECT request_id, tag, display, place FROM cand"))
def _(spark, sf):
    return trust.clean_candidates(requests(spark, sf)).select("request_id", "tag", "display", "place")


# -- sightings ---------------------------------------------------------------


@check("match_tracked_tags", q(EV, TAG, """
SELECT t.id AS tag_id, v.uri, v.host FROM (SELECT *, unnest(tags) AS name FROM eview) v JOIN active t ON t.name = v.name"""))
def _(spark, sf):
    rows = ingest.match_tracked_tags(ingest.tag_sightings(B.event_views(spark, sf)), B.event_tags(spark, sf))
    return rows.select("tag_id", "uri", "host")


@check("untracked_sightings", q(EV, TAG, """
SELECT name, author_hex, count(*) AS views FROM (SELECT *, unnest(tags) AS name FROM eview) v
WHERE name NOT IN (SELECT name FROM active) GROUP BY name, author_hex"""))
def _(spark, sf):
    rows = ingest.untracked_sightings(ingest.tag_sightings(B.event_views(spark, sf)), B.event_tags(spark, sf))
    return rows.groupBy("name", X.hash_hex(F.col("author_hash")).alias("author_hex")).agg(F.count("*").alias("views"))


@check("attach_mask", q(EV, POLLS, """
SELECT v.uri, v.host, coalesce(CAST(1 AS BIGINT) << r.bit, 0) AS mask FROM eview v
LEFT JOIN monitored r ON r.host = v.host"""))
def _(spark, sf):
    from tagtide.functions.servers import is_monitored

    rows = ingest.attach_mask(B.event_views(spark, sf).drop("mask"), B.registry(spark, sf).filter(is_monitored()))
    return rows.select("uri", "host", "mask")


_OBS_COLS = "tag_id, uri, url, origin_host, author_hex, created_at, observed_at, is_boost, sensitive, language, seen_mask"


def shown(observed):
    return observed.select(
        "tag_id", "uri", "url", "origin_host", X.hash_hex(F.col("author_hash")).alias("author_hex"), "created_at",
        "observed_at", "is_boost", "sensitive", "language", "seen_mask",
    )


@check("merge_sightings_events", q(OBS, f"SELECT {_OBS_COLS} FROM obs"))
def _(spark, sf):
    return shown(B.observed(spark, sf))


@check("merge_sightings_trade", q(TRADE, """
SELECT tag_id, uri, url, origin_host, substr(sha256('test-salt ' || acct), 1, 32) AS author_hex, created_at, observed_at,
       is_boost, sensitive, language, seen_mask FROM tobs"""))
def _(spark, sf):
    return shown(B.trade_observed(spark, sf))


@check("mask_popcount", q(OBS, "SELECT tag_id, uri, CAST(bit_count(seen_mask) AS BIGINT) AS servers FROM obs"))
def _(spark, sf):
    return B.observed(spark, sf).select("tag_id", "uri", N.popcount(F.col("seen_mask")).cast("bigint").alias("servers"))


@check("touched_minutes", q(OBS, "SELECT DISTINCT tag_id, created_at // 60 AS minute FROM orig"))
def _(spark, sf):
    return ingest.touched_minutes(B.observed(spark, sf))


# -- stored tables -----------------------------------------------------------


def split_by_server(spark, sf):
    """Observations from the even servers, then those from the odd ones."""
    rows = B.credited(B.event_views(spark, sf), B.event_tags(spark, sf))
    even = F.regexp_extract("host", r"^h(\d+)", 1).cast("int") % 2 == 0
    return ingest.merge_sightings(rows.filter(even)), ingest.merge_sightings(rows.filter(~even))


@check("upsert_observations", q(OBS, """
half AS (SELECT tag_id, uri, min(observed_at) FILTER (WHERE s % 2 = 0) AS even_at, min(observed_at) AS any_at,
                bit_or(CAST(1 AS BIGINT) << s) AS seen_mask FROM credited GROUP BY tag_id, uri)""", """
SELECT tag_id, uri, coalesce(even_at, any_at) AS observed_at, seen_mask FROM half"""))
def _(spark, sf):
    first, second = split_by_server(spark, sf)
    merged = merges.upsert_observations(merges.upsert_observations(first, second), second)
    return merged.select("tag_id", "uri", "observed_at", "seen_mask")


_HALVES = """
half AS (SELECT tag_id, uri, min(observed_at) FILTER (WHERE s % 2 = 0) AS even_at, min(observed_at) AS any_at,
                arg_min(created_at + {shift}, observed_at) FILTER (WHERE s % 2 = 1) AS odd_created,
                any_value(created_at) AS created_at, bit_or(CAST(1 AS BIGINT) << s) AS seen_mask FROM credited GROUP BY tag_id, uri)"""


def stored_halves(spark, sf, second):
    first, _ = split_by_server(spark, sf)
    path = fresh_folder(spark, "stored")
    tables.write_observations(first, path)
    for _ in range(2):  # a repeated batch changes nothing
        tables.merge_observations_into(spark, second, path)
    return tables.read_observations(spark, path).select("tag_id", "uri", "created_at", "observed_at", "seen_mask")


@check("stored_merge", q(OBS, _HALVES.format(shift=0), """
SELECT tag_id, uri, created_at, coalesce(even_at, any_at) AS observed_at, seen_mask FROM half"""))
def _(spark, sf):
    return stored_halves(spark, sf, split_by_server(spark, sf)[1])


@check("stored_merge_other_times", q(OBS, _HALVES.format(shift="(s * 2 - 9) * 86400"), """
SELECT tag_id, uri, CASE WHEN even_at IS NULL THEN odd_created ELSE created_at END AS created_at,
       coalesce(even_at, any_at) AS observed_at, seen_mask FROM half"""))
def _(spark, sf):
    """The odd servers give each post a time up to nine days from the first one's."""
    rows = B.credited(B.event_views(spark, sf), B.event_tags(spark, sf))
    s = F.regexp_extract("host", r"^h(\d+)", 1).cast("int")
    odd = rows.filter(s % 2 == 1).withColumn("created_at", F.col("created_at") + (s * 2 - 9) * 86_400)
    return stored_halves(spark, sf, ingest.merge_sightings(odd))


@check("stored_retention", q(OBS, POLLS, f"""
sup AS (SELECT DISTINCT substr(sha256('test-salt u' || doc_id), 1, 32) AS author_hex FROM labels WHERE quality = 0)""", f"""
SELECT tag_id, uri, created_at, seen_mask FROM obs WHERE created_at >= {NOW} - 25 * 3600 - 7 * 86400
  AND origin_host NOT IN (SELECT host FROM registry WHERE opt_out) AND author_hex NOT IN (SELECT author_hex FROM sup)"""))
def _(spark, sf):
    path = fresh_folder(spark, "stored")
    tables.write_observations(B.observed(spark, sf), path)
    tables.expire_observations(spark, path, B.NOW, hours=25 + 7 * 24)
    out = B.registry(spark, sf).filter("opt_out").select(F.col("host").alias("origin_host"))
    tables.remove_from_store(spark, path, out, "origin_host")
    tables.remove_from_store(spark, path, suppressed_authors(spark, sf), "author_hash")
    return tables.read_observations(spark, path).select("tag_id", "uri", "created_at", "seen_mask")


def batches_of_words(spark, sf):
    rows = B.word_sightings(spark, sf)
    odd = F.col("seq") % 2 == 1
    return merges.candidate_batch(rows.filter(~odd), B.NOW - 300), merges.candidate_batch(rows.filter(odd), B.NOW)


@check("upsert_candidates", q(WORDS, f"""
part AS (SELECT name, author_hex, max(seq % 2) = 1 AS in_odd, min(seq % 2) = 0 AS in_even,
    arg_max(origin_host, observed_at * 100000000 + seq) FILTER (WHERE seq % 2 = 0) AS even_origin,
    arg_max(origin_host, observed_at * 100000000 + seq) FILTER (WHERE seq % 2 = 1) AS odd_origin,
    arg_max(tags_on_post, observed_at * 100000000 + seq) FILTER (WHERE seq % 2 = 0) AS even_tags,
    arg_max(tags_on_post, observed_at * 100000000 + seq) FILTER (WHERE seq % 2 = 1) AS odd_tags
  FROM sighting GROUP BY name, author_hex)""", f"""
SELECT name, author_hex, CASE WHEN in_even THEN {NOW} - 300 ELSE {NOW} END AS first_seen,
  CASE WHEN in_even THEN even_origin ELSE odd_origin END AS origin_host,
  CASE WHEN in_even THEN even_tags ELSE odd_tags END AS tags_on_post,
  CAST(in_even AS INTEGER) + CAST(in_odd AS INTEGER) AS posts_seen FROM part"""))
def _(spark, sf):
    even, odd = batches_of_words(spark, sf)
    stored = even.withColumn("posts_seen", F.lit(1).cast("bigint"))
    merged = merges.upsert_candidates(stored, odd)
    return merged.select(
        "name", X.hash_hex(F.col("author_hash")).alias("author_hex"), "first_seen", "origin_host", "tags_on_post", "posts_seen"
    )


@check("cap_candidate_writes", q(WORDS, """
pair AS (SELECT name, author_hex, count(*) AS occ FROM sighting GROUP BY name, author_hex),
tot AS (SELECT name, sum(occ) AS n FROM pair GROUP BY name)""", """
SELECT name, author_hex, row_number() OVER (ORDER BY n DESC, name, author_hex) AS write_rank
FROM pair JOIN tot USING (name) QUALIFY write_rank <= 60"""))
def _(spark, sf):
    batch = merges.candidate_batch(B.word_sightings(spark, sf), B.NOW)
    return merges.cap_candidates(batch).select("name", X.hash_hex(F.col("author_hash")).alias("author_hex"), "write_rank")


def poll_results(spark, sf):
    """Polls with the cursor each one got back."""
    k, i = F.col("k"), F.col("seq")
    cursor = F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise((i + 1000000).cast("string"))
    return B.polls(spark, sf).select(
        "host", "at", "seq", "ok", (F.col("returned")).alias("returned"), cursor.alias("next_cursor"),
        F.array((k % 5).cast("bigint"), (k % 5 + 5).cast("bigint")).alias("tag_ids"),
    )


_PATCH = """
patch AS (SELECT host, unnest([CAST(k % 5 AS BIGINT), CAST(k % 5 + 5 AS BIGINT)]) AS tag_id,
    CASE WHEN k % 3 <> 0 THEN CAST(seq + 1000000 AS VARCHAR) END AS min_id, "at" AS polled_at, returned >= 40 AS behind, seq
  FROM poll WHERE status = 200)"""


@check("cursor_patches", q(EV, POLLS, _PATCH, "SELECT host, tag_id, min_id, polled_at, behind, seq FROM patch"))
def _(spark, sf):
    return polling.cursor_patches(poll_results(spark, sf))


@check("upsert_cursors", q(EV, POLLS, _PATCH, """
SELECT host, tag_id, arg_max(min_id, seq) FILTER (WHERE min_id IS NOT NULL) AS min_id, arg_max(polled_at, seq) AS polled_at,
       arg_max(behind, seq) AS behind, arg_max(polled_at, seq) AS updated_at FROM patch GROUP BY host, tag_id"""))
def _(spark, sf):
    patches = polling.cursor_patches(poll_results(spark, sf))
    early, late = patches.filter(F.col("seq") % 2 == 0), patches.filter(F.col("seq") % 2 == 1)
    empty = spark.createDataFrame([], "host STRING, tag_id BIGINT, min_id STRING, polled_at BIGINT, behind BOOLEAN, updated_at BIGINT")
    # Cursors come from the polls in time order, so the halves interleave: fold them together.
    return merges.upsert_cursors(empty, early.unionByName(late))


@check("append_poll_log", q(EV, POLLS, """
SELECT host, "at", status, latency_ms, remaining AS ratelimit_remaining FROM poll"""))
def _(spark, sf):
    log = B.polls(spark, sf).select("host", "at", "status", "tags", "new_observations", "latency_ms", "ratelimit_remaining", "k")
    parts = [log.filter(c).drop("k") for c in (F.col("k") < 50, F.col("k") >= 50)]
    return merges.append_poll_log(*parts).select("host", "at", "status", "latency_ms", "ratelimit_remaining")


@check("upsert_tag_history", q(OBS, f"""
hist AS (SELECT tag_id, host, created_at // 86400 * 86400 AS day, count(*) AS uses, count(DISTINCT author_hex) AS accounts
         FROM credited GROUP BY ALL)""", f"""
SELECT tag_id, host, day, CASE WHEN day >= {NOW} - 86400 * 7 THEN uses + 1 ELSE uses END AS uses, accounts,
       CASE WHEN day >= {NOW} - 86400 * 7 THEN {NOW} + 60 ELSE {NOW} END AS fetched_at FROM hist"""))
def _(spark, sf):
    stored = B.tag_history(spark, sf)
    again = stored.filter(F.col("day") >= B.NOW - 7 * 86400).withColumn("uses", F.col("uses") + 1).withColumn(
        "fetched_at", F.lit(B.NOW + 60).cast("bigint"))
    return merges.upsert_tag_history(stored, again)


@check("suppress_authors", q(OBS, """
sup AS (SELECT DISTINCT substr(sha256('test-salt u' || doc_id), 1, 32) AS author_hex FROM labels WHERE quality = 0)""", """
SELECT tag_id, uri FROM obs WHERE author_hex NOT IN (SELECT author_hex FROM sup)"""))
def _(spark, sf):
    none = spark.createDataFrame([], "author_hash BINARY, added_at BIGINT")
    _, kept = merges.suppress_authors(none, B.observed(spark, sf), suppressed_authors(spark, sf), B.NOW)
    return kept.select("tag_id", "uri")


@check("suppression_list", q(OBS, f"""
sup AS (SELECT DISTINCT substr(sha256('test-salt u' || doc_id), 1, 32) AS author_hex, doc_id FROM labels WHERE quality = 0)""", f"""
SELECT author_hex, CASE WHEN doc_id % 2 = 0 THEN {NOW} - 100 ELSE {NOW} END AS added_at FROM sup"""))
def _(spark, sf):
    labels = B.table(spark, sf, "labels").filter((F.col("quality") == 0) & (F.col("doc_id") % 2 == 0))
    listed = labels.select(X.author_hash(F.concat(F.lit("u"), F.col("doc_id").cast("string")), B.SALT).alias("author_hash")).distinct()
    stored = listed.withColumn("added_at", F.lit(B.NOW - 100).cast("bigint"))
    after, _ = merges.suppress_authors(stored, B.observed(spark, sf), suppressed_authors(spark, sf), B.NOW)
    return after.select(X.hash_hex(F.col("author_hash")).alias("author_hex"), "added_at")


@check("suppressed_authors", """
SELECT DISTINCT substr(sha256('test-salt u' || doc_id), 1, 32) AS author_hex FROM labels WHERE quality = 0""")
def _(spark, sf):
    return ingest.suppressed_hex(suppressed_authors(spark, sf))


@check("remove_opted_out", q(OBS, POLLS, """
SELECT tag_id, uri, seen_mask & ~(SELECT bit_or(CAST(1 AS BIGINT) << bit) FROM registry WHERE opt_out) AS seen_mask
FROM obs WHERE origin_host NOT IN (SELECT host FROM registry WHERE opt_out)"""))
def _(spark, sf):
    kept = merges.remove_opted_out(B.observed(spark, sf), B.registry(spark, sf), clear_bits=True)
    return kept.select("tag_id", "uri", "seen_mask")


_SWEEP = f"""
kept AS (SELECT * FROM obs WHERE created_at >= {NOW} - 25 * 3600)"""


@check("retention_sweep", q(OBS, POLLS, f"{WORDS}, pool AS (SELECT name, author_hex, arg_min(observed_at, seq) AS first_seen "
       "FROM sighting GROUP BY name, author_hex)", """
rollup AS (SELECT tag_id, created_at // 60 AS minute FROM orig GROUP BY 1, 2)""", _SWEEP, f"""
SELECT 'observations' AS what, (SELECT count(*) FROM obs WHERE created_at < {NOW} - 25 * 3600) AS removed
UNION ALL SELECT 'opted_out', (SELECT count(*) FROM kept WHERE origin_host IN (SELECT host FROM registry WHERE opt_out))
UNION ALL SELECT 'candidates', (SELECT count(*) FROM pool WHERE first_seen < {NOW} - 48 * 3600)
UNION ALL SELECT 'poll_log', (SELECT count(*) FROM poll WHERE "at" < {NOW} - 7 * 86400)
UNION ALL SELECT 'rollups', (SELECT count(*) FROM rollup WHERE minute < ({NOW} - 30 * 86400) // 60)"""))
def _(spark, sf):
    tables = {"observation": B.observed(spark, sf), "tag_candidate": B.pool(spark, sf), "poll_log": B.polls(spark, sf),
              "tag_minute": B.rollups(spark, sf)}
    return merges.retention_sweep(tables, B.registry(spark, sf), B.NOW)[1]
