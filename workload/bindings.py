"""Reads the driver tables as posts, sightings, servers, polls, tags and candidates.

Two views are used. *Events* turns each event into a post seen by up to three of
nine servers, with minute-level times. *Trade* turns each order into a post and
each of its line items into a sighting by the supplier's nation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagtide.functions.arrays import unfold
from tagtide.functions.numbers import bit_mask
from tagtide.functions.text import author_hash
from tagtide.operators import ingest

NOW = 1706616000  # 2024-01-30 12:00 UTC
TRADE_NOW = 996710400  # 2001-08-02 00:00 UTC
TRADE_WINDOWS = {"30d": 30 * 86400, "90d": 90 * 86400, "365d": 365 * 86400}
SALT = "test-salt"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table that comes in fewer pieces than there are cores, spread by key.

    A table of many files is left as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def pick(index: Column, *values: str | None) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), index.cast("int"))


# -- events ------------------------------------------------------------------

def event_rows(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select("event_id", "user_id", "event_type", "value", k.alias("k"), seconds(F.col("ts")).alias("created_at"))


def event_posts_of(rows: DataFrame) -> DataFrame:
    i, k = F.col("event_id"), F.col("k")
    origin = F.concat(F.lit("h"), (i % 13).cast("string"), F.lit(".example"))
    uri = F.concat(F.lit("https://"), origin, F.lit("/p/"), i.cast("string"))
    servers = F.array_distinct(F.array(k % 9, (k * 7 + 3) % 9, F.floor(k / 10).cast("int") % 9))
    return rows.select(
        uri.alias("uri"), F.when(i % 5 != 0, uri).alias("url"), origin.alias("origin_host"),
        author_hash(F.concat(F.lit("u"), F.col("user_id").cast("string")), SALT).alias("author_hash"),
        "created_at", (i % 11 == 0).alias("is_boost"), (i % 7 == 0).alias("sensitive"),
        pick(i % 4, "en", "de", "fr", None).alias("language"),
        F.array("event_type", F.concat("event_type", F.lit("_"), F.floor(k / 10).cast("string"))).alias("tags"),
        servers.alias("servers"), i.alias("seq"),
    )


def event_views_of(rows: DataFrame) -> DataFrame:
    """Posts as each reporting server showed them, with that server's mask."""
    views = unfold(event_posts_of(rows), "servers", "s")
    return views.withColumn("host", F.concat(F.lit("h"), F.col("s").cast("string"), F.lit(".example"))).withColumn(
        "observed_at", F.col("created_at") + 5 + F.col("s") * 7 + F.col("seq") % 50
    ).withColumn("mask", bit_mask(F.col("s"))).drop("servers", "s")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return event_rows(spread(table(spark, sf, "events"), "event_id"))


def event_views(spark: SparkSession, sf: str) -> DataFrame:
    return event_views_of(events(spark, sf))


def event_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tag table: one row per event type and per type with its tens digit."""
    slot = F.floor(F.col("k") / 10).cast("int")
    pairs = events(spark, sf).select("event_id", F.explode(F.array(
        F.struct(F.col("event_type").alias("name"), F.lit(0).alias("slot")),
        F.struct(F.concat("event_type", F.lit("_"), slot.cast("string")).alias("name"), (slot + 1).alias("slot")),
    )).alias("t"))
    first = pairs.groupBy("t.name", "t.slot").agg(F.min("event_id").alias("m"))
    m, s = F.col("m"), F.col("slot")
    tracked = (m + s) % 4 != 0
    return first.select(
        (m * 16 + s).alias("id"), "name", F.when(m % 2 == 0, F.upper("name")).alias("display"),
        pick(m % 3, "hot", "warm", "cold").alias("tier"), (F.lit(NOW) - (m % 5 + 1) * 43200).alias("first_seen_at"),
        F.when(m % 3 == 0, F.lit(NOW) - (m % 100) * 600).alias("last_query_at"), (m % 7).alias("query_count"),
        (s == 7).alias("blocked"), tracked.alias("tracked"),
        F.when(~tracked & (m % 2 == 0), F.lit(NOW - 86400)).cast("bigint").alias("retired_at"),
    )


def polls_of(rows: DataFrame) -> DataFrame:
    """One poll per event, with a status made from the event type."""
    k, e = F.col("k"), F.col("event_type")
    status = F.when(e == "error", 503).when(e == "signup", 429).when((e == "click") & (k < 30), 422).otherwise(200)
    return rows.select(
        F.concat(F.lit("h"), (k % 9).cast("string"), F.lit(".example")).alias("host"), F.col("created_at").alias("at"),
        F.col("event_id").alias("seq"), status.alias("status"), (status == 200).alias("ok"),
        F.col("value").alias("latency_ms"), (300 - 3 * k).alias("remaining"),
        (300 - 3 * k).alias("ratelimit_remaining"),
        F.when(F.col("event_id") % 4 == 0, F.col("created_at") + 120).alias("reset"),
        (k * 1000).cast("bigint").alias("bytes"), (k % 50).alias("returned"), k.alias("k"),
        F.lit(1).alias("tags"), F.lit(0).cast("bigint").alias("new_observations"),
    )


def polls(spark: SparkSession, sf: str) -> DataFrame:
    return polls_of(events(spark, sf))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    s = F.regexp_extract("host", r"^h(\d+)", 1).cast("int")
    good = (F.col("status") == 200) & (F.col("at") < NOW)
    hosts = polls(spark, sf).groupBy("host").agg(
        F.min("at").alias("added_at"), F.max(F.when(good, F.col("at"))).alias("last_ok_at")
    ).withColumn("s", s)
    s = F.col("s")
    return hosts.select(
        "host", F.when(s % 2 == 0, "mastodon").otherwise("pleroma").alias("software"),
        F.concat(F.lit("4."), s.cast("string")).alias("version"),
        F.when(s == 7, "tags_only").when(s == 8, "activitypub").otherwise("timeline").alias("capability"),
        s.alias("bit"), (s == 6).alias("opt_out"), F.when(s == 6, "requested").alias("opt_out_reason"),
        F.when(s % 3 != 0, F.lit(NOW) - s.cast("bigint") * 172800).alias("probed_at"),
        F.when(s != 5, F.col("last_ok_at")).alias("last_ok_at"), (s % 4).alias("consecutive_failures"),
        F.when(s == 3, F.lit(NOW + 600)).when(s == 4, F.lit(NOW - 600)).cast("bigint").alias("backoff_until"), "added_at",
    )


def credited(views: DataFrame, tags: DataFrame) -> DataFrame:
    """Views credited to every tag of the table, polled now or only earlier."""
    return ingest.tag_sightings(views).join(tags.select(F.col("id").alias("tag_id"), "name"), "name")


def observed(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.merge_sightings(credited(ingest.combine_views(event_views(spark, sf)), event_tags(spark, sf)))


def rollups(spark: SparkSession, sf: str) -> DataFrame:
    from tagtide.operators.windows import minute_rollup

    return minute_rollup(observed(spark, sf), F.lit(9))


def cursors(spark: SparkSession, sf: str) -> DataFrame:
    """The newest poll of each (server, tag type) as a stored cursor."""
    k = F.col("k")
    rows = events(spark, sf).filter(F.col("created_at") < NOW).select(
        F.concat(F.lit("h"), (k % 9).cast("string"), F.lit(".example")).alias("host"), F.col("event_type").alias("name"),
        "event_id", "created_at", "k",
    )
    last = rows.groupBy("host", "name").agg(F.max_by(F.struct("created_at", "k", "event_id"), "event_id").alias("c"))
    tags = event_tags(spark, sf).select(F.col("id").alias("tag_id"), "name")
    c = F.col("c")
    return last.join(tags, "name").select(
        "host", "tag_id",
        F.when(c["k"] % 5 == 0, F.lit(None).cast("string")).when(c["k"] % 7 == 0, F.lit("bad"))
        .otherwise(F.concat(F.lit("11199"), F.lpad(c["event_id"].cast("string"), 12, "0"))).alias("min_id"),
        c["created_at"].alias("polled_at"), (c["k"] % 4 == 0).alias("behind"), c["created_at"].alias("updated_at"),
    )


def tag_history(spark: SparkSession, sf: str) -> DataFrame:
    """Each server's own daily counters, from the views it showed."""
    rows = credited(event_views(spark, sf), event_tags(spark, sf))
    day = (F.floor(F.col("created_at") / 86400) * 86400).alias("day")
    return rows.groupBy("tag_id", "host", day).agg(
        F.count("*").alias("uses"), F.countDistinct("author_hash").alias("accounts")
    ).withColumn("fetched_at", F.lit(NOW).cast("bigint"))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Daily counters by name for words of the documents: what servers say of unpolled tags."""
    rows = word_rows(spark, sf)
    return rows.select(
        F.col("name").alias("tag"), F.concat(F.lit("h"), (F.col("doc_id") % 2).cast("string"), F.lit(".example")).alias("host"),
        (F.lit(NOW - 43200) - (F.col("doc_id") % 7) * 86400).alias("day"), F.col("doc_id"),
    ).groupBy("tag", "host", "day").agg(
        F.count("*").alias("uses"), F.countDistinct(F.col("doc_id") % 5).alias("accounts")
    )


# -- pool --------------------------------------------------------------------

def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct words of every whole document, as tags seen on a post."""
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), F.lower))
    d = F.col("doc_id")
    docs = spread(table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id").select(
        "doc_id", "source", words.alias("words"),
        author_hash(F.concat(F.lit("d"), (d % 37).cast("string")), SALT).alias("author_hash"),
    )
    return unfold(docs.withColumn("n_words", F.size("words")), "words", "name").drop("words")


def word_sightings(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return word_rows(spark, sf).select(
        "name", "author_hash", F.col("source").alias("origin_host"),
        F.least(F.col("n_words"), F.lit(20)).alias("tags_on_post"), (F.lit(NOW) - (d % 72) * 3600).alias("observed_at"),
        F.lit("h0.example").alias("host"), d.alias("seq"),
    )


def pool(spark: SparkSession, sf: str) -> DataFrame:
    detail = F.struct(F.col("observed_at").alias("first_seen"), "origin_host", "tags_on_post")
    return (
        word_sightings(spark, sf).groupBy("name", "author_hash")
        .agg(F.min_by(detail, "seq").alias("d"), F.count("*").alias("posts_seen"))
        .select("name", "author_hash", "d.*", "posts_seen")
    )


# -- trade -------------------------------------------------------------------

def nation_host(key: Column) -> Column:
    return F.concat(F.lit("n"), key.cast("string"), F.lit(".example"))


def trade_posts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").join(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"), "o_custkey"
    )
    i = F.col("o_orderkey")
    origin = nation_host(F.col("c_nationkey"))
    uri = F.concat(F.lit("https://"), origin, F.lit("/o/"), i.cast("string"))
    return o.select(
        "o_orderkey", uri.alias("uri"), F.when(i % 5 != 0, uri).alias("url"), origin.alias("origin_host"),
        author_hash(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), SALT).alias("author_hash"),
        seconds(F.col("o_orderdate")).alias("created_at"), (i % 11 == 0).alias("is_boost"), (i % 7 == 0).alias("sensitive"),
        pick(i % 4, "en", "de", "fr", None).alias("language"),
        F.array(F.lower("c_mktsegment"), F.lower("o_orderpriority"), F.lower("o_orderstatus")).alias("tags"),
    )


def trade_views(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").join(
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey"
    ).select(
        F.col("l_orderkey").alias("o_orderkey"), nation_host(F.col("s_nationkey")).alias("host"),
        seconds(F.col("l_shipdate")).alias("observed_at"), F.col("l_linenumber").alias("seq"),
    )
    return lines.join(trade_posts(spark, sf), "o_orderkey").drop("o_orderkey")


def trade_tags(spark: SparkSession, sf: str) -> DataFrame:
    names = trade_posts(spark, sf).select("o_orderkey", F.posexplode("tags").alias("slot", "name"))
    first = names.groupBy("name", "slot").agg(F.min("o_orderkey").alias("m"))
    return first.select(
        (F.col("m") * 4 + F.col("slot")).alias("id"), "name", F.lit(None).cast("string").alias("display"),
        F.lit("warm").alias("tier"), F.lit(TRADE_NOW - 86400).cast("bigint").alias("first_seen_at"),
        F.lit(None).cast("bigint").alias("last_query_at"), F.lit(0).cast("bigint").alias("query_count"),
        F.lit(False).alias("blocked"), F.lit(True).alias("tracked"), F.lit(None).cast("bigint").alias("retired_at"),
    )


def trade_registry(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        nation_host(n).alias("host"), n.alias("bit"), (F.col("n_regionkey") == 4).alias("opt_out"),
        F.when(n % 5 == 4, "tags_only").otherwise("timeline").alias("capability"),
        F.lit(None).cast("bigint").alias("backoff_until"), F.col("n_regionkey").alias("region"),
    )


def trade_observed(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.observations(trade_views(spark, sf), trade_tags(spark, sf), trade_registry(spark, sf))
