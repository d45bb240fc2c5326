"""Declared schemas of the raw inputs and of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_post_fields = [
    T.StructField("id", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("visibility", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("sensitive", T.BooleanType()),
    T.StructField("account", T.StructType([T.StructField("acct", T.StringType())])),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
]

# A boost wraps one post; wrapped posts are read one level deep.
STATUS = T.StructType([*_post_fields, T.StructField("reblog", T.StructType(_post_fields))])

CAPTURED_PAGE = T.StructType([
    T.StructField("server", T.StringType()),
    T.StructField("batch_at", T.LongType()),
    T.StructField("page_id", T.StringType()),
    T.StructField("link_header", T.StringType()),
    T.StructField("body", T.StringType()),
])

TAG_COUNTERS = T.StructType([
    T.StructField("server", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("history", T.ArrayType(T.StructType([
        T.StructField("day", T.StringType()),
        T.StructField("uses", T.StringType()),
        T.StructField("accounts", T.StringType()),
    ]))),
])

REGISTRY = (
    "host STRING, software STRING, version STRING, capability STRING, bit INT, opt_out BOOLEAN, "
    "opt_out_reason STRING, probed_at BIGINT, last_ok_at BIGINT, consecutive_failures INT, "
    "backoff_until BIGINT, added_at BIGINT"
)
TAG = (
    "id BIGINT, name STRING, display STRING, tier STRING, first_seen_at BIGINT, last_query_at BIGINT, "
    "query_count BIGINT, blocked BOOLEAN, tracked BOOLEAN, retired_at BIGINT"
)
OBSERVATION = (
    "tag_id BIGINT, uri STRING, url STRING, origin_host STRING, author_hash BINARY, created_at BIGINT, "
    "observed_at BIGINT, seen_mask BIGINT, is_boost BOOLEAN, sensitive BOOLEAN, language STRING"
)
CURSOR = "host STRING, tag_id BIGINT, min_id STRING, polled_at BIGINT, behind BOOLEAN, updated_at BIGINT"
TAG_MINUTE = "tag_id BIGINT, minute BIGINT, posts BIGINT, instances_reporting BIGINT"
POLL_LOG = (
    "host STRING, at BIGINT, status INT, tags INT, new_observations BIGINT, latency_ms DOUBLE, "
    "ratelimit_remaining INT"
)
TAG_HISTORY = "tag_id BIGINT, host STRING, day BIGINT, uses BIGINT, accounts BIGINT, fetched_at BIGINT"
TAG_CANDIDATE = (
    "name STRING, author_hash BINARY, first_seen BIGINT, origin_host STRING, tags_on_post INT, posts_seen BIGINT"
)
