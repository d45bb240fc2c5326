import unicodedata

import pytest
from pyspark.sql import functions as F

from tagtide.functions import numbers as N, ratings as R, servers as S, text as X


def column(spark, values, kind, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [r["v"] for r in rows.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_popcount(spark):
    assert column(spark, [0, 1, 3, 255, 1 << 51, -1], "BIGINT", N.popcount) == [0, 1, 2, 8, 1, 0]


def test_mask_bits_and_back(spark):
    assert column(spark, [0, 1, 10, 1 << 62], "BIGINT", N.mask_bits) == [[], [0], [1, 3], [62]]
    assert column(spark, [0, 5, 51, None], "INT", N.bit_mask) == [1, 32, 1 << 51, 0]


def test_rounding_goes_up_at_halves(spark):
    got = column(spark, [-0.125, 0.125, 2.345, -0.5], "DOUBLE", lambda x: N.round_up_half(x, 2))
    assert got == [-0.12, 0.13, 2.35, -0.5]


def test_casefold_matches_unicode_rules(spark):
    names = ["Cats", "ＣＡＴＳ", "ﬁne", "Ｃafé", "Straße", "ΟΔΟΣ", "日本語", "①", None]
    want = [None if n is None else unicodedata.normalize("NFKC", n).lower() for n in names]
    assert column(spark, names, "STRING", X.casefold_tag) == want


def test_clean_tag_input(spark):
    raw = ["Cats", "#Cats", " #cats ", "%23Cats", "##cats", "two words", "", "#", "a+b", "caf%C3%A9", "snake_case", "x" * 100,
           "x" * 101, "%E0%A4%A", "日本", "\U00020000" * 50, "\U00020000" * 51, "cats\n", "　cats　"]
    want = ["cats", "cats", "cats", "cats", None, None, None, None, None, "café", "snake_case", "x" * 100, None, None, "日本",
            "\U00020000" * 50, None, "cats", "cats"]
    assert column(spark, raw, "STRING", X.clean_tag_input) == want


def test_origin_host(spark):
    uris = ["https://Mastodon.Social/users/a/statuses/1", "http://a_b.example:8080/x", "https://me:pw@host.example/x",
            "https://host.example?x=1", "ftp://host.example/x", "nonsense", "https://", "https://ex ample/x", None,
            "acct:someone@host.example"]
    want = ["mastodon.social", "a_b.example", "host.example", "host.example", None, None, None, None, None, None]
    assert column(spark, uris, "STRING", X.origin_host) == want


def test_author_hash_is_sixteen_bytes_and_ignores_case(spark):
    a, b, c = column(spark, ["Ann@x.example", "ann@X.example", "bob"], "STRING", lambda x: X.author_hash(x, "test-salt"))
    assert len(a) == 16 and a == b != c
    (other,) = column(spark, ["bob"], "STRING", lambda x: X.author_hash(x, "other"))
    assert other != c


def test_epoch_seconds(spark):
    got = column(spark, ["2026-08-27T00:00:00.999Z", "2026-08-27T02:00:00+02:00", "not a date", "17000", None], "STRING", X.epoch_seconds)
    assert got == [1787788800, 1787788800, None, None, None]


def test_counter_prefix(spark):
    assert column(spark, ["12", " 7x", "-3", "x", "", None], "STRING", X.parse_int_prefix) == [12, 7, -3, None, None, None]


def test_snowflakes_beyond_64_bits(spark):
    got = column(spark, ["123456789012345678901234567890", "12a", "", None], "STRING", N.snowflake)
    assert got[0] == 123456789012345678901234567890 and got[1:] == [None, None, None]


def test_previous_page_cursor(spark):
    links = [
        '<https://a.example/x?max_id=1>; rel="next", <https://a.example/x?min_id=99>; rel="prev"',
        "<https://a.example/x?a=1&min_id=42>; rel=prev",
        '<https://a.example/x?max_id=1>; rel="next"', '<https://a.example/x?max_id=1>; rel="prev"', None,
    ]
    assert column(spark, links, "STRING", N.previous_page_cursor) == ["99", "42", None, None, None]


def test_reset_seconds(spark):
    got = column(spark, ["2026-08-27T00:00:00.000Z", "1787788800", "1787788800.9", "soon", None], "STRING", N.reset_seconds)
    assert got == [1787788800, 1787788800, 1787788800, None, None]


@pytest.mark.parametrize("median,monitored,want", [
    (4.0, 8, "good"), (3.9, 8, "partial"), (1.6, 8, "partial"), (1.5, 8, "thin"), (None, 8, "thin"), (4.0, 0, "thin"),
])
def test_coverage_quality(one, median, monitored, want):
    assert one(R.coverage_quality(F.col("m"), F.col("n")), "m DOUBLE, n INT", median, monitored) == want


@pytest.mark.parametrize("monitored,current,previous,want", [
    (8, 8, 8, True), (8, 8, 6, True), (8, 8, 5, False), (8, 4, 4, False), (8, 5, 5, True), (0, 0, 0, False), (10, 6, 6, True),
])
def test_coverage_comparable(one, monitored, current, previous, want):
    expr = R.coverage_comparable(F.col("m"), F.col("c"), F.col("p"))
    assert one(expr, "m INT, c INT, p INT", monitored, current, previous) is want


@pytest.mark.parametrize("current,previous,comparable,want", [
    (15, 10, True, 0.5), (5, 10, True, -0.5), (5, 0, True, None), (5, 10, False, None), (0, 0, True, None),
])
def test_trend(one, current, previous, comparable, want):
    assert one(R.trend(F.col("c"), F.col("p"), F.col("k")), "c INT, p INT, k BOOLEAN", current, previous, comparable) == want


@pytest.mark.parametrize("current,previous,comparable,direction,reason", [
    (20, 10, False, "not_comparable", "coverage_changed"), (4, 2, True, "insufficient", "too_few_authors"),
    (8, 0, True, "up", "nothing_before"), (21, 20, True, "flat", None), (20, 10, True, "up", None),
    (10, 20, True, "down", None), (22, 20, True, "up", None),
])
def test_direction(one, current, previous, comparable, direction, reason):
    got = one(R.direction(F.col("c"), F.col("p"), F.col("k")), "c INT, p INT, k BOOLEAN", current, previous, comparable)
    assert (got["direction"], got["reason"]) == (direction, reason)


def test_exactly_the_band_differs_between_the_two_readings(one):
    assert one(R.window_direction(F.col("t"), F.lit(True)), "t DOUBLE", 0.1) == "flat"
    assert one(R.direction(F.col("c"), F.col("p"), F.lit(True)), "c INT, p INT", 110, 100)["direction"] == "up"


# Measured tags: authors, servers, and whether the gates pass them.
@pytest.mark.parametrize("authors,servers,passes", [
    (67, 4, False), (33, 4, False), (14, 2, False), (17, 1, False), (384, 99, True), (161, 65, True), (7, 3, True), (40, 17, True),
    (50, 10, True), (51, 10, False), (4, 3, False), (5, 0, False),
])
def test_promotion_gates(one, authors, servers, passes):
    assert one(R.passes_promotion_gates(F.col("a"), F.col("s")), "a INT, s INT", authors, servers) is passes


def test_ratios(one):
    assert one(R.posts_per_author(F.col("p"), F.col("a")), "p INT, a INT", 7, 3) == 2.3
    assert one(R.posts_per_author(F.col("p"), F.col("a")), "p INT, a INT", 7, 0) is None
    assert one(R.sightings_per_author(F.col("p"), F.col("a")), "p INT, a INT", 3, 3) is None
    assert one(R.sightings_per_author(F.col("p"), F.col("a")), "p INT, a INT", 10, 4) == 2.5
    assert one(R.authors_per_server(F.col("p"), F.col("a")), "p INT, a INT", 10, 0) is None
    assert one(R.authors_per_server(F.col("p"), F.col("a"), 0.0), "p INT, a INT", 10, 0) == 0.0


def test_backoff(spark):
    assert column(spark, [-1, 0, 1, 2, 3, 6, 7, 500], "INT", S.backoff_seconds) == [0, 0, 60, 120, 240, 1920, 3600, 3600]


@pytest.mark.parametrize("timeline_ok,status,tags_ok,software,want", [
    (True, 200, True, "mastodon", "timeline"), (False, 422, True, "mastodon", "tags_only"), (False, 0, False, None, "unknown"),
    (False, 404, False, " Misskey ", "activitypub"), (False, 404, False, "nginx", "blocked"), (False, 404, False, None, "blocked"),
])
def test_classify_probe(one, timeline_ok, status, tags_ok, software, want):
    expr = S.classify_probe(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    assert one(expr, "a BOOLEAN, b INT, c BOOLEAN, d STRING", timeline_ok, status, tags_ok, software) == want


@pytest.mark.parametrize("standing,authors,servers,posts_ratio,want", [
    ("unseen", None, None, None, "no_evidence"), ("tracked", 0, 0, None, "known_but_silent"), ("tracked", 67, 4, 6.0, "publisher"),
    ("tracked", 3, 1, 8.0, "few_repeating"), ("tracked", 384, 99, 14.3, "many_accounts"), ("discovered", 7, 3, None, "many_accounts"),
])
def test_reading_shape(one, standing, authors, servers, posts_ratio, want):
    per_server = R.authors_per_server(F.col("a"), F.col("v"))
    got = one(R.reading_shape(F.col("s"), F.col("a"), per_server, F.col("r")), "s STRING, a INT, v INT, r DOUBLE",
              standing, authors, servers, posts_ratio)
    assert got == want


def test_masks_have_63_bits(one):
    from pyspark.errors import PySparkException

    from tagtide.functions.numbers import bit_mask

    assert [one(bit_mask(F.col("b")), "b INT", b) for b in (0, 62, None)] == [1, 1 << 62, 0]
    for bit in (63, 64, -1):
        with pytest.raises(PySparkException, match="no mask has bit"):
            one(bit_mask(F.col("b")), "b INT", bit)
