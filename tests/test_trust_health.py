import itertools
import random

import pytest
from pyspark.sql import functions as F

from tagtide.functions.servers import backoff_seconds  # noqa: F401
from tagtide.operators import health, robots, trust
from tagtide.plans import reports

POLL = "host STRING, at BIGINT, seq BIGINT, status INT, ok BOOLEAN, remaining INT, reset BIGINT"
STATE = "host STRING, consecutive_failures INT"


def step(state, poll, floor=30):
    """The rules for one poll, one at a time: the brute-force side of the check."""
    failures, _, last_ok, capability = state
    _, at, _, status, ok, remaining, reset = poll
    if status == 429:
        return failures, at + 60 if reset is None else reset, last_ok, capability
    if ok:
        low = remaining is not None and remaining < floor
        return 0, ((at + 60 if reset is None else reset) if low else None), at, capability
    failures += 1
    return failures, at + min(3600, 60 * 2 ** (failures - 1)), last_ok, "tags_only" if status in (401, 403, 422) else capability


def test_fold_equals_step_by_step(spark):
    rng = random.Random(11)
    polls, start = [], {f"h{i}": i for i in range(8)}
    for seq in range(400):
        status = rng.choice([200, 200, 429, 500, 422, 0])
        polls.append((f"h{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}", 1000 + seq // 5, seq, status, status == 200,
                      rng.choice([None, 10, 30, 200]), rng.choice([None, 5000])))
    polls += [("h7", 1, 1, 503, False, None, None), ("h7", 2, 2, 429, False, None, None)]
    want = {}
    for host, mine in itertools.groupby(sorted(polls), key=lambda p: p[0]):
        state = (start[host], None, None, None)
        for poll in mine:
            state = step(state, poll)
        want[host] = state
    rng.shuffle(polls)
    got = health.fold_health(spark.createDataFrame(polls, POLL), spark.createDataFrame(list(start.items()), STATE))
    assert {r["host"]: tuple(r)[1:] for r in got.collect()} == want


def test_last_per_batch_keeps_only_the_final_outcome(spark):
    polls = [("h", 10, 1, 200, True, None, None), ("h", 10, 2, 422, False, None, None), ("h", 20, 3, 422, False, None, None),
             ("h", 20, 4, 500, False, None, None)]
    df, start = spark.createDataFrame(polls, POLL), spark.createDataFrame([("h", 5)], STATE)
    whole, last = health.fold_health(df, start).first(), health.fold_health(df, start, last_per_batch=True).first()
    assert (whole["last_ok_at"], whole["capability"], whole["consecutive_failures"]) == (10, "tags_only", 3)
    assert (last["last_ok_at"], last["capability"], last["consecutive_failures"]) == (None, "tags_only", 3)


@pytest.mark.parametrize("body,permitted", [
    (None, True), ("", True), ("User-agent: *\nDisallow: /", False), ("User-agent: *\nDisallow:", True),
    ("User-agent: *\nDisallow: /admin", True), ("User-agent: *\nDisallow: /api/v1/tags/", False),
    ("User-agent: *\nDisallow: /\nAllow: /api/v1/", True), ("User-agent: *\nDisallow: /api/\nAllow: /api/", True),
    ("User-agent: tagtide\nDisallow: /\n\nUser-agent: *\nAllow: /", False), ("User-agent: TagTide\nAllow: /\n\nUser-agent: *\nDisallow: /", True),
    ("User-agent: other\nDisallow: /", True), ("User-agent: a\nUser-agent: *\nDisallow: /", False),
    ("User-agent: zz\nDisallow: /\nUser-agent: *\nDisallow: /x", True), ("# User-agent: *\n# Disallow: /", True),
    ("user-agent: *\ndisallow: / # all", False), ("<html>Disallow: /</html>", True), ("Disallow: /\nUser-agent: *\nAllow: /x", False),
    ("User-agent: *\r\nCrawl-delay: 5\r\nDisallow: /api", False), ("nonsense", True),
    ("User-agent: *\nDisallow: /\n" + "#" * 100_000, False),
])
def test_robots(one, body, permitted):
    assert one(robots.robots_permit(F.col("b")), "b STRING", body) is permitted


def verdict(one, claim, scope="index", standing="tracked", authors=40, now=20, before=10, comparable=True, coverage="good",
            sightings=None, reported=None):
    cols = ["claim", "scope", "standing", "authors", "now", "before", "comparable", "coverage", "sightings", "reported"]
    expr = trust.claim_verdict(*[F.col(c) for c in cols])
    kinds = "claim STRING, scope STRING, standing STRING, authors INT, now INT, before INT, comparable BOOLEAN, coverage STRING, sightings INT, reported INT"
    got = one(expr, kinds, claim, scope, standing, authors, now, before, comparable, coverage, sightings, reported)
    return tuple(got)


UNTRACKED = dict(authors=None, now=None, before=None, coverage=None)


@pytest.mark.parametrize("claim,over,want", [
    ("rising", {}, ("allowed", "direction_matches", "rising")),
    ("falling", {}, ("blocked", "data_says_opposite", "rising")),
    ("rising", dict(now=21, before=20), ("blocked", "data_says_flat", "flat")),
    ("rising", dict(comparable=False), ("blocked", "coverage_changed", "observed")),
    ("rising", dict(now=4, before=1), ("blocked", "too_few_authors", "observed")),
    ("rising", dict(now=8, before=0), ("allowed", "direction_matches", "rising")),
    ("rising", dict(standing="discovered", sightings=6, **UNTRACKED), ("blocked", "not_polled", "sighted")),
    ("busy", {}, ("qualified", "judgement", "observed")),
    ("busy", dict(coverage="thin"), ("qualified", "judgement_thin_coverage", "observed")),
    ("busy", dict(authors=0), ("blocked", "nothing_observed", "no_evidence")),
    ("quiet", {}, ("qualified", "judgement", "observed")),
    ("quiet", dict(coverage="thin"), ("blocked", "coverage_thin", "observed")),
    ("quiet", dict(standing="unseen", **UNTRACKED), ("blocked", "not_polled", "no_evidence")),
    ("in_use", dict(standing="unseen", reported=9, **UNTRACKED), ("allowed", "positive_evidence", "server_reported")),
    ("in_use", dict(standing="unseen", **UNTRACKED), ("blocked", "no_evidence", "no_evidence")),
    ("unused", {}, ("blocked", "observed_in_use", "observed")),
    ("unused", dict(standing="unseen", **UNTRACKED), ("blocked", "absence_is_not_evidence", "no_evidence")),
    ("rising", dict(scope="fediverse"), ("blocked", "no_complete_view", "observed")),
    ("in_use", dict(scope="fediverse", standing="discovered", sightings=3, **UNTRACKED), ("blocked", "no_complete_view", "sighted")),
])
def test_claims(one, claim, over, want):
    assert verdict(one, claim, **over) == want


def test_request_names_are_cleaned_in_order(spark):
    rows = [(1, "#Cats, cats ,DOGS,two words,,#,Cats,b3"), (2, ",".join(f"t{i}" for i in range(30))), (3, ""), (4, None)]
    got = trust.clean_candidates(spark.createDataFrame(rows, "request_id INT, tags STRING"))
    out = {}
    for r in got.orderBy("request_id", "place").collect():
        out.setdefault(r["request_id"], []).append((r["tag"], r["display"]))
    assert out[1] == [("cats", "Cats"), ("dogs", "DOGS"), ("b3", "b3")]
    assert [t for t, _ in out[2]] == [f"t{i}" for i in range(10)] and set(out) == {1, 2}


def test_server_reports_are_summed_not_merged(spark):
    days = [("cats", "b", 1, 10, 4), ("cats", "b", 2, 5, 6), ("cats", "a", 1, 1, 1), ("idle", "a", 1, 0, 0)]
    got = trust.summarise_server_reports(spark.createDataFrame(days, "tag STRING, host STRING, day BIGINT, uses BIGINT, accounts BIGINT"))
    rows = {r["tag"]: r for r in got.collect()}
    assert (rows["cats"]["uses_7d"], rows["cats"]["accounts_7d"], rows["cats"]["peak_day_accounts"]) == (16, 11, 6)
    assert [s["host"] for s in rows["cats"]["per_server"]] == ["a", "b"] and rows["idle"]["accounts_7d"] == 0


def test_sentences_are_always_present(spark):
    kinds = ["observed", "sighted", "server_reported", "flat", "rising", "falling", "no_evidence"]
    df = spark.createDataFrame([(k, "Cats", 3, 2, 9, 4, 1, 7, 5, 8) for k in kinds],
                               "may_say STRING, display STRING, authors_24h INT, origin_servers_24h INT, instances_monitored INT, sighting_authors INT, "
                               "reported_sources INT, reported_accounts_7d INT, authors_prev_1h INT, authors_1h INT")
    said = [r["s"] for r in df.select(trust.claim_sentence(F.col("may_say")).alias("s")).collect()]
    assert all(s and "#Cats" in s for s in said)


def test_shape_features_stay_in_the_frame(spark):
    rows = [(1, "a", None, "hot", 100, 50, 10), (2, "b", None, "warm", 9, 9, 1), (3, "silent", None, "cold", 0, 0, 0)]
    df = spark.createDataFrame(rows, "id BIGINT, name STRING, display STRING, tier STRING, posts_24h BIGINT, authors_24h BIGINT, origin_servers_24h BIGINT")
    got = {r["id"]: r for r in reports.shape_features(df).collect()}
    assert set(got) == {1, 2}
    assert got[2]["above_threshold"] and not got[1]["above_threshold"]
    for r in got.values():
        assert all(0 <= r[c] <= 1 for c in ("authors_share", "concentration_share", "volume_share", "threshold_share"))


def test_long_robots_files_are_judged_by_what_they_say(one):
    import time

    body = "".join(f"User-agent: bot{k}\nDisallow: /x{k}\n" for k in range(4000)) + "User-agent: *\nDisallow: /api/\n"
    assert len(body) > 100_000
    start = time.perf_counter()
    assert one(robots.robots_permit(F.col("b")), "b STRING", body) is False
    assert time.perf_counter() - start < 20  # some tens of lines took minutes when work grew with their fourth power
    assert one(robots.robots_permit(F.col("b"), max_chars=100_000), "b STRING", body) is True


def test_hosts_without_a_bit_are_named(spark):
    from tagtide.operators import merges

    schema = ("host string, software string, version string, capability string, bit int, opt_out boolean, opt_out_reason string, "
              "probed_at long, last_ok_at long, consecutive_failures int, backoff_until long, added_at long")
    registry = spark.createDataFrame([("a", None, None, "timeline", 0, False, None, None, None, 0, None, 1)], schema)
    hosts = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "host string, seq long")
    after = merges.add_servers(registry, hosts, 5, width=3)
    assert {r["host"]: r["bit"] for r in after.collect()} == {"a": 0, "b": 1, "c": 2}
    assert [tuple(r) for r in merges.rejected_servers(registry, hosts, after).collect()] == [("d", "no_free_bit")]
