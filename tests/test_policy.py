import random

import pytest
from pyspark.sql import functions as F

from tagtide.operators import merges, policy, polling, ranking, windows

NOW = 1787788800
CANDIDATE = "name STRING, distinct_authors INT, distinct_origin_servers INT"
TRACKED = "id BIGINT, name STRING, posts_24h BIGINT, last_query_at BIGINT, first_seen_at BIGINT"


def names(df, order="rank"):
    return [r["name"] for r in df.orderBy(order).collect()]


def test_promotions_rank_by_servers(spark):
    rows = spark.createDataFrame([("loud", 40, 8), ("broad", 20, 12), ("few", 4, 4), ("narrow", 9, 2), ("farm", 67, 4), ("alpha", 20, 12)], CANDIDATE)
    assert names(policy.select_promotions(rows, F.lit(2))) == ["alpha", "broad"]
    assert names(policy.select_promotions(rows, F.lit(10))) == ["alpha", "broad", "loud"]
    assert names(policy.select_promotions(rows, F.lit(0))) == []
    blocked = spark.createDataFrame([("alpha",)], "name STRING")
    assert names(policy.select_promotions(rows, F.lit(2), blocked=blocked)) == ["broad", "loud"]


def test_requested_tags_go_first_and_may_leave_a_slot(spark):
    asked = spark.createDataFrame([("b", NOW - 10, 1), ("a", NOW - 10, 5), ("c", NOW - 99, 9)], "name STRING, last_query_at BIGINT, query_count BIGINT")
    pool = spark.createDataFrame([("a", 30, 20), ("pool1", 20, 10), ("pool2", 10, 5)], CANDIDATE)
    pick = lambda tracked: {(r["name"], r["source"]) for r in policy.select_promotions_with_queried(asked, pool, F.lit(tracked), 50).collect()}
    assert pick(48) == {("a", "requested"), ("b", "requested")}
    # Two slots are left for the pool; its first name is taken already, so one stays unused.
    assert pick(45) == {("a", "requested"), ("b", "requested"), ("c", "requested"), ("pool1", "discovered")}
    assert pick(50) == set() and pick(60) == set()


def test_quiet_retirement(spark):
    day = 86_400
    rows = spark.createDataFrame([
        (1, "new", 0, None, NOW - 3600), (2, "quiet", 0, None, NOW - 2 * day), (3, "asked", 0, NOW - day, NOW - 9 * day),
        (4, "stale", 0, NOW - 7 * day, NOW - 9 * day), (5, "busy", 3, None, NOW - 9 * day), (6, "edge", 0, None, NOW - day),
    ], TRACKED)
    assert {r["id"] for r in policy.select_quiet_retirements(rows, NOW).collect()} == {2, 4, 6}


@pytest.mark.parametrize("ceiling,want", [(6, set()), (5, {1}), (4, {1, 2}), (1, {1, 2, 3, 5}), (0, {1, 2, 3, 5})])
def test_excess_retirement_drops_the_quietest_unprotected(spark, ceiling, want):
    rows = spark.createDataFrame([
        (1, "a", 0, None, 0), (2, "b", 0, None, 0), (3, "c", 5, NOW - 86_400, 0), (4, "d", 1, NOW - 60, 0), (5, "e", 9, None, 0),
    ], TRACKED).unionByName(spark.createDataFrame([(6, "f", 0, NOW - 5, 0)], TRACKED))
    assert {r["id"] for r in policy.select_excess_retirements(rows, NOW, ceiling).collect()} == want


def test_non_community_retirement(spark):
    rows = spark.createDataFrame([
        (1, "farm", 100, 67, 4, None), (2, "local", 30, 6, 2, None), (3, "young", 19, 19, 1, None), (4, "news", 5000, 384, 99, None),
        (5, "kept", 100, 67, 4, NOW - 3600), (6, "edge", 20, 50, 10, None), (7, "none", 20, 0, 0, None),
    ], "id BIGINT, name STRING, posts_24h BIGINT, authors_24h BIGINT, origin_servers_24h BIGINT, last_query_at BIGINT")
    assert {r["id"] for r in policy.select_non_community_retirements(rows, NOW).collect()} == {1, 2, 7}


def test_tiers(spark):
    rows = [(i, float(50 - i), None) for i in range(1, 41)] + [(41, 0.0, NOW - 100), (42, 0.0, None), (43, 0.0, NOW - 5000)]
    df = spark.createDataFrame(rows, "id BIGINT, posts_per_hour DOUBLE, last_query_at BIGINT")
    tiers = {r["id"]: r["tier"] for r in policy.assign_tiers(df, NOW, 3, 10).collect()}
    assert tiers[41] == "hot" and [i for i in tiers if tiers[i] == "hot"] and {i for i in tiers if tiers[i] == "hot"} == {41, 1, 2}
    assert {i for i in tiers if tiers[i] == "warm"} == set(range(3, 13))
    assert tiers[42] == tiers[43] == tiers[40] == "cold"


PLAN_TAGS = "id BIGINT, name STRING, tier STRING, tracked BOOLEAN, blocked BOOLEAN"
REGISTRY = "host STRING, capability STRING, bit INT, opt_out BOOLEAN, backoff_until BIGINT"
CURSOR = "host STRING, tag_id BIGINT, min_id STRING, polled_at BIGINT, behind BOOLEAN"


def plan(spark, tags, cursors, hosts=("a", "b"), **kw):
    t = spark.createDataFrame([(i, f"t{i}", tier, True, False) for i, tier in tags], PLAN_TAGS)
    r = spark.createDataFrame([(h, "timeline", i, False, None) for i, h in enumerate(hosts)], REGISTRY)
    c = spark.createDataFrame(cursors, CURSOR)
    due = polling.due_pairs(r, t, c, NOW)
    return [(x["host"], x["tier"], x["tag_ids"], x["min_id"]) for x in polling.poll_plan(due, **kw).orderBy("position").collect()]


def test_plan_serves_hot_first_and_hosts_in_turn(spark):
    got = plan(spark, [(1, "cold"), (2, "hot"), (3, "warm"), (4, "warm")], [])
    assert [(h, t, ids) for h, t, ids, _ in got] == [
        ("a", "hot", [2]), ("b", "hot", [2]), ("a", "warm", [3, 4]), ("b", "warm", [3, 4]), ("a", "cold", [1]), ("b", "cold", [1])]
    assert len(plan(spark, [(1, "cold"), (2, "hot")], [], budget=3)) == 3 and plan(spark, [(1, "hot")], [], budget=0) == []


def test_plan_due_rules_and_oldest_cursor(spark):
    cursors = [("a", 1, "9", NOW - 300, False), ("a", 2, "10", NOW - 301, False), ("a", 3, "bad", NOW - 299, False),
               ("a", 4, "200", NOW - 1, True), ("a", 5, None, NOW - 400, False)]
    got = plan(spark, [(i, "warm") for i in (1, 2, 3, 4)], cursors, hosts=("a",))
    assert got == [("a", "warm", [4, 2, 1], "9")]
    got = plan(spark, [(i, "warm") for i in (1, 5)], cursors, hosts=("a",))
    assert got == [("a", "warm", [5, 1], None)]


def test_byte_budget_runs_whole_waves(spark):
    rows = spark.createDataFrame([(1, i, 100) for i in range(1, 21)], "tick INT, position INT, bytes BIGINT")
    run = {r["position"] for r in polling.byte_budget_cut(rows, ["tick"], 700).filter("run").collect()}
    assert run == set(range(1, 13))


def test_running_total_equals_plain_sum_over_blocks(spark):
    rng = random.Random(3)
    rows = [(k, p, rng.randrange(50)) for k, n in (("hot", 500), ("cold", 7)) for p in range(n)]
    got = ranking.running_total_before(spark.createDataFrame(rows, "k STRING, p BIGINT, v BIGINT"), ["k"], "p", "v", "before", block=16)
    for r in got.collect():
        assert r["before"] == sum(v for k, p, v in rows if k == r["k"] and p < r["p"])


def test_global_rank_numbers_everything_in_order(spark):
    values = [random.Random(i).randrange(40) for i in range(700)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v INT")
    got = [(r["rank"], r["v"], r["i"]) for r in ranking.global_rank(df, [F.desc("v"), F.asc("i")]).collect()]
    want = sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (-x[0], x[1]))
    assert sorted(got) == [(n + 1, v, i) for n, (v, i) in enumerate(want)]


def test_large_cut_per_group_is_exact_in_slices(spark):
    rows = [("hot", i) for i in range(5000)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k STRING, v INT").repartition(7)
    top = ranking.top_rows_per_group(df, ["k"], [F.desc("v")], 1500)
    assert {(r["k"], r["v"], r["rank"]) for r in top.collect()} == (
        {("hot", 4999 - i, i + 1) for i in range(1500)} | {("cold", 2 - i, i + 1) for i in range(3)})


MASKS = "tag_id BIGINT, mask BIGINT, posts BIGINT"


@pytest.mark.parametrize("rows,want", [
    ([(1, 9), (255, 1)], 1.0), ([(1, 1), (7, 1)], 2.0), ([(1, 0)], None), ([(3, 5), (1, 5)], 1.5), ([(-1, 4), (15, 1)], 0.0),
])
def test_weighted_median(spark, rows, want):
    df = spark.createDataFrame([(1, m, n) for m, n in rows], MASKS)
    got = [r["median_instances_per_post"] for r in windows.weighted_median_popcount(df).collect()]
    assert got == ([] if want is None else [want])


def test_add_servers_takes_the_lowest_free_bits(spark):
    schema = ("host STRING, software STRING, version STRING, capability STRING, bit INT, opt_out BOOLEAN, opt_out_reason STRING, "
              "probed_at BIGINT, last_ok_at BIGINT, consecutive_failures INT, backoff_until BIGINT, added_at BIGINT")
    stored = spark.createDataFrame([("a", None, None, "timeline", 1, False, None, None, None, 0, None, 0),
                                    ("b", None, None, "timeline", None, False, None, None, None, 0, None, 0)], schema)
    new = spark.createDataFrame([("z", 1), ("a", 2), ("y", 3), ("x", 4)], "host STRING, seq INT")
    rows = {r["host"]: r["bit"] for r in merges.add_servers(stored, new, NOW, width=3).collect()}
    assert rows == {"a": 1, "b": None, "z": 0, "y": 2}
