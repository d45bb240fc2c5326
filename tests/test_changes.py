"""The stored tables of the collection stream: incremental minutes, tombstones, retention, reports, replays."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tagtide.sources import raw
from tagtide.streaming import changes, jobs

DAY = 86_400
POSTS = ("host string, uri string, url string, origin_host string, author_hash binary, created_at long, observed_at long, "
         "is_boost boolean, sensitive boolean, language string, tags array<string>, skip_reason string, seq long")


@pytest.fixture(scope="module")
def tags(spark):
    return spark.createDataFrame([(1, "cats", True, False)], "id long, name string, tracked boolean, blocked boolean")


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("h0", 0, False), ("h1", 1, False), ("out", 2, True)], "host string, bit int, opt_out boolean")


def post(uri, created, host="h0", author=b"a", origin="o", names=("cats",), skip=None, at=None):
    return (host, uri, None, origin, author, created, created + 5 if at is None else at, False, False, None, list(names), skip, 1)


@pytest.fixture
def collect(spark, folder, tags, registry):
    def run(n, *posts, **more):
        jobs.collect_batch(spark.createDataFrame(list(posts), POSTS), n, folder, tags, registry, "salt", **more)

    return run


def stored(spark, folder):
    return {(r["uri"], r["created_at"], r["seen_mask"]) for r in jobs.current_observations(spark, folder).collect()}


def minutes(spark, folder):
    return {(r["minute"], r["posts"], r["instances_reporting"]) for r in jobs.current_rollups(spark, folder).collect()}


def folders(root, table):
    return sorted(n for n in os.listdir(f"{root}/{table}") if n.startswith("batch=")) if os.path.isdir(f"{root}/{table}") else []


def test_minutes_are_kept_up_from_their_own_days(spark, folder, collect):
    collect(0, post("a", 10 * DAY), post("b", 10 * DAY + 1), post("old", 5 * DAY), reporting=4)
    old = f"{folder}/observation/batch=0/created_date=1970-01-06"
    for name in os.listdir(old):
        if name.endswith(".parquet"):
            with open(f"{old}/{name}", "wb") as f:
                f.write(b"not a table")  # whoever reads this day fails
    for _ in range(2):  # a repeated batch has no effect
        collect(1, post("a", 10 * DAY, host="h1"), post("c", 10 * DAY + 59), post("d", 10 * DAY + 60), reporting=2)
        assert minutes(spark, folder) == {(5 * 1440, 1, 4), (14400, 3, 4), (14401, 1, 2)}
    assert {(r["uri"], r["seen_mask"]) for r in changes.current_observations(spark, folder, days=[date(1970, 1, 11)]).collect()} == {
        ("a", 3), ("b", 1), ("c", 1), ("d", 1)}


def test_a_view_with_another_time_joins_its_post_and_its_minute(spark, folder, collect):
    collect(0, post("a", 10 * DAY))
    for _ in range(2):
        collect(1, post("a", 13 * DAY, host="h1"), post("b", 13 * DAY))
        assert stored(spark, folder) == {("a", 10 * DAY, 3), ("b", 13 * DAY, 1)}
        assert minutes(spark, folder) == {(14400, 1, 2), (13 * 1440, 1, 2)}
    assert changes.consolidate(spark, folder, "post_index", 1) == 2
    collect(2, post("a", 14 * DAY, host="h1"), post("b", 15 * DAY, host="h1"))
    assert stored(spark, folder) == {("a", 10 * DAY, 3), ("b", 13 * DAY, 3)}


def test_a_suppressed_author_stays_away(spark, folder, collect, registry):
    collect(0, post("a", DAY, author=b"x"), post("b", DAY), post("c", DAY, origin="out"))
    assert len(stored(spark, folder)) == 3
    jobs.suppress(spark, folder, spark.createDataFrame([(b"x",)], "author_hash binary"))
    changes.entomb(spark, folder, changes.tombstones_of_origins(registry, 0))
    assert {u for u, *_ in stored(spark, folder)} == {"b"}
    collect(1, post("a2", DAY, author=b"x"), post("c2", DAY, origin="out"))
    assert {u for u, *_ in stored(spark, folder)} == {"b", "c2"}  # the origin's removal held up to batch 0
    changes.consolidate(spark, folder, "observation", 1)
    assert folders(folder, "observation") == [] and folders(folder, "observation.base") == ["batch=1"]
    raw = spark.read.parquet(f"{folder}/observation.base/batch=1")
    assert {r["uri"] for r in raw.collect()} == {"b", "c2"}  # burnt in
    collect(2, post("a", DAY, author=b"x"), post("d", DAY))
    assert {u for u, *_ in stored(spark, folder)} == {"b", "c2", "d"}


def test_suppressed_counts_for_normalised_posts_too(spark, folder, collect):
    collect(0, post("a", DAY, author=b"x"), post("b", DAY), suppressed=spark.createDataFrame([(b"x",)], "author_hash binary"))
    assert {u for u, *_ in stored(spark, folder)} == {"b"}
    assert spark.read.parquet(f"{folder}/tick_report/batch=0").first()["suppressed"] == 1


def test_reports_come_with_the_batch_and_are_replaced_by_a_replay(spark, folder, collect):
    rows = [post("a", DAY), post("a", DAY, host="h1"), post("b", DAY + 61, names=("cats", "new")), post("c", DAY, names=("new", "newer")),
            post("d", DAY, skip="non_public"), post("e", DAY, skip="malformed")]
    for _ in range(2):
        collect(0, *rows)
        collect(1)
        got = {r["batch"]: r for r in jobs.read_changes(spark, folder, "tick_report").collect()}
        assert [got[0][c] for c in jobs.TICK] == [4, 1, 1, 0, 2, 2, 2, 2, 2]
        assert [got[1][c] for c in jobs.TICK] == [0] * 9
    assert jobs.current_observations(spark, folder).count() == 2


def test_retention_takes_rows_and_folders(spark, folder, collect, registry):
    now = 50 * DAY
    collect(0, post("old", now - 26 * 3600, names=("cats", "n1")), post("fresh", now - 3600, names=("cats", "n2")),
            post("gone", now - 60, origin="out"), post("edge", now - 25 * 3600 + 1))
    polls = spark.createDataFrame([("h0", now - 8 * DAY, 200, 1, 0, 1.0, 5), ("h0", now - DAY, 200, 1, 0, 1.0, 5)], changes.schemas.POLL_LOG)
    jobs.write_change(polls, folder, "poll_log", 0)
    rolled = [(1, (now - 31 * DAY) // 60, 3, 1), (1, now // 60, 2, 1)]
    collect(1, post("fresh", now - 3600, host="h1"))
    jobs.write_change(jobs.current_rollups(spark, folder).unionByName(spark.createDataFrame(rolled, changes.schemas.TAG_MINUTE)), folder, "tag_minute", 2)
    for _ in range(2):
        left = jobs.retain(spark, folder, now, 2, registry)
        assert left["poll_log"] == 1 and left["observation"] == 2 and left["post_index"] == 3
        assert {(u, m) for u, _, m in stored(spark, folder)} == {("fresh", 3), ("edge", 1)}
        assert {r["at"] for r in jobs.current_poll_log(spark, folder).collect()} == {now - DAY}
        assert (now - 31 * DAY) // 60 not in {m for m, *_ in minutes(spark, folder)} and len(minutes(spark, folder)) == 5
        assert {r["name"] for r in jobs.current_candidates(spark, folder).collect()} == {"n1", "n2"}
    jobs.retain(spark, folder, now + 60 * DAY, 3, registry)
    assert not stored(spark, folder) and not minutes(spark, folder) and jobs.current_candidates(spark, folder).count() == 0


def test_folders_do_not_grow(spark, folder, tags, registry):
    pages = f"{folder}/pages"
    for k in range(8):
        spark.createDataFrame([post(f"u{k}", (100 + k) * 3600, names=("cats", f"n{k}"))], POSTS).coalesce(1).write.mode("append").parquet(pages)
    stream = spark.readStream.schema(POSTS).option("maxFilesPerTrigger", 1).parquet(pages)
    root = f"{folder}/tables"
    jobs.start_collection(stream, root, f"{folder}/state", tags, registry, "salt", retain_every=2).awaitTermination()
    for table in (*changes.CLOCKS, *changes.BY_BATCH):
        assert len(folders(root, table)) <= 2 and len(folders(root, f"{table}.base")) <= 1, table
    assert len(folders(root, "tombstone")) + len(folders(root, "tombstone.base")) <= 1
    kept = {u for u, *_ in stored(spark, root)}
    assert kept <= {f"u{k}" for k in range(8)} and 0 < len(kept) <= 8 and len(folders(root, "tick_report")) == 8
    assert not [n for n in os.listdir(folder) if n.startswith("batch-")]


def test_a_half_written_base_is_not_read(spark, folder, collect):
    collect(0, post("a", DAY))
    os.makedirs(f"{folder}/observation.base/batch=0/created_date=1970-01-02")
    assert {u for u, *_ in stored(spark, folder)} == {"a"}
    changes.consolidate(spark, folder, "observation", 0)
    assert {u for u, *_ in stored(spark, folder)} == {"a"} and folders(folder, "observation") == []
    with pytest.raises(ValueError, match="already folded"):
        changes.consolidate(spark, folder, "observation", -1)


TAG = "id long, name string, tracked boolean, blocked boolean"


def test_a_promoted_tag_is_collected_from_the_next_batch_on(spark, folder, registry):
    def run(n, *posts):
        jobs.collect_batch(spark.createDataFrame(list(posts), POSTS), n, folder, None, registry, "salt")

    with pytest.raises(FileNotFoundError, match="tag table"):
        run(0, post("a", DAY))
    assert jobs.publish_tags(spark, folder, spark.createDataFrame([(1, "cats", True, False), (2, "new", False, False)], TAG)) == 0
    run(0, post("a", DAY, names=("cats", "new")))
    jobs.publish_tags(spark, folder, spark.createDataFrame([(1, "cats", True, False), (2, "new", True, False)], TAG))
    run(0, post("a", DAY, names=("cats", "new")))  # a repeated batch keeps its own version
    assert {(r["tag_id"], r["uri"]) for r in jobs.current_observations(spark, folder).collect()} == {(1, "a")}
    run(1, post("b", DAY, names=("cats", "new")))
    assert {(r["tag_id"], r["uri"]) for r in jobs.current_observations(spark, folder).collect()} == {(1, "a"), (1, "b"), (2, "b")}
    jobs.retain(spark, folder, DAY, 1)
    assert folders(folder, "tag") == ["batch=1"]
    run(2, post("c", DAY, names=("new",)))
    assert {r["uri"] for r in jobs.current_observations(spark, folder).filter("tag_id = 2").collect()} == {"b", "c"}


def test_bad_lines_and_pages_are_set_aside(spark, folder, tags, registry):
    good = '[{"uri": "https://a.example/p/1", "created_at": "2026-08-27T00:00:00Z", "visibility": "public", "account": {"acct": "x"}, "tags": [{"name": "cats"}]}]'
    page = lambda k, body: json.dumps({"server": "h0", "batch_at": 1787788800, "page_id": k, "link_header": None, "body": body})
    lines = [page("ok", good), page("ok", good)[:60], "no json", page("busy", '{"error": 1}'), page("cut", good[:-5]), page("none", None), "[1, 2]",
             json.dumps({"server": "h0", "batch_at": "soon", "page_id": "late", "body": good})]
    with open(f"{folder}/pages.json", "w") as f:
        f.write("\n".join(lines))
    for records in (raw.capture_records(spark, f"{folder}/pages.json"),):
        got = sorted((r["reason"], r["page_id"] or "") for r in raw.quarantined(records).collect())
        assert [g for g, _ in got] == ["no_list", "no_list", "no_record", "no_record", "no_record", "no_record", "unreadable_list"]
        assert {p for g, p in got if g != "no_record"} == {"busy", "none", "cut"}
        assert raw.parse_statuses(raw.sound_pages(records)).count() == 1
    stream = raw.stream_records(spark, f"{folder}/*.json")
    jobs.start_collection(stream, f"{folder}/tables", f"{folder}/state", tags, registry, "salt").awaitTermination()
    aside = jobs.read_changes(spark, f"{folder}/tables", "quarantine")
    assert aside.count() == 7 and aside.filter("reason = 'no_record'").filter("record = 'no json'").count() == 1
    assert jobs.current_observations(spark, f"{folder}/tables").count() == 1


def test_bad_counters_are_set_aside(spark, folder):
    day = {"day": "86400", "uses": "3", "accounts": "2"}
    lines = [json.dumps({"server": "h", "name": "cats", "history": [day]}), json.dumps({"server": "h", "name": "dogs", "history": [day, {**day, "uses": "x"}]}),
             json.dumps({"server": "h", "history": [day]}), json.dumps({"server": "h", "name": "birds"}), "{"]
    with open(f"{folder}/counters.json", "w") as f:
        f.write("\n".join(lines))
    aside = raw.quarantined_counters(raw.counter_records(spark, f"{folder}/counters.json"))
    assert sorted((r["reason"], r["name"]) for r in aside.collect()) == [
        ("no_history", "birds"), ("no_name", None), ("no_record", None), ("unreadable_day", "dogs")]
    assert raw.read_tag_counters(spark, f"{folder}/counters.json").filter("tag IS NOT NULL").count() == 2


def test_health_keeps_the_poll_log(spark, folder):
    start = spark.createDataFrame([("h0", None, None, "timeline", 0, False, None, None, None, 0, None, 0)], changes.schemas.REGISTRY)
    polls = spark.createDataFrame([("h0", 10 + k, k, 200, True, None, None, 1, 0, 1.5, 9) for k in range(3)],
                                  "host string, at long, seq long, status int, ok boolean, remaining int, reset long, tags int, "
                                  "new_observations long, latency_ms double, ratelimit_remaining int")
    for _ in range(2):
        jobs.fold_health_batch(polls, 0, folder, start)
        assert jobs.current_poll_log(spark, folder).agg(F.count("*"), F.max("at")).first() == (3, 12)
