import json
import os
import shutil

from pyspark.sql import functions as F

from tagtide.functions.text import author_hash
from tagtide.operators import ingest, merges, windows
from tagtide.sources import raw, tables
from tagtide.streaming import jobs

SALT = "test-salt"


def status(**over):
    base = dict(id="1", uri="https://a.example/p/1", url="https://a.example/@x/1", created_at="2026-08-27T00:00:00.000Z",
                visibility="public", language="en", sensitive=False, reblog=None, account={"acct": "ann"}, tags=[{"name": "Cats"}])
    return {**base, **over}


def pages(spark, *bodies):
    rows = [("s.example", 1787788800, f"p{i}", None, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "server STRING, batch_at BIGINT, page_id STRING, link_header STRING, body STRING")


def reasons(spark, statuses, suppressed=None):
    rows = ingest.normalise(raw.parse_statuses(pages(spark, statuses)), SALT, suppressed)
    return [r["skip_reason"] for r in rows.orderBy("pos").collect()]


def test_each_bad_status_gets_one_reason(spark):
    inner = status()
    got = reasons(spark, [
        status(), status(visibility="unlisted"), status(visibility="private"), status(visibility="direct"),
        status(reblog=inner), status(reblog=inner, visibility="private"), status(reblog=status(visibility="private")),
        status(uri="nonsense"), status(created_at="not a date"), status(account={"acct": ""}), None, status(uri=None),
        status(account=None), status(uri="nonsense", visibility="private"), status(created_at=None, visibility="private"),
    ])
    assert got == [None, "non_public", "non_public", "non_public", None, "non_public", "non_public", "malformed", "malformed",
                   "malformed", "malformed", "malformed", "malformed", "non_public", "malformed"]


def test_suppressed_author_is_marked_last(spark):
    gone = spark.range(1).select(author_hash(F.lit("ANN"), SALT).alias("author_hash"))
    got = reasons(spark, [status(), status(account={"acct": "bob"}), status(visibility="private")], gone)
    assert got == ["suppressed", None, "non_public"]


def test_stored_fields_only(spark):
    post = status(tags=[{"name": n} for n in ("Cats", "cats", "CATS", "Dogs", "")] + [{}], url=None, language=None, sensitive=None)
    row = ingest.normalise(raw.parse_statuses(pages(spark, [post, status(tags=None)])), SALT).orderBy("pos").collect()
    assert row[0]["tags"] == ["cats", "dogs"] and row[1]["tags"] == []
    assert (row[0]["url"], row[0]["language"], row[0]["sensitive"], row[0]["created_at"]) == (None, None, False, 1787788800)
    assert len(row[0]["author_hash"]) == 16 and "ann" not in str(row[0].asDict())


def test_boost_counts_for_the_inner_post(spark):
    boost = status(uri="https://b.example/boost", account={"acct": "booster"}, reblog=status(uri="https://c.example/p/9"))
    row = ingest.normalise(raw.parse_statuses(pages(spark, [boost])), SALT).first()
    assert row["is_boost"] and row["origin_host"] == "c.example"


def test_page_that_is_no_array_is_rejected(spark):
    both = pages(spark, {"error": "busy"}, [status()], "not json", "[]")
    assert raw.parse_statuses(both).count() == 1
    assert {r["page_id"] for r in raw.rejected_pages(both).collect()} == {"p0", "p2"}


SIGHTING = ("tag_id BIGINT, uri STRING, url STRING, origin_host STRING, author_hash BINARY, created_at BIGINT, observed_at BIGINT, "
            "is_boost BOOLEAN, sensitive BOOLEAN, language STRING, host STRING, seq BIGINT, mask BIGINT")


def sighting(tag=1, uri="u1", author=b"a" * 16, created=86_400, observed=86_410, host="h1", seq=1, mask=1, boost=False, url="first"):
    return (tag, uri, url, "o.example", author, created, observed, boost, False, "en", host, seq, mask)


def observed(spark, *rows):
    return ingest.merge_sightings(spark.createDataFrame(list(rows), SIGHTING))


def test_merge_keeps_first_view_and_all_servers(spark):
    rows = [sighting(observed=86_500, host="h2", mask=2, url="later"), sighting(), sighting(host="h3", observed=86_600, mask=4, url="last")]
    for order in (rows, rows[::-1]):
        (row,) = observed(spark, *order).collect()
        assert (row["seen_mask"], row["url"], row["observed_at"]) == (7, "first", 86_410)


def test_upsert_widens_the_mask_only_and_repeats_safely(spark):
    stored = observed(spark, sighting())
    batch = observed(spark, sighting(observed=90_000, mask=8, url="new"), sighting(uri="u2", mask=8))
    once = merges.upsert_observations(stored, batch)
    twice = merges.upsert_observations(once, batch)
    want = {("u1", 9, "first"), ("u2", 8, "first")}
    for result in (once, twice):
        assert {(r["uri"], r["seen_mask"], r["url"]) for r in result.collect()} == want


def test_stored_table_rewrites_touched_days_only(spark, folder):
    path = f"{folder}/observation"
    day = 86_400
    tables.write_observations(observed(spark, sighting(), sighting(uri="old", created=5 * day), sighting(tag=2, uri="u9", created=3 * day)), path)
    untouched = set(os.listdir(f"{path}/created_date=1970-01-06"))
    batch = observed(spark, sighting(mask=2), sighting(uri="new", mask=4))
    for _ in range(2):
        tables.merge_observations_into(spark, batch, path)
        rows = {(r["uri"], r["seen_mask"]) for r in tables.read_observations(spark, path).collect()}
        assert rows == {("u1", 3), ("new", 4), ("old", 1), ("u9", 1)}
    assert untouched == set(os.listdir(f"{path}/created_date=1970-01-06"))
    pruned = windows.between(tables.read_observations(spark, path), day, 2 * day)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(created_date" in pruned


def test_a_view_with_another_time_joins_its_post(spark, folder):
    path, day = f"{folder}/observation", 86_400
    tables.merge_observations_into(spark, observed(spark, sighting(created=10 * day), sighting(uri="far", created=30 * day)), path)
    untouched = {d: set(os.listdir(d)) for d in (f"{path}/created_date=1970-01-31",)}
    later = observed(spark, sighting(created=13 * day, observed=13 * day, mask=2), sighting(uri="u3", created=13 * day, mask=4))
    for _ in range(2):
        tables.merge_observations_into(spark, later, path)
        rows = {(r["uri"], r["created_at"] // day, r["seen_mask"]) for r in tables.read_observations(spark, path).collect()}
        assert rows == {("u1", 10, 3), ("far", 30, 1), ("u3", 13, 4)}
    assert untouched == {d: set(os.listdir(d)) for d in untouched}
    known = tables.known_days(spark, later, path)
    assert {(r["uri"], str(r["created_date"])) for r in known.collect()} == {("u1", "1970-01-11"), ("u3", "1970-01-14")}
    plan = known._jdf.queryExecution().toString()
    assert "PushedFilters: [In(bucket" in plan
    tables.remove_from_store(spark, path, spark.createDataFrame([(b"a" * 16,)], "author_hash binary"), "author_hash")
    assert [n for n in os.listdir(f"{path}-index") if n.startswith("created_date")] == []
    tables.merge_observations_into(spark, later, path)
    assert {r["created_at"] // day for r in tables.read_observations(spark, path).collect()} == {13}


def test_a_store_without_an_index_gets_one(spark, folder):
    path, day = f"{folder}/observation", 86_400
    tables.write_observations(observed(spark, sighting(created=10 * day)), path)
    shutil.rmtree(f"{path}-index")
    tables.merge_observations_into(spark, observed(spark, sighting(created=12 * day, observed=12 * day, mask=2)), path)
    (row,) = tables.read_observations(spark, path).collect()
    assert (row["created_at"], row["seen_mask"]) == (10 * day, 3)
    tables.merge_observations_into(spark, observed(spark, sighting()).limit(0), path)
    assert tables.read_observations(spark, path).count() == 1


def test_candidate_gains_one_sighting_per_batch(spark):
    schema = "name STRING, author_hash BINARY, origin_host STRING, tags_on_post INT, observed_at BIGINT, host STRING, seq BIGINT"
    rows = [("cats", b"a" * 16, "o1", 2, 10, "h", 1), ("cats", b"a" * 16, "o2", 9, 20, "h", 2), ("cats", b"b" * 16, "o1", 1, 5, "h", 3)]
    batch = merges.candidate_batch(spark.createDataFrame(rows, schema), 100)
    first = {r["author_hash"][:1]: (r["origin_host"], r["tags_on_post"], r["occurrences"]) for r in batch.collect()}
    assert first == {b"a": ("o2", 9, 2), b"b": ("o1", 1, 1)}
    stored = merges.upsert_candidates(batch.withColumn("posts_seen", F.lit(1).cast("bigint")), batch)
    assert {(r["author_hash"][:1], r["posts_seen"], r["origin_host"]) for r in stored.collect()} == {(b"a", 2, "o2"), (b"b", 2, "o1")}


def test_cursor_is_never_erased(spark):
    stored = spark.createDataFrame([("h", 1, "50", 10, True, 10)], "host STRING, tag_id BIGINT, min_id STRING, polled_at BIGINT, behind BOOLEAN, updated_at BIGINT")
    patches = spark.createDataFrame([("h", 1, None, 20, False, 1), ("h", 2, None, 20, True, 2)],
                                    "host STRING, tag_id BIGINT, min_id STRING, polled_at BIGINT, behind BOOLEAN, seq BIGINT")
    rows = {r["tag_id"]: (r["min_id"], r["polled_at"], r["behind"]) for r in merges.upsert_cursors(stored, patches).collect()}
    assert rows == {1: ("50", 20, False), 2: (None, 20, True)}


TAGS = "id BIGINT, name STRING, tracked BOOLEAN, blocked BOOLEAN"


def test_collection_stream_in_several_batches_and_replayed(spark, folder):
    """Three files, one per batch; then batch 1 runs again and changes nothing."""
    tags = spark.createDataFrame([(1, "cats", True, False)], TAGS)
    registry = spark.createDataFrame([("s0", 0), ("s1", 1), ("s2", 2)], "host STRING, bit INT")
    for i in range(3):
        posts = [status(id=str(j), uri=f"https://a.example/p/{j}", tags=[{"name": "Cats"}, {"name": f"new{i}"}]) for j in range(i, i + 3)]
        line = {"server": f"s{i}", "batch_at": 1787788800 + 60 * i, "page_id": f"p{i}", "link_header": None, "body": json.dumps(posts)}
        with open(f"{folder}/page{i}.json", "w") as f:
            f.write(json.dumps(line))
    stream = raw.stream_pages(spark, f"{folder}/*.json", files_per_batch=1)
    root = f"{folder}/out/tables"
    jobs.start_collection(stream, root, f"{folder}/out/state", tags, registry, SALT).awaitTermination()

    def state():
        posts = {(r["uri"][-1], r["seen_mask"]) for r in jobs.current_observations(spark, root).collect()}
        pool = {(r["name"], r["posts_seen"]) for r in jobs.current_candidates(spark, root).collect()}
        minutes = {(r["tag_id"], r["minute"], r["posts"]) for r in jobs.refresh_rollups(spark, root, 3).collect()}
        return posts, pool, minutes

    posts, pool, minutes = before = state()
    assert posts == {("0", 1), ("1", 3), ("2", 7), ("3", 6), ("4", 4)}
    assert pool == {("new0", 1), ("new1", 1), ("new2", 1)} and minutes == {(1, 1787788800 // 60, 5)}
    again = raw.read_pages(spark, f"{folder}/page1.json")
    batch_of_page1 = next(i for i in range(3) if spark.read.parquet(f"{root}/tag_candidate/batch={i}").filter("name = 'new1'").count())
    jobs.collect_batch(again, batch_of_page1, root, tags, registry, SALT)
    assert state() == before
    jobs.compact(spark, root, "observation", jobs.current_observations, f"{folder}/compacted")
    folded = {(r["uri"][-1], r["seen_mask"]) for r in jobs.current_observations(spark, f"{folder}/compacted").collect()}
    assert folded == posts


def test_expiry_drops_days_and_rewrites_the_edge(spark, folder):
    path, day = f"{folder}/observation", 86_400
    rows = [sighting(uri=f"u{k}", created=k * day + 500) for k in range(5)] + [sighting(uri="early", created=2 * day + 10, author=b"b" * 16)]
    tables.write_observations(observed(spark, *rows), path)
    kept = set(os.listdir(f"{path}/created_date=1970-01-04"))
    tables.expire_observations(spark, path, 2 * day + 400 + 3600, hours=1)
    assert {r["uri"] for r in tables.read_observations(spark, path).collect()} == {"u2", "u3", "u4"}
    assert kept == set(os.listdir(f"{path}/created_date=1970-01-04")) and not os.path.exists(f"{path}/created_date=1970-01-01")
    tables.remove_from_store(spark, path, spark.createDataFrame([("u.example",)], "origin_host string"), "origin_host")
    tables.remove_from_store(spark, path, spark.createDataFrame([(b"a" * 16,)], "author_hash binary"), "author_hash")
    assert [n for n in os.listdir(path) if n.startswith("created_date")] == []


def test_compaction_keeps_counts_order_and_days(spark, folder):
    pool = "name string, author_hash binary, first_seen long, origin_host string, tags_on_post int, posts_seen long"
    for batch, first in ((3, 10), (4, 20), (5, 30)):
        jobs.write_change(spark.createDataFrame([("n", b"a", first, f"o{batch}", 1, 1)], pool), folder, "tag_candidate", batch)
        jobs.write_change(observed(spark, sighting(mask=1 << batch, observed=86_400 + first)), folder, "observation", batch)
    into = folder + "/compact"
    jobs.compact(spark, folder, "tag_candidate", jobs.current_candidates, into)
    jobs.compact(spark, folder, "observation", jobs.current_observations, into)
    jobs.write_change(spark.createDataFrame([("n", b"a", 40, "o6", 1, 1)], pool), into, "tag_candidate", 6)
    row = jobs.current_candidates(spark, into).first()
    assert (row["posts_seen"], row["first_seen"], row["origin_host"]) == (4, 10, "o3")
    assert os.path.exists(f"{into}/observation/batch=5/created_date=1970-01-02")
    assert jobs.current_observations(spark, into, since=86_400).first()["seen_mask"] == 8 + 16 + 32
    assert jobs.current_observations(spark, into, since=10 * 86_400).count() == 0


def test_every_candidate_is_written_unless_the_caller_sets_an_allowance(spark, folder):
    schema = "host string, uri string, url string, origin_host string, author_hash binary, created_at long, observed_at long, " \
             "is_boost boolean, sensitive boolean, language string, tags array<string>, skip_reason string, seq long"
    posts = spark.createDataFrame([("h", f"u{k}", None, "o", bytes([k]), 10, 20, False, False, None, [f"n{k}"], None, k) for k in range(100)], schema)
    tags = spark.createDataFrame([], "id long, name string, tracked boolean, blocked boolean")
    registry = spark.createDataFrame([("h", 1)], "host string, bit int")
    jobs.collect_batch(posts, 0, folder + "/all", tags, registry, SALT)
    jobs.collect_batch(posts, 0, folder + "/some", tags, registry, SALT, candidate_limit=7)
    assert jobs.current_candidates(spark, folder + "/all").count() == 100
    assert jobs.current_candidates(spark, folder + "/some").count() == 7
