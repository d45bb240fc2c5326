"""Names cleaned once each, however often they are met."""

from workload.catalog import load


def test_each_name_is_cleaned_once(spark, folder):
    texts = ["Cats cats, dogs! café", "cats #dogs ab_1", "bird cats 日本", None, ""]
    spark.createDataFrame([(k % 4, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    found = load()["clean_tag_input"][0](spark, folder)
    names = ["cats", "dogs", "café", "ab_1", "bird", "日本"]
    want = [(n, n if len(n) <= 100 and len(n) % 4 < 3 else None) for n in [*names, *(n * 40 for n in names)]]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("\n+- ") :]
    assert plan.startswith("Aggregate") and "UrlCodec" in plan and "UrlCodec" not in below  # the DISTINCT comes first
    assert below.count("Relation") == 1  # and the texts are read once
