"""The registered queries: against their SQL, and the pipeline against its stages."""

import os

import duckdb
import pytest

import corpus_pipeline
from tagtide.llm.queries import load
from workload.verify import compare, duck

SF = "/root/testdata/sf0.001"
FOUND = load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in FOUND) == list(range(1, 14))


@pytest.mark.parametrize("name", [name for name, (_, sql) in FOUND.items() if sql])
def test_equals_sql(spark, name):
    run, sql = FOUND[name]
    assert compare(duck(SF), run(spark, SF), sql) == ""


def test_licences_equal_sql_where_there_are_some(spark, folder):
    """The licence query's SQL over a table that holds every known wording, as it is and in other layouts."""
    from tagtide.llm.licences import KNOWN, whole_texts

    texts = [text for _, text in [*KNOWN.items(), *whole_texts()]]
    texts += [t.upper().replace(".", " . ") for t in texts] + ["Copyright (c) 2020 Somebody\n" + t.replace("\n", "\r\n") for t in texts]
    texts += [t + " more" for t in texts[:5]] + [None, "", "Copyright 1999 X"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    run, sql = FOUND["op4_licence_digests"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert compare(con, run(spark, folder), sql) == ""
    names = [r["licence"] for r in run(spark, folder).orderBy("doc_id").collect()]
    assert None not in names[: 3 * (len(KNOWN) + len(whole_texts()))] and names[-3:] == [None] * 3


def test_native_operators_run_no_python(spark):
    for name in ("op8_winnowed_lines", "op10_host_rules"):
        plan = FOUND[name][0](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark):
    from tests.llm.test_lines_rules_licences import brute_lines, brute_repeats
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}

    def passes(text):
        words = (text or "").encode().split()
        return len(words) >= 20 and 100 * brute_repeats(words) <= 30 * len(words)

    rows = {d: t for d, t in sorted(rows.items()) if passes(t)}
    rows = {d: t for d, t in zip(rows, brute_lines(list(rows.items()), 50), strict=True) if t.split()}
    words = {d: t.lower().split() for d, t in rows.items()}
    shingles = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, w in words.items()}
    parent = {d: d for d in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    rows = {d: t for d, t in rows.items() if find(d) == d}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {d: t for d, t in rows.items() if not any(x in t for x in items)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(rows)
    from tokenizers import Tokenizer

    from tagtide.llm.queries import vocabulary

    sizes = {d: len(Tokenizer.from_file(vocabulary()).encode(t, add_special_tokens=False).ids) + 1 for d, t in list(rows.items())[:20]}
    for d, n in sizes.items():
        assert sum(r["length"] for r in got if r["doc_id"] == d) == n
