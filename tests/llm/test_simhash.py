import numpy as np
import pytest

from tagtide.llm import simhash as S
from tagtide.llm.components import components


def naive(text, size):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    ones = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute(prints):
    """Smallest position that each reaches by links of 3 bits or fewer."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.arange(len(prints))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(prints))])
        if (new == label).all():
            return label
        label = new


@pytest.fixture(scope="module")
def prints():
    rng = np.random.default_rng(3)
    out = set()
    for base in rng.integers(0, 1 << 63, 30, dtype=np.uint64):
        for _ in range(50):
            x = int(base)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(b)
            out.add(x)
    return np.array(sorted(out), np.uint64)


def same_classes(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_index_finds_all_links(prints):
    sizes = np.array([1, 2, 0, len(prints) - 10, 7])
    index = S.GrayIndex(prints, sizes)
    queries, members = index.pairs(np.arange(len(prints)))
    got = set(zip(queries.tolist(), members.tolist(), strict=True))
    near = np.bitwise_count(index.prints[:, None] ^ index.prints[None, :]) <= 3
    want = {(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b and index.group[a] == index.group[b]}
    assert got == want


@pytest.mark.parametrize("limit", [4096, 40])
def test_groups_lose_no_link(spark, prints, limit):
    frame = spark.createDataFrame([(S._signed(int(x)),) for x in prints], "fp long")
    groups = S.grouped(frame, limit)
    links = components(S.links(groups)).collect()
    parent = {int(x): int(x) for x in prints}
    for r in links:
        parent[r["a"] % (1 << 64)] = r["b"] % (1 << 64)
    assert same_classes([parent[int(x)] for x in prints], brute(prints).tolist())


def test_documents_and_classes(make_docs, odd_texts):
    ids = [5, 3, None, 11, 2, 7, 6, 1, 9, 8, 0, 4]
    got = {r["doc_id"]: r for r in S.near_duplicates(make_docs(odd_texts, ids)).collect()}
    prints = {i: naive(t, 3) for i, t in zip(ids, odd_texts, strict=True)}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    assert {got[i]["component_id"] for i in (5, 3, None)} == {3}  # no words: zero, linked like any other
    assert got[11]["component_id"] == got[2]["component_id"] == 2 and got[9]["component_id"] == 8
    assert S.near_duplicates(make_docs([])).count() == 0


def test_one_of_each_class_stays(make_docs):
    text = " ".join(f"word{k}" for k in range(300))
    docs = make_docs([text, text, "other words here now", text, None, ""], [7, 7, 3, None, 5, None])
    got = S.representatives(docs)
    assert got.columns == docs.columns
    assert sorted(got.select("doc_id", "row", "n_words").collect()) == [(3, "r", 3), (5, "r", 3), (7, "r", 3)]


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (1, 2), (2, 1)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["a"]: r["b"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent) if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
