"""Recall against brute force where operators search by candidates."""

import numpy as np
import pyarrow as pa
import pytest

from tagtide.llm import decontaminate as D
from tagtide.llm import licences
from tagtide.llm import simhash as S


def planted(rng, texts, n, keep):
    """Documents of foreign words and of common ones, each with one item in it; and its number."""
    docs = []
    for k in range(n):
        own = texts[k % len(texts)].split()
        if k % 2:
            kept = rng.random(len(own)) < keep
            kept[-D.ANSWER :] = True
            own = [w if y else f"new{rng.integers(10**6)}" for w, y in zip(own, kept, strict=True)]
        foreign = [f"foreign{x}" if x % 3 else f"w{int(x) % 40}" for x in rng.integers(0, 10**6, 90)]
        docs.append((" ".join(foreign[:45] + own + foreign[45:]), k % len(texts)))
    return docs


@pytest.mark.parametrize(("low", "high", "keep"), [(8, 60, 0.65), (60, 150, 0.6), (150, 600, 0.6)])
def test_whole_and_reworded_items_in_foreign_text_are_found(spark, low, high, keep):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(3000)]
    share = 1 / np.arange(1, 3001)
    draw = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    texts = [draw(int(rng.integers(low, high))) for _ in range(40)]
    docs = planted(rng, texts, 400 if high < 100 else 120, keep)
    clean = [draw(300) for _ in range(300)]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate([*(t for t, _ in docs), *clean])], "doc_id long, text string").repartition(3)
    items = D.Items([(k, t.encode(), None) for k, t in enumerate(texts)], D.word_frequencies(frame))
    keys = [D.plain_words(t.encode()).keys for t, _ in docs]
    leaks = {(r, i) for r, (_, i) in enumerate(docs) if D.aligned(keys[r], items.words[i], items.answers[i])[1]}
    assert len(leaks) > 0.8 * len(docs)
    found = {(r["doc_id"], r["item_id"]) for r in D.leaks(frame, spark.createDataFrame(
        [(k, t) for k, t in enumerate(texts)], "item_id long, text string")).collect()}
    assert len(leaks & found) >= 0.98 * len(leaks)


def test_the_learned_directions_decide(spark, monkeypatch):
    """With as few directions as items have, learned ones find the leaks, random ones of the same number lose some."""
    monkeypatch.setattr(D, "DIMENSIONS", 40)
    rng = np.random.default_rng(10)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 600, n)]
    texts = [" ".join(some(int(rng.integers(12, 18)))) for _ in range(40)]
    docs = []
    for k in range(400):  # items with a third of their words replaced, among words of which half are other items'
        own = texts[k % 40].split()
        own = [w if y else f"new{rng.integers(10**6)}" for w, y in zip(own, [*(rng.random(len(own) - D.ANSWER) < 0.6), *[True] * D.ANSWER], strict=True)]
        around = [w if rng.random() < 0.5 else f"foreign{rng.integers(10**6)}" for w in some(80)]
        docs.append((" ".join(around[:40] + own + around[40:]), k % 40))
    frame = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(docs)], "doc_id long, text string")
    items = D.Items([(k, t.encode(), None) for k, t in enumerate(texts)], D.word_frequencies(frame))
    column = pa.array([t.encode() for t, _ in docs], pa.binary())
    leaks = {(r, i) for r, (t, i) in enumerate(docs) if D.aligned(D.plain_words(t.encode()).keys, items.words[i], items.answers[i])[1]}

    def share(directions):
        return len(leaks & {(r, i) for r, i, *_ in D.Search(items, directions).matches(column)}) / len(leaks)

    random = np.linalg.qr(rng.standard_normal((D.FEATURES, 40)))[0].astype(np.float32)
    learned = share(D.latent_directions(frame, items))
    assert learned > 0.98 and share(random) < learned - 0.02


def test_near_copies_are_those_of_brute_force_jaccard(make_docs):
    rng = np.random.default_rng(9)
    texts = []
    for base in range(40):
        words = [f"b{base}x{k}" for k in range(int(rng.integers(60, 300)))]
        for copy in range(6):
            own = list(words)
            for k in rng.choice(len(own), int(len(own) * copy * 0.008), replace=False):
                own[k] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(own))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    label, far = list(range(len(texts))), 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                far += (S.fingerprint(texts[a].encode().split(), 5) ^ S.fingerprint(texts[b].encode().split(), 5)).bit_count() > S.RADIUS
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert far > 50  # pairs beyond the radius of one fingerprint
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(make_docs(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == label


def families(rng, bases, copies, rates):
    """Texts of few words in families of copies at several distances, with a passage in common."""
    texts = []
    for base in range(bases):
        words = [f"b{base}x{k}" for k in range(int(rng.integers(20, 90)))] + [f"passage{k}" for k in range(12)]
        for _ in range(copies):
            own = list(words)
            for k in np.flatnonzero(rng.random(len(own)) < rng.choice(rates)):
                own[k] = f"new{rng.integers(10**6)}"
            texts.append(" ".join(own[: len(own) - int(rng.integers(0, 6))]))
    return texts


def jaccard_links(texts):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    return {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_that_no_band_and_no_fingerprint_brings_together_are_linked(make_docs, seed):
    texts = families(np.random.default_rng(seed), 30, 14, [0.0, 0.02, 0.04])
    label = list(range(len(texts)))
    for a, b in sorted(jaccard_links(texts)):
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in S.near_copies(make_docs(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == label


@pytest.mark.parametrize(("together", "sample"), [(2048, 1 << 14), (3, 1 << 14), (3, 8)])
def test_prefixes_leave_out_no_link(make_docs, monkeypatch, together, sample):
    monkeypatch.setattr(S, "TOGETHER", together)
    monkeypatch.setattr(S, "SAMPLE", sample)
    texts = families(np.random.default_rng(3), 12, 10, [0.0, 0.02, 0.04]) + [None, "", "one word", "a b c d e", "a b c d e f"]
    rows = S.banded(make_docs(texts), 5).selectExpr("doc_id AS least", "n", "doc_id AS root", "prefix")
    got = {(r["a"], r["b"]) for r in S.unlinked(rows).collect()}
    want = jaccard_links([t or "" for t in texts[:120]])
    assert len(want) > 100 and want <= got
    assert S.unlinked(rows.withColumn("root", rows["root"] * 0)).isEmpty()  # of one class


def test_copies_with_too_many_edits_do_not_meet(make_docs):
    """Copies of one text, each with 15 % of its shingles its own: a similarity of 0.74, and a prefix that reaches what they share."""
    copies = [" ".join(f"new{copy}x{k}" if k % 33 == 16 else f"b{k}" for k in range(300)) for copy in range(40)]
    texts = copies + families(np.random.default_rng(3), 4, 8, [0.0, 0.02, 0.04])
    rows = S.banded(make_docs(texts), 5).selectExpr("doc_id AS least", "n", "doc_id AS root", "prefix")
    found = [set(r["prefix"]) for r in rows.where("least < 2").collect()]
    assert found[0] & found[1]
    met = {(r["least_a"], r["least_b"]) for r in S.meetings(rows).collect()}
    assert met and not [(a, b) for a, b in met if a < 40]  # 780 pairs
    assert jaccard_links(texts) <= {(r["a"], r["b"]) for r in S.unlinked(rows).collect()}


def test_shingles_of_some_texts_are_common_in_any_number_of_texts(make_docs, monkeypatch):
    """A passage in 60 of 960 texts: with a sample of 16 texts hardly one holds it, with a share of all many do."""
    monkeypatch.setattr(S, "SAMPLE", 16)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [" ".join([*(f"t{k}x{j}" for j in range(20)), *([passage] if k < 60 else [])]) for k in range(960)]
    known, n = S.common_shingles(make_docs(texts), 5)
    assert set(S.shingle_set(passage.encode().split(), 5).tolist()) <= set(known.tolist()) and n.min() > 1
    monkeypatch.setattr(S, "COMMON", 26 + 8)
    assert len(S.common_shingles(make_docs(texts + ["a b c d e f g h i j k l m n"] * 9), 5)[0]) <= 34


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 10, 25, 99, 100, 1001])
def test_a_prefix_is_as_long_as_it_must_be(n):
    least = next(k for k in range(n + 1) if 10 * k >= 8 * n)
    common = np.array([2, 4], np.uint64), np.array([9, 5])
    got = S.prefix(np.arange(1, n + 1, dtype=np.uint64), common)
    assert S.least_shared(n, S.ALIKE) == least and len(got) == n - least + 1
    assert got.tolist() == [*(k for k in range(1, n + 1) if k not in (2, 4)), *(k for k in (4, 2) if k <= n)][: len(got)]


def test_whole_licence_texts_are_known(spark, make_docs):
    names = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Artistic-1.0-Perl"]
    texts = [(licences.TEXTS / f"{name}.txt").read_text() for name in names]
    docs = make_docs([*texts, *(t.upper() for t in texts), texts[0] + " more"])
    got = {r["_doc"]["doc_id"]: r["licence"] for r in licences.scanned(docs, licences.known_licences(spark)).collect()}
    assert [got[k] for k in range(len(got))] == [*names, *names, None]


def test_shingles_of_all_texts_are_counted(spark):
    n = 1 << 15  # from here on only every other text was counted
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('a b c d e', id % 4096, ' f', id) AS text")
    known, counts = S.common_shingles(docs, 5)
    want = sorted(int(S.shingle_set(f"a b c d e{k}".encode().split(), 5)[0]) for k in range(4096))
    assert known.tolist() == want and set(counts.tolist()) == {n // 4096}
