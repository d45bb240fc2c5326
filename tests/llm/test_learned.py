import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagtide.llm import decontaminate, language, lm, neighbours

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary_of_words():
    rng = np.random.default_rng(0)
    return lm.Vocabulary(rng.integers(1, 1 << 62, 2000, dtype=np.uint64), rng.integers(1, 50, 2000), 5, np.full(lm.TAILS, 5000.0))


def test_gradients(vocabulary_of_words):
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in vocabulary_of_words.start().items()}
    tokens, h = rng.integers(0, lm.END + 1, (6, 5)), rng.standard_normal((5, lm.HIDDEN)) * 0.1
    g = lm.window_gradient(w, tokens, h)[0]
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        losses = []
        for step in (1e-3, -2e-3):
            w[k][at] += step
            losses.append(lm.window_gradient(w, tokens, h)[2])
        w[k][at] += 1e-3
        assert g[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=2e-3)


def test_probabilities_add_up_and_state_is_carried(vocabulary_of_words):
    w = vocabulary_of_words.start()
    h = np.random.default_rng(2).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lm.END + 1)
    assert np.exp(lm.log_probabilities(w, np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(0, lm.END, n), lm.END) for n in (0, 1, 700, 3, 90, 31, 32, 33)] * 3
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = lm.score_pool(w, np.concatenate(docs), bounds)
    for doc, score in zip(docs, got, strict=True):
        h, total = np.zeros((1, lm.HIDDEN), np.float32), 0.0
        for token in doc:
            total += lm.log_probabilities(w, h, np.array([token]))[0]
            h = lm._gates(w, np.array([token]), h)[0]
        assert score == pytest.approx(total, rel=1e-4)


def brute_base(rows):
    counts, tokens = Counter(), {}
    for doc, text in rows:
        tokens[doc] = (text or "").encode().lower().split() + [None]
        if doc is None or zlib.crc32(str(doc).encode()) % 5 != 1:
            counts.update(tokens[doc])
    n, v = sum(counts.values()), len(counts)
    return n, {d: (len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for d, t in tokens.items()}


@pytest.mark.parametrize("common", [lm.COMMON, 40])
def test_scores(spark, make_docs, odd_texts, common, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", common)  # with 40, most words are joined
    ids = [None, *range(1, len(odd_texts))]
    docs = make_docs(odd_texts, ids)
    n, want = brute_base(list(zip(ids, odd_texts, strict=True)))
    rows = lm.scored(docs).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        size, known, base = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (size, known, n)
        assert r["base_score"] == pytest.approx(base) and -1e9 < r["score"] < 0
    assert lm.scored(make_docs([])).count() == 0


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="driver tables are not here")
def test_model_beats_shares_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = lm.scored(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="driver tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = language.predicted(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    got = neighbours.classified(docs, neighbours.fitted(docs, labels)).where("held_out").join(labels, "doc_id")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def test_language_cases(spark, make_docs, odd_texts):
    rows = [(k, "the and of with that this is on " * 3, "en", k) for k in range(40)] + [(50 + k, "der die und das ist nicht ein " * 3, "de", k) for k in range(40)]
    docs = spark.createDataFrame(rows + [(200, None, "en", 1), (201, "1 2 !", "en", 1), (202, "thand", None, 1), (203, "dieund", None, 1), (204, "", None, 1)],
                                 "doc_id long, text string, lang string, score long")
    got = {r["doc_id"]: r for r in language.predicted(docs).collect()}
    assert {got[k]["lang_pred"] for k in range(40)} == {"en"} and {got[k]["lang_pred"] for k in range(50, 90)} == {"de"}
    assert [got[k]["lang_pred"] for k in (200, 201, 204)] == ["und"] * 3 and got[200]["score"] == 0
    assert (got[202]["lang_pred"], got[203]["lang_pred"]) == ("en", "de")  # unseen words, by their n-grams
    assert language.predicted(make_docs(odd_texts)).count() == len(odd_texts)
    assert language.predicted(make_docs([])).count() == 0
    alone = language.predicted(make_docs(["a b"]).withColumn("lang", F.lit(None).cast("string"))).first()
    assert alone["lang_pred"] == "und"


def brute_language(rows):
    """(lang, share) by row from Python counts of (doc_id, text, lang) rows."""
    split = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    words, ngrams = {}, {}
    for doc, text, lang in rows:
        if lang is not None and (doc is None or zlib.crc32(str(doc).encode()) % 4 != 2):
            words.setdefault(lang, Counter()).update(split(text))
    places = lambda w: [[f" {w} "[k : k + n] for n in range(1, 5) if k + n <= len(w) + 2] for k in range(len(w) + 2)]
    for lang, own in words.items():
        ngrams[lang] = Counter(g for w in own for at in places(w) for g in at)
    langs = sorted(x for x in words if words[x])
    every, all_grams = set().union(*words.values()), set().union(*ngrams.values())
    log = lambda counts, key, size: math.log((counts[key] + 0.5) / (sum(counts.values()) + 0.5 * size))

    def score(word, lang):
        if word in every:
            return log(words[lang], word, len(every))
        known = [next((g for g in reversed(at) if g in all_grams), None) for at in places(word)]
        known = [log(ngrams[lang], g, len(all_grams)) for g in known if g is not None]
        return sum(known) / max(1, len(known))

    out = []
    for _, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        sums = [sum(score(w, x) for w in split(text)) for x in langs]
        out.append((langs[sums.index(max(sums))], 1 / sum(math.exp(x - max(sums)) for x in sums)))
    return out


@pytest.mark.parametrize(("common", "most", "parts"), [(1 << 20, 1 << 20, 1), (1 << 20, 1 << 20, 7), (6, 1 << 20, 7), (6, 3, 3)])
def test_languages_are_those_of_counted_words_and_grams(spark, odd_texts, common, most, parts, monkeypatch):
    monkeypatch.setattr(language, "COMMON", common)  # with 6, most words are joined
    monkeypatch.setattr(language, "GRAMS", most)  # with 3, n-grams are
    rng = np.random.default_rng(21)
    rows = [(None if k == 3 else k, t, "fr") for k, t in enumerate(odd_texts)]
    letters = {"en": "aehinorst", "de": "aeinrstuü", "fr": "aeéilnrsu"}
    for k in range(100, 260):
        lang = ["en", "de", "fr", None][int(rng.integers(4))]
        size = int(rng.integers(1, 40))
        own = letters[lang or "en"]
        rows.append((k, " ".join("".join(rng.choice(list(own), rng.integers(1, 5))) for _ in range(size)), lang))
    rows += rows[-3:]  # repeated rows
    frame = spark.createDataFrame([(d, t, x, 1, 2) for d, t, x in rows], "doc_id long, text string, lang string, n int, key int")
    got = language.predicted(frame.repartition(parts)).collect()
    want = Counter((d, lang, round(share, 4)) for (d, _, _), (lang, share) in zip(rows, brute_language(rows), strict=True))
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in got) == want


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="driver tables are not here")
def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, seven = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predicted(docs.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == seven.keys()
    assert all(one[d][0] == seven[d][0] and one[d][1] == pytest.approx(seven[d][1], abs=1e-6) for d in one)


def test_grams_stay_in_their_word():
    keys, word = language.grams([b"ab", "é".encode(), b"c"])
    assert len(keys) == language.LONGEST and word.max() == 2
    sizes = [[int((k[word == w] != 0).sum()) for w in range(3)] for k in keys]
    assert sizes[0] == [4, 3, 3] and sizes[1] == [3, 2, 2] and sizes[3] == [1, 0, 0]


def test_neighbours_cases(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts)
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = neighbours.classified(docs, neighbours.fitted(docs, none)).collect()
    assert len(rows) == len(odd_texts) and {r["score"] for r in rows} == {0.5}
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(odd_texts))] + [(3, None)], "doc_id long, quality int")
    rows = neighbours.classified(docs, neighbours.fitted(docs, labels)).collect()
    assert len(rows) == len(odd_texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert neighbours.classified(make_docs([]), neighbours.fitted(make_docs([]), labels)).count() == 0


def brute_votes(vectors, sample, labels):
    out = []
    for v in vectors:
        cosine = sample @ v
        near = np.argsort(-cosine)[: neighbours.NEIGHBOURS]
        weight = np.maximum(cosine[near], 1e-6).astype(float) ** 8
        out.append((weight * labels[near]).sum() / weight.sum())
    return out


def test_votes_are_exact():
    rng = np.random.default_rng(4)
    unit = lambda n: neighbours._unit(rng.standard_normal((n, 8)))
    sample, labels, vectors = unit(300), rng.integers(0, 2, 300).astype(float), unit(1100)
    assert neighbours.votes(vectors, sample, labels) == pytest.approx(brute_votes(vectors, sample, labels))


def test_votes_of_equal_neighbours_go_by_the_samples_order():
    sample = np.repeat(neighbours._unit(np.eye(4, dtype=np.float32)), neighbours.NEIGHBOURS, 0)
    labels = np.random.default_rng(5).integers(0, 2, len(sample)).astype(float)
    vector = neighbours._unit(np.array([[0, 1, 0, 0]], np.float32))
    own = labels[neighbours.NEIGHBOURS : 2 * neighbours.NEIGHBOURS]
    assert neighbours.votes(vector, sample, labels) == pytest.approx(own.mean())
    half = neighbours._unit(np.array([[0, 0, 1, 1]], np.float32))  # as near to two groups: the first one's
    assert neighbours.votes(half, sample, labels) == pytest.approx(labels[2 * neighbours.NEIGHBOURS : 3 * neighbours.NEIGHBOURS].mean())


def test_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(0, 20)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 20)).astype(np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == table[-1, -1]


def test_only_candidates_with_enough_words_of_the_item_are_aligned(monkeypatch):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 200, n)]
    own = [words(20) for _ in range(5)]
    items = decontaminate.Items([(k, " ".join(w).encode(), None) for k, w in enumerate(own)], np.zeros(decontaminate.HASHED, np.int64))
    texts = [" ".join(words(70)) for _ in range(80)]
    texts += [" ".join([*words(20), *(w if k % 3 or k > 16 else "other" for k, w in enumerate(item)), *words(20)]) for item in own]
    column = pa.array([t.encode() for t in texts], pa.binary())
    search = decontaminate.Search(items, np.eye(decontaminate.FEATURES, 300, dtype=np.float32))
    monkeypatch.setattr(decontaminate, "COSINE", 0.1)
    calls, real, may = [], decontaminate.aligned, decontaminate.may_align
    monkeypatch.setattr(decontaminate, "aligned", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(decontaminate, "may_align", lambda *a: True)
    want, every = search.matches(column), len(calls)
    calls.clear()
    monkeypatch.setattr(decontaminate, "may_align", may)
    assert search.matches(column) == want and {r[:2] for r in want} >= {(80 + k, k) for k in range(5)}
    assert 5 <= len(calls) < every / 4
    for keys, item, _ in calls:  # as many words in common, in any order
        assert sum(min((keys == k).sum(), (item == k).sum()) for k in np.unique(item)) >= 0.5 * len(item)


def test_leaks(spark, make_docs, odd_texts):
    filler = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    item = "What is the tallest mountain of the northern range, measured from its base to the summit? The answer is grey peak."
    words = item.replace(",", "").replace("?", "").rstrip(".").split()
    reworded = " ".join(w if k % 3 else f"other{k}" for k, w in enumerate(words[:-3])) + " " + " ".join(words[-3:])
    no_answer = " ".join(w if k % 3 else f"other{k}" for k, w in enumerate(words[:-3])) + " is blue hill"
    texts = odd_texts + [
        filler("a", 500) + " " + item + " " + filler("b", 300), item.upper() + "!!", " ".join(w + "$$$" for w in words), filler("c", 60) + " " + reworded,
        filler("d", 60) + " " + no_answer, filler("e", 900), None]
    benchmark = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, filler("zz", 20)), (1, item)], "item_id long, text string")
    docs = make_docs(texts, [None if k == 1 else k for k in range(len(texts))])
    n = len(odd_texts)
    got = decontaminate.leaks(docs, benchmark).collect()
    assert sorted({(r["doc_id"], r["item_id"]) for r in got}) == [(n + k, 1) for k in range(4)]
    clean = decontaminate.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(texts) - 4
    assert decontaminate.leaks(docs, benchmark.where("item_id = 3")).count() == 0
    assert decontaminate.decontaminated(make_docs([]), benchmark).count() == 0
    answers = benchmark.where("item_id = 1").distinct().withColumn("answer", F.lit("blue hill"))
    assert (n + 4) in {r["doc_id"] for r in decontaminate.leaks(docs, answers).collect()}
