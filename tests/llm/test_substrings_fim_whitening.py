"""Operators 11 to 13 against brute force and exact round trips."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtide.llm import fim, substrings, whitening
from tagtide.llm.suffixes import common_prefixes, suffix_array


def some_texts():
    rng = np.random.default_rng(11)
    for _ in range(400):
        text = rng.integers(1, rng.choice([2, 3, 4, 30]), rng.integers(0, 60)).tolist()
        yield text * rng.integers(1, 4) + [1] * int(rng.integers(0, 20) * (rng.random() < 0.2)) + [0]


def test_suffixes_and_their_common_prefixes():
    for text in some_texts():
        order = suffix_array(np.array(text))
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
        before, shared = common_prefixes(np.array(text), order)
        for a, b in zip(order, order[1:], strict=False):
            n = next(k for k in range(len(text)) if text[a + k] != text[b + k])
            assert (before[b], shared[b]) == (a, n)


def test_a_long_text_that_repeats():
    rng = np.random.default_rng(12)
    part = rng.integers(97, 101, 30_000)
    text = np.concatenate([part, rng.integers(97, 101, 40_000), part, [0]])
    order = suffix_array(text)
    raw = text.astype(np.uint8).tobytes()
    assert sorted(order.tolist()) == list(range(len(text)))
    assert all(raw[a : a + 40_000] < raw[b : b + 40_000] for a, b in zip(order, order[1:], strict=False))
    before, shared = common_prefixes(text, order)
    assert shared.max() >= 30_000 and (before[70_000], shared[70_000]) in ((0, shared.max()), (before[70_000], shared[70_000]))


def without_repeats(texts, length):
    texts = [(t or "").encode() for t in texts]
    places = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if places[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), spans, kept))
    return out


def repeating_texts(odd_texts):
    rng = np.random.default_rng(13)
    draw = lambda n: "".join(rng.choice(list("abcdefgh é\n東"), n))
    passage, tail = draw(330), draw(90)
    texts = odd_texts + [draw(400) + passage + draw(50), passage, draw(10) + passage[20:] + draw(300), passage[:199], "z" * 700, "xy" * 150,
                         draw(150) + tail + draw(150) + tail, draw(199), draw(200)]
    return texts + [draw(40) + passage[:230] + draw(40) for _ in range(30)]


@pytest.mark.parametrize(("length", "crowd"), [(200, substrings.CROWD), (200, 3), (16, 512)])
def test_repeats_are_those_of_brute_force(make_docs, odd_texts, length, crowd, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", crowd)  # with 3, windows of common names are counted one by one
    texts = repeating_texts([t if t is None or length == 200 else t[:3000] for t in odd_texts])
    ids = [None, 7, 7, *range(20, 17 + len(texts))]
    got = substrings.deduplicated(make_docs(texts, ids).repartition(5), length).collect()
    want = Counter(zip(ids, without_repeats(texts, length), strict=True))
    assert Counter((r["_doc"]["doc_id"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))) for r in got) == want
    assert got[0]["_doc"]["row"] == "r"


def test_no_repeats_and_no_rows(make_docs):
    assert substrings.deduplicated(make_docs([])).count() == 0
    assert [tuple(r)[1:] for r in substrings.deduplicated(make_docs(["abc", None])).orderBy("n_bytes").collect()] == [
        (0, 0, 0, b""), (3, 0, 0, b"abc")]


def test_equal_windows_share_a_name():
    text = "".join(np.random.default_rng(14).choice(list("ab"), 4000)) + "ab" * 900
    text += text[1000:2500]
    data = np.frombuffer(text.encode(), np.uint8)
    names, places = {}, {}
    for owner, start, windows, tied, name, _ in zip(*substrings.segments(data, np.array([0, len(data)]), 200), strict=True):
        assert owner == 0 and windows <= substrings.WINDOWS
        for k in range(start, start + windows):
            assert names.setdefault(text[k : k + 200], name) == name
            places.setdefault(text[k : k + 200], set()).add((start, tied))
    assert sum(len({s for s, _ in p}) for p in places.values()) >= len(text) - 199 - sum(t for p in places.values() for _, t in p) * 256
    assert any(t for p in places.values() for _, t in p)


def brute_fim(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:]
    return (n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_transformation_and_its_inverse(make_docs, odd_texts):
    rng = np.random.default_rng(15)
    draw = lambda n: "".join(rng.choice(list("a<P>SMé東🙂 "), n))
    texts = odd_texts + [draw(int(rng.integers(1, 12))) for _ in range(300)] + ["<P", ">", "<", "S>", "<M>", "x<S>", "é" * 100_000]
    ids = [None, 4, 4, *range(10, 7 + len(texts))]
    made = fim.transformed(make_docs(texts, ids).repartition(3))
    got = Counter((r["_doc"]["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"].decode())) for r in made.collect())
    assert got == Counter((i, brute_fim(i, t)) for i, t in zip(ids, texts, strict=True))
    assert {form for _, (_, form, *_) in got} == {"plain", "psm", "spm"}
    back = fim.restored(made, ["_doc", "n"]).collect()
    assert Counter((r["_doc"]["doc_id"], r["restored"].decode()) for r in back) == Counter((i, t or "") for i, t in zip(ids, texts, strict=True))
    assert "source" in made.schema["_doc"].dataType.names and "text" not in made.schema["_doc"].dataType.names
    assert fim.transformed(make_docs([])).count() == 0


def test_an_output_without_its_marker_is_an_error(spark):
    with pytest.raises(Exception, match="lacks a marker"):
        fim.restored(spark.createDataFrame([(b"<P>a<S>b", "psm")], "output binary, form string"), []).collect()


def check_whitening(rows, vectors, most=8):
    """``rows`` of the operator against numpy over (id, vector) pairs that count."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors], dtype=object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    centred = (x - 0).astype(float) - np.array([s / n for s in sums])
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(most, x.shape[1])
    white = centred @ directions[:, :k] / np.sqrt(values[:k])
    assert len(rows) == n * k
    for component in range(1, k + 1):
        of = [r for r in rows if r["component"] == component]
        assert len({r["explained"] for r in of}) == 1
        assert of[0]["explained"] == pytest.approx(values[component - 1] / values.sum(), rel=1e-9)
        got = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in of)
        options = [
            sorted((str(i), int(d), sign * w) for (i, _), d, w in zip(vectors, deviation, white[:, component - 1], strict=True)) for sign in (1, -1)]
        assert any(all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-7 for a, b in zip(got, o, strict=True)) for o in options)
    assert {r["n"] for r in rows} == {n} and len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def test_whitening_is_that_of_numpy(spark):
    rng = np.random.default_rng(16)
    good = [(k, (rng.standard_normal(12) * np.arange(1, 13) + 50).astype(np.float32).tolist()) for k in range(2500)]
    good += [(7, good[7][1]), (None, good[9][1])]
    bad = [(3000, None), (3001, [None] * 12), (3002, [1.0] * 11 + [float("nan")]), (3003, [float("inf")] * 12), (3004, []), (3005, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in good + bad], "vec_id long, embedding array<float>, n long, x int, number int")
    check_whitening(whitening.whitened(frame.repartition(7)).collect(), good)


def test_whitening_of_few_wide_or_equal_vectors(spark):
    rng = np.random.default_rng(17)
    schema = "vec_id long, embedding array<float>"
    few = [(k, rng.standard_normal(3).astype(np.float32).tolist()) for k in range(9)]
    check_whitening(whitening.whitened(spark.createDataFrame(few, schema)).collect(), few)
    wide = [(k, rng.standard_normal(1100).astype(np.float32).tolist()) for k in range(30)]
    rows = whitening.whitened(spark.createDataFrame(wide, schema), most=2).collect()
    check_whitening(rows, wide, most=2)
    flat = spark.createDataFrame([(k, [1.0, float(k % 2)]) for k in range(10)], schema)
    assert {r["component"] for r in whitening.whitened(flat).collect()} == {1}  # the other direction has no variance
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
