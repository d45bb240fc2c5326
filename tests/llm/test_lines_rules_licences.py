import hashlib

import pytest

from pyspark.sql import functions as F

from tagtide.llm import hostrules, licences, linedup
from tagtide.llm.columns import DOC


def brute_repeats(words):
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    return len({k + j for at in windows.values() if len(at) > 1 for k in at for j in range(8)})


def test_counts(make_docs, odd_texts):
    texts = odd_texts + ["a b c d e f g h " * 3 + "z", "x\ny\nx\n \n \nx", "# $ * | <> ok & %", "p q r s t u v w p q r s t u v w"]
    got = hostrules.judged(make_docs(texts)).orderBy(f"{DOC}.doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        words = (text or "").encode().split()
        lines = [line for line in (text or "").split("\n") if line.encode().split()]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(len(w.decode()) for w in words)
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == brute_repeats(words)
        assert r["base_failed"] == (len(words) < 20 or 100 * brute_repeats(words) > 30 * len(words))
    assert hostrules.judged(make_docs([])).count() == 0


def test_hosts_are_shrunk_and_clean_documents_stay(spark, make_docs):
    clean = " ".join(f"clean{k}" for k in range(40))
    signs = " ".join(f"word{k}$$$" for k in range(40))
    docs = make_docs([clean] * 60 + [signs] * 2, list(range(62)), "good")
    docs = docs.union(make_docs([clean] * 3 + [signs] * 80, list(range(100, 183)), "bad")).union(make_docs([clean, signs], [200, 201], None))
    rows = {r[DOC]["doc_id"]: r for r in hostrules.judged(docs).collect()}
    assert [rows[k]["kept"] for k in (0, 61, 100, 102, 103, 182, 200)] == [True, True, True, True, False, False, True]
    assert rows[103]["host_rate"] < 80 / 83  # drawn towards all hosts' rate
    assert sorted(r["doc_id"] for r in hostrules.kept(docs).collect()) == sorted(k for k, r in rows.items() if r["kept"])
    assert hostrules.kept(docs).columns == docs.columns
    one = hostrules.host_rates(hostrules.judged(docs.where("source = 'bad'"))).first()
    assert one["shrunk_rate"] == pytest.approx(80 / 83)


def line_hash(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def selected_runs(unit, least, run):
    """(first, last, name) of the short runs that windows of (line number, text, words) select."""
    def shortest(i, words):
        n = 0
        for j in range(i, len(unit)):
            n += unit[j][2]
            if n >= words:
                return j
        return None

    short = [shortest(i, run) for i in range(len(unit))]
    out = set()
    for i in range(len(unit)):
        last = shortest(i, least)
        if last is not None:
            names = [(line_hash(",".join(str(line_hash(x)) for _, x, _ in unit[j : short[j] + 1])), -j)
                     for j in range(i, last + 1) if short[j] is not None and short[j] <= last]
            name, j = min(names)
            out.add((-j, short[-j], name))
    return sorted(out)


def brute_lines(docs, least, run=linedup.RUN):
    """Texts without the later of repeated runs: the first place of each selected run against its later ones, line by line."""
    units = []
    for _, text in docs:
        lines = [(k, line.strip(" \t\n\x0b\x0c\r")) for k, line in enumerate((text or "").split("\n"))]
        units.append([(k, x, len(x.split())) for k, x in lines if x.split()])
    places, gone = {}, [set() for _ in docs]
    for d, unit in enumerate(units):
        for i, last, key in selected_runs(unit, least, run):
            j = last + 1
            if key not in places:
                places[key] = (d, i)
                continue
            e, k = places[key]
            a, b = i, j - 1
            while a > 0 and k - (i - a) > 0 and unit[a - 1][1] == units[e][k - (i - a) - 1][1]:
                a -= 1
            while b + 1 < len(unit) and k + (b - i) + 1 < len(units[e]) and unit[b + 1][1] == units[e][k + (b - i) + 1][1]:
                b += 1
            gone[d].update(range(unit[a][0], unit[b][0] + 1))
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in g) for (_, t), g in zip(docs, gone, strict=True)]


def passage(tag, lines, words):
    return "\n".join(" ".join(f"{tag}{k}x{j}" for j in range(words)) for k in range(lines))


def test_repeated_runs_go(make_docs):
    a, b, c = passage("a", 6, 12), passage("b", 1, 60), passage("c", 200, 9)
    texts = [
        a, "head line\n" + b + "\nshort tail", "other head\n" + a + "\n\nend", passage("d", 3, 5) + "\n " + b + " \nshort tail\nlast", c,
        "\n".join(c.split("\n")[20:180]), b + "\n" + b, passage("e", 2, 20), passage("e", 2, 20), None, "", " \n ",
        "\n".join(a.split("\n")[:2]), a.split("\n")[0] + "\n" + b, ("y " * 30 + "\n") * 5,
    ]
    docs = make_docs(texts)
    got = linedup.deduplicated(docs).orderBy(f"{DOC}.doc_id").collect()
    want = brute_lines(list(enumerate(texts)), 50)
    assert [r["text"] or "" for r in got] == want
    assert got[9]["text"] is None and got[8]["text"] == texts[8]  # 40 words are no window
    places = linedup.fingerprints(linedup.keyed(docs).select("row", "doc_id", linedup._units(F.col("text")).alias("units")))
    lines = sum(len([x for x in (t or "").split("\n") if x.split()]) for t in texts)
    assert 0 < places.count() < lines / 2  # thinned
    kept = linedup.without_repeats(docs)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert 6 not in rows and rows[9]["text"] is None and rows[2]["n_chars"] == len(want[2])
    assert linedup.deduplicated(make_docs([])).count() == 0


def test_of_repeated_rows_the_first_stays(make_docs):
    text = passage("q", 4, 20)
    got = linedup.deduplicated(make_docs([text, text, text], [4, 4, None])).collect()
    assert sorted((r["text"] == text, r["n_deleted"]) for r in got) == [(False, 4), (False, 4), (True, 0)]
    assert next(r for r in got if r["n_deleted"] == 0)[DOC]["doc_id"] is None  # a null doc_id sorts first


def test_licences_match_whole_texts(spark, make_docs):
    mit = licences.KNOWN["MIT"]
    texts = [
        mit, "Copyright (c) 2019 Some One\n\n" + mit.upper().replace(",", " ;") + "\n(C) 2020 Other", mit + " More.", mit.replace("sublicense", "sub-licence"),
        "released under the mit licence", None, "", "Copyright 2020 X", "Copyright notice rules apply", "LICENSED UNDER THE APACHE LICENCE - VERSION 2.0",
    ]
    docs = make_docs(texts).withColumnRenamed("text_md5", "licence").withColumnRenamed("h", "digest")
    got = {r[DOC]["doc_id"]: r for r in licences.scanned(docs, licences.known_licences(spark)).collect()}
    assert [got[k]["licence"] for k in range(10)] == [
        "MIT", "MIT", None, "MIT", "MIT-notice", None, None, None, None, "Apache-2.0-notice"]
    assert [got[k]["n_words"] for k in (5, 6, 7, 8)] == [0, 0, 0, 4] and got[7]["digest"] is None
    twice = licences.known_licences(spark, {"b": "Same text.", "a": "same TEXT"})
    assert [r["licence"] for r in licences.scanned(make_docs(["Same, text"]), twice).collect()] == ["a"]
