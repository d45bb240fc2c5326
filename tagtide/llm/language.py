"""Language identification, words first.

A word seen in training adds its log frequency in each language. An unseen word
is scored by its characters: at each place the longest n-gram (``LONGEST`` down
to 1 characters, the word's edges being characters too) that training has seen.
All words and n-grams of the training texts count. Words are counted over the
corpus; a language's n-grams are those of its distinct words, each word once. The
``COMMON`` most frequent words are broadcast, whatever the others are joined:
they leave a document as its distinct rare words. N-grams are broadcast if there
are at most ``GRAMS`` of them and joined otherwise, with the same scores.

Defined cases: null or empty texts, and those without a letter, are ``und`` with
score 0; rows without a language teach nothing; repeated rows count each; equal
scores go to the language that sorts first; with nothing to learn from, all is
``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.columns import keyed
from tagtide.llm.staging import release, staged
from tagtide.llm.tally import Tally
from tagtide.llm.words import KeyTable, mixed, slices

LONGEST = 4
#: Words that are broadcast, with a number a language; and n-grams at most.
COMMON = 1 << 19
GRAMS = 1 << 20
#: Bytes of a broadcast table's numbers at most: fewer words are common where there are very many languages.
TABLE = 1 << 26
_LETTER = re.compile(r"[^\W\d_]")
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(words: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the n-grams of 1 to ``LONGEST`` characters that start at each place, 0 where one leaves its word; and the place's word."""
    joined = " " + "  ".join(w.decode("utf-8", "replace").replace(" ", "_") for w in words) + " "
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(_U)
    # A word is set between two spaces: its edges. The second of a pair opens the next word.
    edge = code == 32
    opens = edge & np.concatenate([[True], edge[:-1]])
    word = np.cumsum(opens) - 1
    keys, rolled = [], np.zeros(len(code), _U)
    for n in range(1, LONGEST + 1):
        rolled = rolled * _U(0x100000001B3) + np.concatenate([code[n - 1 :], np.zeros(n - 1, _U)]) + _U(1)
        same = np.zeros(len(code), bool)
        same[: len(code) - n + 1] = word[: len(code) - n + 1] == word[n - 1 :]
        keys.append(np.where(same, mixed(rolled + _U(n << 56)), _U(0)))
    return keys, word


def counted(docs: DataFrame) -> DataFrame:
    """lang, key, word, n: the words of all texts that have a language."""

    def count(batches):
        tallies: dict[str, Tally] = {}
        for batch in batches:
            for first, stop, words in slices(batch.column(0), lower=True):
                langs = batch.column(1)[first:stop].to_pylist()
                names = sorted(set(langs))
                own = np.repeat([names.index(x) for x in langs], np.diff(words.bounds))
                for k, lang in enumerate(names):
                    at = np.flatnonzero(own == k)
                    if not len(at):
                        continue
                    keys, where, n = np.unique(words.keys[at], return_index=True, return_counts=True)
                    tally = tallies.setdefault(lang, Tally(500_000))
                    known = tally.table.find(keys) >= 0
                    tally.add(keys, n)
                    # A word's bytes go out with the first slice that has it, its count once the tally is taken.
                    new = ~known
                    yield _word_rows(lang, keys[new], words.texts(at[where[new]]), np.zeros(int(new.sum()), np.int64))
                    if tally.full:
                        keys, n = tally.take()
                        yield _word_rows(lang, keys, [None] * len(keys), n)
        for lang, tally in tallies.items():
            keys, n = tally.take()
            yield _word_rows(lang, keys, [None] * len(keys), n)

    return docs.where("lang IS NOT NULL").select(F.col("text").cast("binary").alias("text"), "lang").mapInArrow(
        count, "lang string, key long, word binary, n long").groupBy("lang", "key").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def _word_rows(lang: str, keys: np.ndarray, words: list, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(words, pa.binary()), pa.array(n)],
        ["lang", "key", "word", "n"])


def gram_counts(words: DataFrame) -> DataFrame:
    """lang, key, n of the n-grams of (lang, word), rows that are distinct."""

    def count(batches):
        tallies: dict[str, Tally] = {}
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for lang in sorted(set(langs)):
                own = batch.column(1).take(pa.array(np.flatnonzero(langs == lang))).to_pylist()
                tally = tallies.setdefault(lang, Tally(500_000))
                for a in range(0, len(own), 1 << 14):
                    for found in grams(own[a : a + (1 << 14)])[0]:
                        tally.add(found[found != 0])
                if tally.full:
                    yield rows(lang, tally)
        for lang, tally in tallies.items():
            yield rows(lang, tally)

    def rows(lang, tally):
        keys, n = tally.take()
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "key", "n"])

    return words.select("lang", "word").mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def by_language(counts: DataFrame, langs: list[str]) -> DataFrame:
    """key, total, n (a count for each language in order)."""
    each = F.array(*(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)) for x in langs))
    return counts.groupBy("key").agg(F.sum("n").alias("total"), each.alias("n"))


def gathered(table: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts by language) of a table of bounded size, as columns of numbers."""
    found = table.select("key", *(F.col("n")[k].alias(f"n{k}") for k in range(width))).toArrow()
    return found["key"].to_numpy().view(_U), np.stack([found[f"n{k}"].to_numpy() for k in range(width)], 1)


def most_frequent(table: DataFrame, limit: int) -> DataFrame:
    """The rows of at most ``limit`` keys: all those of the levels of frequency that fit."""
    level = F.floor(F.log2("total") * 16).cast("int")
    sizes = table.groupBy(level.alias("level")).agg(F.count("*").alias("keys")).collect()  # some 1,000 levels at most
    least, taken = None, 0
    for row in sorted(sizes, key=lambda r: -r["level"]):
        if taken + row["keys"] > limit:
            break
        taken, least = taken + row["keys"], row["level"]
    return table.where(level >= least if least is not None else F.lit(False))


class Logs:
    """Smoothed log frequencies by language of counted keys: log((n + 1/2) / (N + V / 2))."""

    def __init__(self, totals: list[int], distinct: int):
        self.base = np.log(np.array(totals, float) + 0.5 * max(1, distinct))

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.log(n + 0.5) - self.base

    def column(self, n: str) -> Column:
        return F.zip_with(n, F.lit(self.base.tolist()), lambda x, b: F.log(x + 0.5) - b)


class Table:
    """Log frequencies by language of keys."""

    def __init__(self, counts: DataFrame, logs: Logs, width: int):
        keys, n = gathered(counts, width)
        self.keys = KeyTable()
        self.keys.add(keys)
        self.logs = logs.of(n).astype(np.float32)


class Model:
    """What training gave: the languages, all words, the common ones, and the n-grams."""

    def __init__(self, docs: DataFrame):
        counts = staged(counted(docs), "language")
        found = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
        self.langs = [r["lang"] for r in found]
        width = max(1, len(self.langs))
        words = staged(by_language(counts, self.langs), "words") if self.langs else None
        release(docs.sparkSession)
        if words is None:
            return
        self.word_logs = Logs([r["n"] for r in found], words.count())
        self.words = words
        self.common = Table(most_frequent(words, min(COMMON, TABLE // (4 * width))), self.word_logs, width)
        grams_ = staged(gram_counts(counts), "grams")
        totals = {r["lang"]: r["n"] for r in grams_.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        table = by_language(grams_, self.langs)
        distinct = table.count()
        self.gram_logs = Logs([totals.get(x, 0) for x in self.langs], distinct)
        fits = distinct <= min(GRAMS, TABLE // (4 * width))
        self.grams = Table(table, self.gram_logs, width) if fits else None
        self.gram_table = table


def by_broadcast_grams(lost: DataFrame, table: Table) -> DataFrame:
    """key and logs (a score for each language) of unseen words (key, word), n-grams at hand."""
    shared = lost.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        width = own.logs.shape[1]
        for batch in batches:
            words = batch.column(1).to_pylist()
            out = np.zeros((len(words), width))
            for a in range(0, len(words), 1 << 14):
                part = words[a : a + (1 << 14)]
                keys, word = grams(part)
                best = np.full(len(word), -1, np.int64)
                for k in reversed(keys):  # the longest that is known
                    open_ = best < 0
                    best[open_] = np.where(k[open_] != 0, own.keys.find(k[open_]), -1)
                hit = best >= 0
                sums = np.stack([np.bincount(word[hit], own.logs[best[hit], k], len(part)) for k in range(width)], 1)
                out[a : a + len(part)] = sums / np.maximum(1, np.bincount(word[hit], minlength=len(part)))[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), width).cast(pa.list_(pa.float64()))], ["key", "logs"])

    return lost.select("key", "word").mapInArrow(score, "key long, logs array<double>")


def by_joined_grams(lost: DataFrame, table: DataFrame, logs: Logs, width: int) -> DataFrame:
    """The same from a table of n-grams (key, n) of any size."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            words = batch.column(1).to_pylist()
            for a in range(0, len(words), 1 << 14):
                keys, word = grams(words[a : a + (1 << 14)])
                for size, k in enumerate(keys, 1):
                    at = np.flatnonzero(k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[a + word[at]]), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(k[at].view(np.int64))],
                        ["of", "place", "size", "key"])

    seen = lost.select("key", "word").mapInArrow(places, "of long, place int, size int, key long").join(table.select("key", "n"), "key")
    best = seen.groupBy("of", "place").agg(F.max_by("n", "size").alias("n")).select("of", logs.column("n").alias("logs"))
    mean = best.groupBy("of").agg(*(F.avg(F.col("logs")[k].cast("float").cast("double")).alias(f"_{k}") for k in range(width)))
    mean = mean.select(F.col("of").alias("key"), F.array(*(f"_{k}" for k in range(width))).alias("logs"))
    none = F.array(*(F.lit(0.0) for _ in range(width)))
    return lost.select("key").join(mean, "key", "left").select("key", F.coalesce("logs", none).alias("logs"))


def common_sums(rows: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, letters (whether there is one), sums (of common words by language) and rare words (key, word, n) of every text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.common)
    width = len(model.langs)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, done = batch.column(2), 0
            for first, stop, words in slices(texts, lower=True):
                n = stop - first
                doc = np.repeat(np.arange(n), np.diff(words.bounds))
                at = own.keys.find(words.keys)
                hit = at >= 0
                sums = np.stack([np.bincount(doc[hit], own.logs[at[hit], k], n) for k in range(width)], 1)
                lost = np.flatnonzero(~hit)
                # One entry for each document and word: keys are told apart by their number among the slice's.
                _, number = np.unique(words.keys[lost], return_inverse=True)
                pair, where, times = np.unique(doc[lost] * (len(lost) + 1) + number, return_index=True, return_counts=True)
                lost = lost[where]
                ends = np.searchsorted(doc[lost], np.arange(n + 1)).astype(np.int32)
                rare = pa.StructArray.from_arrays(
                    [pa.array(words.keys[lost].view(np.int64)), pa.array(words.texts(lost), pa.binary()), pa.array(times.astype(np.int64))],
                    ["key", "word", "n"])
                letters = [bool(t and _LETTER.search(t.decode("utf-8", "replace"))) for t in texts[first:stop].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, n), batch.column(1).slice(done, n), pa.array(letters, pa.bool_()),
                     pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64())),
                     pa.ListArray.from_arrays(pa.array(ends), rare)], ["row", "doc_id", "letters", "sums", "rare"])
                done += n

    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        look, "row long, doc_id long, letters boolean, sums array<double>, rare array<struct<key:long,word:binary,n:long>>")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's share of the posterior) of every whole text."""
    rows = keyed(docs.select("doc_id", "text"))
    held = held_out(F.col("doc_id")).alias("held_out")
    if not model.langs:
        return rows.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    width = len(model.langs)
    found = staged(common_sums(rows, model), "sums")
    rare = found.select("row", F.explode("rare").alias("w")).select("row", "w.*")
    words = staged(rare.groupBy("key").agg(F.min("word").alias("word")).join(
        model.words.select("key", F.col("n").alias("counts")), "key", "left"), "rare")
    lost = words.where("counts IS NULL")
    unseen = by_broadcast_grams(lost, model.grams) if model.grams else by_joined_grams(lost, model.gram_table, model.gram_logs, width)
    known = words.where("counts IS NOT NULL").select("key", model.word_logs.column("counts").alias("logs"))
    more = rare.select("row", "key", "n").join(known.unionByName(unseen), "key").groupBy("row").agg(
        *(F.sum(F.col("n") * F.col("logs")[k]).alias(f"_{k}") for k in range(width)))
    sums = F.array(*(F.col("sums")[k] + F.coalesce(F.col(f"_{k}"), F.lit(0.0)) for k in range(width)))
    whole = found.select("row", "doc_id", "letters", "sums").join(more, "row", "left").select("doc_id", "letters", sums.alias("sums"))
    top = F.array_max("sums")
    share = F.lit(1.0) / F.aggregate("sums", F.lit(0.0), lambda total, x: total + F.exp(x - top))
    best = F.get(F.lit(model.langs), F.array_position("sums", top).cast("int") - 1)
    return whole.select(
        "doc_id", held, F.when(F.col("letters"), best).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), share).otherwise(0.0).alias("score"))


def learned(docs: DataFrame) -> Model:
    """The model of training documents with their lang."""
    return Model(docs)


def predicted(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and predicts all."""
    return identified(docs, learned(docs.where(~held_out(F.col("doc_id"))).select("text", "lang")))
