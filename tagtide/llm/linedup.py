"""Removes runs of lines that stood somewhere before, by winnowing over line hashes.

From each line on, the shortest run with ``RUN`` words is a short run, named by
its lines' hashes. A window is the shortest run from each line on that has
``MIN_WORDS`` words; of the short runs inside it the one with the least name is
selected (of equal names the last), and each selected place is kept once, as a
fingerprint. A repeated run of ``MIN_WORDS`` words holds a whole window, so it
shares a fingerprint with the place it repeats; shorter ones, from ``RUN`` words
on, are found where they are selected. A fingerprint's first place, in the order
of doc_id, row and line, is joined to its later ones; each match is extended
line by line both ways, and the later run is deleted. A line's first place is
never deleted, so no text vanishes everywhere. All of it is DataFrame functions.

Lines are compared without white space at their ends; lines without a word take
part in nothing and go only when they lie inside a deleted run.

Defined cases: a null text stays null; a text whose lines all go becomes empty;
of repeated rows the first keeps its lines; a null doc_id sorts first; texts of
fewer words than a window lose nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.columns import DOC, keyed, unpacked
from tagtide.llm.hostrules import let, words_of
from tagtide.llm.staging import staged

MIN_WORDS = 50
RUN = 20
STRIDE = 64  # lines compared at once when a match is extended


def _n_words(trimmed: Column) -> Column:
    """Words of a line without white space at its ends; by its spaces alone where they are single."""
    apart = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
    odd = F.rlike(trimmed, F.lit("[\\x09\\x0B-\\x0D]|\\x20\\x20"))
    return F.when(trimmed == "", 0).when(odd, F.size(words_of(trimmed))).otherwise(apart)


def hashed(text: Column) -> Column:
    """60 bits of the MD5, as other engines have it too."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _units(text: Column) -> Column:
    """Of each line with a word: its number, hash and number of words."""
    blank = F.lit(" \t\x0b\x0c\r")
    lines = F.transform(F.split(text, "\n"), lambda line, k: let(F.btrim(line, blank), lambda x: F.struct(
        k.alias("line"), hashed(x).alias("h"), _n_words(x).alias("w"))))
    return F.filter(lines, lambda x: x["w"] > 0)


def _matching(own: Column, other: Column, at: Column, at_other: Column, step: int) -> Column:
    """How many lines agree from two places on, forwards (step 1) or backwards (-1)."""
    room = F.least(F.size(own) - at, F.size(other) - at_other) if step > 0 else F.least(at, at_other) + 1
    room = F.greatest(room, F.lit(0))

    def part(array: Column, place: Column, done: Column, n: Column) -> Column:
        return F.slice(array, place + done + 1, n) if step > 0 else F.reverse(F.slice(array, place - done - n + 2, n))

    def move(state: Column, k: Column) -> Column:
        done, n = k * STRIDE, F.least(F.lit(STRIDE), room - k * STRIDE)
        unlike = F.array_position(F.zip_with(part(own, at, done, n), part(other, at_other, done, n), lambda a, b: a != b), True)
        agreed = F.when(unlike == 0, n).otherwise((unlike - 1).cast("int"))
        return F.when(state["stop"], state).otherwise(
            F.struct((state["n"] + agreed).alias("n"), (agreed < n).alias("stop")))

    blocks = F.when(room > 0, F.sequence(F.lit(0), F.floor((room - 1) / STRIDE).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("n"), F.lit(False).alias("stop")), move, lambda s: s["n"])


def fingerprints(rows: DataFrame, min_words: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """row, doc_id, pos, last and fingerprint of the selected short runs of rows with (row, doc_id, units)."""
    units = rows.select("row", "doc_id", F.posexplode("units")).select("row", "doc_id", "pos", "col.*")
    upto = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("before", F.coalesce(F.sum("w").over(upto), F.lit(0)))
    behind = F.col("before") + F.col("w")
    short, window = (Window.partitionBy("row").orderBy("before").rangeBetween(0, n - 1) for n in (run, min_words))
    names = hashed(F.array_join(F.collect_list("h").over(short).cast("array<string>"), ","))
    runs = units.select(
        "row", "doc_id", "pos", "before", "w", F.max("pos").over(short).alias("last"), F.max(behind).over(short).alias("end"),
        F.when(F.max(behind).over(short) - F.col("before") >= run, names).alias("name"))
    inside = runs.select(
        "row", "doc_id", (F.max(behind).over(window) - F.col("before")).alias("words"), F.max(behind).over(window).alias("end"),
        F.collect_list(F.struct("name", (-F.col("pos")).alias("place"), "last", F.col("end").alias("upto"))).over(window).alias("runs"))
    least = F.array_min(F.filter("runs", lambda x: x["name"].isNotNull() & (x["upto"] <= F.col("end"))))
    return inside.where(F.col("words") >= min_words).select("row", "doc_id", least.alias("s")).select(
        "row", "doc_id", (-F.col("s.place")).alias("pos"), "s.last", F.col("s.name").alias("fingerprint")).distinct()


def repeated_runs(rows: DataFrame, min_words: int = MIN_WORDS, short: int = RUN) -> DataFrame:
    """row and lines (array of first and last line numbers of deleted runs) of rows with (row, doc_id, units)."""
    windows = staged(fingerprints(rows, min_words, short), "fingerprints")
    first = windows.groupBy("fingerprint").agg(
        F.min(F.struct("doc_id", "row", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = windows.join(first, "fingerprint").where("row != first.row OR pos != first.pos").select(
        "row", "pos", "last", F.col("first.row").alias("source"), (F.col("pos") - F.col("first.pos")).alias("shift"))
    # Short runs that follow or overlap each other in the same two places are one run.
    run = Window.partitionBy("row", "source", "shift").orderBy("pos")
    later = later.withColumn("opens", F.coalesce(F.lag("last").over(run) + 1 < F.col("pos"), F.lit(True)).cast("int"))
    later = later.withColumn("run", F.sum("opens").over(run))
    runs = later.groupBy("row", "source", "shift", "run").agg(F.min("pos").alias("a"), F.max("last").alias("b"))
    hashes = rows.select("row", F.transform("units", lambda x: x["h"]).alias("h"), F.transform("units", lambda x: x["line"]).alias("line"))
    pairs = runs.join(hashes, "row").join(hashes.select(F.col("row").alias("source"), F.col("h").alias("h0")), "source")
    back = _matching(F.col("h"), F.col("h0"), F.col("a") - 1, F.col("a") - F.col("shift") - 1, -1)
    on = _matching(F.col("h"), F.col("h0"), F.col("b") + 1, F.col("b") - F.col("shift") + 1, 1)
    spans = pairs.select("row", F.struct(
        F.get("line", F.col("a") - back).alias("a"), F.get("line", F.col("b") + on).alias("b")).alias("span"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("lines"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows as ``_doc`` with text (without repeated runs), n_lines and n_deleted."""
    rows = keyed(docs)
    units = staged(rows.select("row", "doc_id", _units(F.col("text")).alias("units")).where("size(units) > 0"), "units")
    runs = repeated_runs(units, min_words).withColumnRenamed("lines", "cut")

    def merged(spans: Column) -> Column:
        def add(out: Column, s: Column) -> Column:
            end = F.get(out, F.size(out) - 1)
            longer = F.struct(end["a"].alias("a"), F.greatest(end["b"], s["b"]).alias("b"))
            return F.when((F.size(out) > 0) & (end["b"] + 1 >= s["a"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer))).otherwise(
                F.concat(out, F.array(F.struct(s["a"].alias("a"), s["b"].alias("b")))))

        return F.aggregate(spans, F.array().cast("array<struct<a:int,b:int>>"), add)

    def remaining(lines: Column) -> Column:
        gone = let(merged(F.col("cut")), lambda m: F.flatten(F.transform(m, lambda s: F.sequence(s["a"], s["b"]))))
        return let(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda keep: F.transform(keep, lambda k: F.get(lines, k)))

    left = let(F.split(F.col("text"), "\n"), remaining)
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    uncut = F.col("cut").isNull()
    out = rows.join(runs, "row", "left").withColumn("left", F.when(~uncut, left))
    return out.select(
        DOC, F.when(uncut, F.col("text")).otherwise(F.array_join("left", "\n")).alias("text"),
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.when(uncut, 0).otherwise(n_lines - F.size("left")).cast("long").alias("n_deleted"))


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with their own columns: text without repeated runs, and n_chars, where there is one, of that text.

    Documents that lose every word go; those that had none stay as they are.
    """
    word = F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]"))
    out = deduplicated(docs, min_words).where(F.coalesce(word, F.lit(False)) | (F.col("n_deleted") == 0))
    length = F.when(F.col("n_deleted") == 0, F.col(f"{DOC}.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType) if (
        "n_chars" in docs.columns) else F.lit(None)
    return out.select(*unpacked(docs.columns, text=F.col("text"), n_chars=length))
