"""Quality rules of documents, judged together with the failure rates of their hosts.

Each document gets counts and a verdict on each rule. Failures are added up by
host; a host's rate is shrunk towards all hosts' rates by a beta prior that the
hosts themselves give (method of moments). A document goes if it fails a base
rule, or if it fails any rule and its host's shrunk rate is over a limit: clean
documents of a bad host stay. All of it is DataFrame functions.

Defined cases: a null text has no words; a null host is a host like any other;
repeated rows are judged and counted each; with no documents there is no result;
with one host, or hosts all alike, the prior is as strong as ``STRONGEST``
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.columns import carried, unpacked
from tagtide.llm.staging import staged

WINDOW = 8
STRONGEST = 1e6
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once a row even where the body uses it in a loop."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def repeated_words(words: Column) -> Column:
    """Number of words in windows of 8 words that occur twice or more, the first occurrence included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(s: Column) -> Column:
            alike = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(s, lambda x, k: alike(x, k - 1) | alike(x, k + 1)), lambda x: x["i"])

        def width(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

        return let(F.array_sort(let(pairs, same)), width)

    found = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0))


def counted(docs: DataFrame) -> DataFrame:
    """Adds the counts of each text; a null text counts as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit("[^\\x20\\x09-\\x0D]")))
    struct = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    return docs.withColumn("_counts", struct).withColumns({
        "n_words": F.col("_counts.n_words"), "word_chars": F.col("_counts.word_chars"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": F.col("_counts.n_repeat_words"),
    }).drop("_counts")


def failures() -> dict[str, Column]:
    """The rules; the first two are the base rules."""
    words = F.col("n_words")
    return {
        "few_words": words < 20,
        "repeats": 100 * F.col("n_repeat_words") > 30 * words,
        "symbols": F.col("n_symbols") * 10 > words,
        "dup_lines": F.col("n_dup_lines") * 20 > words,
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 12 * words),
    }


def host_rates(counted_docs: DataFrame, host: str = "host") -> DataFrame:
    """host, n, failed, rate and shrunk_rate: any rule's failures among the host's documents."""
    some = next(iter(failures().values()))
    for rule in list(failures().values())[1:]:
        some = some | rule
    hosts = counted_docs.groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("n"), F.sum(some.cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    total = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("failed").alias("failed"),
                      F.sum(rate * rate).alias("squares"), F.sum(rate).alias("rates"), F.sum(1 / F.col("n")).alias("inverse")).first()
    if not total["hosts"]:
        return hosts.select("host", "n", "failed", rate.alias("rate"), rate.alias("shrunk_rate"))
    mean = total["failed"] / total["n"]
    spread = total["squares"] / total["hosts"] - (total["rates"] / total["hosts"]) ** 2
    between = spread - mean * (1 - mean) * total["inverse"] / total["hosts"]  # without what chance alone spreads
    strength = min(STRONGEST, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else STRONGEST
    return hosts.select("host", "n", "failed", rate.alias("rate"),
                        ((F.col("failed") + mean * strength) / (F.col("n") + strength)).alias("shrunk_rate"))


def judged(docs: DataFrame, host: str = "source", limit: float = 0.5, own: list[str] | None = None) -> DataFrame:
    """The rows (or their ``own`` columns) as ``_doc`` with counts, host, base_failed, host_rate and kept.

    The counts are stored once for both passes.
    """
    rows = counted(carried(docs, "text", host, own=own).withColumnRenamed(host, "host"))
    rows = staged(rows.drop("text"), "counted")
    rates = host_rates(rows).select(F.col("host").alias("_host"), F.col("shrunk_rate").alias("host_rate"))
    rules = failures()
    base = rules["few_words"] | rules["repeats"]
    soft = rules["symbols"] | rules["dup_lines"] | rules["word_length"]
    return (
        rows.join(rates, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
        .withColumn("base_failed", base)
        .withColumn("kept", ~(base | (soft & (F.coalesce(F.col("host_rate"), F.lit(0.0)) > limit))))
    )


def kept(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judged(docs, host, limit).where("kept").select(*unpacked(docs.columns))
