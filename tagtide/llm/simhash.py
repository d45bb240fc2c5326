"""SimHash near-duplicates through a Gray-order hierarchical index.

Two fingerprints that differ in 3 bits or fewer agree on one of any 4 parts of
their bits. So equal parts deal the distinct fingerprints out into groups; a
group that is too large is dealt out again by 4 parts of its remaining bits,
until it is small or has so few free bits that it cannot be large. No link is
lost by that and no group is cut.

Within a group the index sorts fingerprints by Gray rank, so neighbours share
most bits. Every 8 neighbours get a node above them with the bits they all
share, up to one node for the group; a node keeps only the bits its parent
doesn't already have. A query walks down, adds up the differences to each node's
bits and leaves a node, and all below it, once they exceed the radius.

What leaves a group is one link per member to the smallest member it reaches,
never its pairs. Components over these links give the classes.

Defined cases: a null text is an empty one, with fingerprint zero, and linked
like any other; texts of fewer words than a shingle are one shingle; repeated
rows share their class; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.columns import id_and_text, keyed, unpacked
from tagtide.llm.components import components
from tagtide.llm.staging import release, staged
from tagtide.llm.words import mixed

RADIUS = 3
FAN = 8
#: Members up to which a group is indexed as it is.
GROUP = 4096
FULL = (1 << 64) - 1
#: Similarity of sets of shingles from which the pipeline takes texts for near copies.
ALIKE = 0.8
#: Least hashes in a band of each kind, all kinds over the same 64.
BANDS = (4, 8, 16)
#: Without effect since the shingles of all texts are counted; tests still set it.
SAMPLE = 1 << 14
#: Shingles of known frequency, which stand last in every prefix, at most; as many as are broadcast.
COMMON = 1 << 19
#: Rows of one key that a task compares with all others of the key.
TOGETHER = 2048
_TURNS = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(words: list[bytes], size: int) -> int:
    """Majority bits of the XXH64 (seed 42) of the words' shingles; fewer words are one shingle, none give zero."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(min(size, len(words)))), strict=False))
    n = max(1, len(words) - size + 1)
    hashed = map(partial(xxh64_intdigest, seed=42), shingles)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        part = np.fromiter(itertools.islice(hashed, 1 << 14), "<u8", min(n - k, 1 << 14))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of whole texts; only A-Z are lower-cased."""

    def compute(batches):
        for batch in batches:
            prints = [fingerprint((text.as_py() or b"").lower().split(), size) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(compute, "doc_id long, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _parts(mask: int) -> list[int]:
    """The mask with each of 4 even parts of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [mask | sum(1 << b for b in free[a:c]) for a, c in zip(cuts, cuts[1:], strict=False)]


def grouped(prints: DataFrame, limit: int = GROUP) -> DataFrame:
    """Distinct fingerprints dealt out: rows of (mask, value, fps), fps being 2 to ``limit`` members."""
    spark = prints.sparkSession
    level = prints.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in _parts(0)))).alias("mask"))
    masks, out = _parts(0), None
    while True:
        rows = staged(level.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "groups")
        counts = rows.groupBy("mask", "value").agg(F.count("*").alias("n"))
        free = 64 - min(m.bit_count() for m in masks)
        if (1 << free) <= limit:  # no more distinct members than the free bits can name
            fit = counts.where("n > 1")
            large = None
        else:
            fit = counts.where(F.col("n").between(2, limit))
            large = counts.where(F.col("n") > limit).select("mask", "value")
        groups = rows.join(fit.select("mask", "value"), ["mask", "value"]).groupBy("mask", "value").agg(F.collect_list("fp").alias("fps"))
        out = groups if out is None else out.unionByName(groups)
        if large is None or large.isEmpty():
            return out
        children = spark.createDataFrame(
            [(_signed(m), [_signed(c) for c in _parts(m)]) for m in sorted(set(masks))], "mask long, children array<long>")
        level = (
            rows.join(large, ["mask", "value"], "left_semi").join(F.broadcast(children), "mask")  # 4 to 4096 masks
            .select("fp", F.explode("children").alias("mask")).distinct()
        )
        masks = sorted({c for m in masks for c in _parts(m)})


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each value in the Gray code's order."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over many groups at once; ``sizes`` members each, one group after another."""

    def __init__(self, prints: np.ndarray, sizes: np.ndarray):
        group = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((gray_rank(prints), group))
        self.prints, self.group = prints[order], group
        starts = np.cumsum(sizes) - sizes
        # Of each level from the leaves up: bits common to all below, and where each group's nodes start.
        self.levels = [(self.prints, np.full(len(prints), FULL, np.uint64), starts, sizes)]
        every, some = self.prints, self.prints
        while sizes.max(initial=0) > 1:
            counts = -(-sizes // FAN)
            upper = np.cumsum(counts) - counts
            own = np.repeat(np.arange(len(counts)), counts)
            first = starts[own] + FAN * (np.arange(len(own)) - upper[own])
            every, some = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first)
            starts, sizes = upper, counts
            self.levels.append((every, ~(every ^ some), starts, sizes))

    def _parents(self, depth: int, nodes: np.ndarray, group: np.ndarray) -> np.ndarray:
        return self.levels[depth + 1][2][group] + (nodes - self.levels[depth][2][group]) // FAN

    def pairs(self, queries: np.ndarray, radius: int = RADIUS):
        """(query, member) positions within the radius, members behind the query only."""
        top = len(self.levels) - 1
        group = self.group[queries]
        nodes, away = self.levels[top][2][group], np.zeros(len(queries), np.uint8)
        for depth in range(top - 1, -1, -1):
            _, upper_mask, upper_start, _ = self.levels[depth + 1]
            value, mask, start, size = self.levels[depth]
            begin = FAN * (nodes - upper_start[group])
            count = np.minimum(size[group] - begin, FAN)
            parent = np.repeat(nodes, count)
            at = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count)
            child = np.repeat(start[group] + begin, count) + at
            queries, group, away = np.repeat(queries, count), np.repeat(group, count), np.repeat(away, count)
            own = mask[child] & ~upper_mask[parent]
            away = away + np.bitwise_count((self.prints[queries] ^ value[child]) & own)
            near = away <= radius
            if depth == 0:
                near &= child > queries
            queries, group, nodes, away = queries[near], group[near], child[near], away[near]
        return (queries, nodes) if top else (queries[:0], queries[:0])

    def roots(self, radius: int = RADIUS, together: int = 1024) -> np.ndarray:
        """Position of the first member that each member reaches by links."""
        parent = np.arange(len(self.prints))
        together = max(1, min(together, (1 << 20) // int(self.levels[0][3].max(initial=1))))  # 2^20 pairs at once at most

        def find(x):
            while True:
                up = parent[x]
                if np.array_equal(up, x):
                    return x
                x = up

        for k in range(0, len(parent), together):
            a, b = self.pairs(np.arange(k, min(k + together, len(parent))), radius)
            while len(a):
                a, b = find(a), find(b)
                apart = a != b
                a, b = a[apart], b[apart]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        return find(np.arange(len(parent)))


def links(groups: DataFrame) -> DataFrame:
    """(a, b) from every member that has links in a group to the first that it reaches there."""

    def search(batches):
        for batch in batches:
            column = batch.column(0)
            sizes = np.diff(column.offsets.to_numpy())
            if not sizes.sum():
                continue
            index = GrayIndex(column.flatten().to_numpy().view(np.uint64), sizes)
            roots = index.roots()
            linked = np.flatnonzero(roots != np.arange(len(roots)))
            prints = index.prints.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[roots[linked]])], ["a", "b"])

    return groups.select("fps").mapInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links reach."""
    prints = staged(fingerprints(docs, size), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = components(links(grouped(classes.select("fp")))).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    linked = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = linked.join(least, "root").select("fp", "component_id")
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """Distinct XXH64 (seed 42) of the words' shingles, sorted; fewer words are one shingle, none give none."""
    from xxhash import xxh64_intdigest

    shingles = map(b" ".join, zip(*(words[k:] for k in range(min(size, len(words)))), strict=False)) if words else ()
    return np.unique(np.fromiter(map(partial(xxh64_intdigest, seed=42), shingles), np.uint64))


def bands(shingles: np.ndarray) -> list[int]:
    """Keys of a set of shingles: 2 sets of similarity 0.8 share one with a chance of 0.9998, those of 0.3 with one of 0.13."""
    if not len(shingles):
        return []
    least = np.full(len(_TURNS), FULL, np.uint64)
    for a in range(0, len(shingles), 1 << 12):
        least = np.minimum(least, mixed(shingles[None, a : a + (1 << 12)] * _TURNS[:, None]).min(1))
    keys = []
    for rows in BANDS:
        for k in range(0, len(least), rows):
            keys.append(hash_of(least[k : k + rows], len(keys)))
    return keys


def hash_of(values: np.ndarray, seed: int) -> int:
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(values.tobytes(), seed))


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles, sorted, and in how many texts each is; all texts are counted."""
    release(docs.sparkSession)

    def spread(batches):
        for batch in batches:
            sets = [shingle_set((text.as_py() or b"").lower().split(), size) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])

    texts = docs.select(F.col("text").cast("binary").alias("text"))
    rows = staged(texts.mapInArrow(spread, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "common")
    least, held = 2, 0
    for n, count in rows.groupBy("n").count().orderBy(F.desc("n")).limit(COMMON).toLocalIterator():  # a row for each frequency
        held += count
        if held > COMMON:
            least = n + 1
            break
    found = rows.where(F.col("n") >= least).toArrow()  # 8 MB at most
    release(docs.sparkSession)  # by now: right after the count its shuffle files stay, some 2.5 times the input
    shingles, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(shingles)
    return shingles[order], n[order]


def least_shared(n: int, least: float) -> int:
    """Shingles that a set of n has in common at least with any set of a similarity of ``least``."""
    return math.ceil(Fraction(least) * n * (1 - Fraction(1, 1 << 40)))


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float = ALIKE) -> np.ndarray:
    """The first of a set's shingles, the rare before the common: two sets of a similarity of ``least`` share one of theirs."""
    known, counts = common
    weight = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        weight = np.where(known[at] == shingles, counts[at], 0)
    order = np.argsort(weight, kind="stable")  # ties go by the shingle: one order for all sets
    return shingles[order][: len(shingles) - least_shared(len(shingles), least) + 1] if len(shingles) else shingles


def banded(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fp, same (digest of the set of shingles), n (their number), keys (its bands) and prefix of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def compute(batches):
        for batch in batches:
            prints, same, sizes, keys, prefixes = np.zeros(len(batch), np.uint64), [], [], [], []
            for k, text in enumerate(batch.column(1)):  # the words of one text at a time
                words = (text.as_py() or b"").lower().split()
                own = shingle_set(words, size)
                prints[k] = fingerprint(words, size)
                same.append(sha256(own.tobytes()).digest())
                sizes.append(len(own))
                keys.append(bands(own))
                prefixes.append(prefix(own, shared.value).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "fp", "same", "n", "keys", "prefix"])

    return id_and_text(docs).mapInArrow(compute, "doc_id long, fp long, same binary, n int, keys array<long>, prefix array<long>")


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and its set of shingles as bytes."""

    def compute(batches):
        for batch in batches:
            sets = [shingle_set((text.as_py() or b"").lower().split(), size).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return id_and_text(docs).mapInArrow(compute, "doc_id long, shingles binary")


def alike(pairs: DataFrame, least: float = ALIKE) -> DataFrame:
    """The (a, b) of rows of (a, b, x, y) whose sets x and y have a Jaccard similarity of ``least``."""

    def compute(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= least * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(compute, "a long, b long")


def compared(docs: DataFrame, size: int, pairs: DataFrame) -> DataFrame:
    """The links among pairs (a, b) of doc_ids, their whole sets of shingles compared."""
    pairs = staged(pairs.distinct(), "pairs")
    # Stored, so that Spark knows how few they are before it would shuffle all texts.
    members = staged(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "members")
    sets = staged(shingled(docs.join(members, "doc_id", "left_semi"), size), "shingles")
    release(docs.sparkSession)
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return alike(both)


def least_alike(least: float) -> tuple[float, float]:
    """What sets of a similarity of ``least`` have in common at least: as a share of either, and of the sum of both."""
    ratio = Fraction(least) * (1 - Fraction(1, 1 << 40))
    return float(ratio), float(ratio / (1 + ratio))


def own_share(n: Column, half: float) -> Column:
    """Shingles that a set of n shares at least with one that is as large or larger."""
    return F.ceil(2 * half * n - 1e-6)


def meetings(sets: DataFrame, least: float = ALIKE) -> DataFrame:
    """Places where two sets in different classes share a shingle of their prefixes: (least, n, at) of the larger set, _a, and of the smaller one, _b.

    The smaller set shares more of its own than the larger one, so the start of its
    prefix is enough: sets with more shingles than that of their own, though alike
    in all others, don't meet. Keys of one class are left out; the rows of a large
    key are dealt out and each part meets all of the key.
    """
    least, half = least_alike(least)
    of_key = Window.partitionBy("key")
    rows = sets.select("least", "n", "root", F.posexplode("prefix").alias("at", "key")).select(
        "*", F.ceil(F.count("*").over(of_key) / TOGETHER).cast("int").alias("parts"), (F.min("root").over(of_key) != F.max("root").over(of_key)).alias("live"))
    rows = staged(rows.where("live").drop("live"), "shared")
    release(sets.sparkSession)
    larger = rows.select("key", F.pmod(F.xxhash64("least"), "parts").cast("int").alias("part"), *(F.col(c).alias(f"{c}_a") for c in ("least", "n", "root", "at")))
    smaller = rows.where(F.col("at") <= F.col("n") - own_share(F.col("n"), half)).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *(F.col(c).alias(f"{c}_b") for c in ("least", "n", "root", "at")))
    enough = half * (F.col("n_a") + F.col("n_b")) - 1e-6
    return larger.join(smaller, ["key", "part"]).where(
        (F.col("root_a") != F.col("root_b"))
        & ((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("least_a") > F.col("least_b"))))
        & (F.col("n_b") >= least * F.col("n_a") - 1e-6)
        & (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least("at_a", "at_b") >= enough))


def unlinked(sets: DataFrame, least: float = ALIKE) -> DataFrame:
    """(a, b) of all sets in different classes that can have a similarity of ``least``; rows of (least, n, prefix, root).

    What two such sets have in common stands from the first place on where they
    meet. It stands in both prefixes, but for what stands behind one of them. So
    they meet as often as that leaves.
    """
    pairs = meetings(sets, least).groupBy("least_a", "least_b", "n_a", "n_b").agg(
        F.count("*").alias("both"), F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    least, half = least_alike(least)
    enough = half * (F.col("n_a") + F.col("n_b")) - 1e-6
    pairs = pairs.where(
        (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= enough)
        & (F.col("both") + F.greatest(F.ceil(least * F.col("n_a")), own_share(F.col("n_b"), half)) - 1 >= enough))
    return pairs.select(F.greatest("least_a", "least_b").alias("a"), F.least("least_a", "least_b").alias("b"))


def near_copies(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links reach: those of equal sets of shingles, and of sets with a similarity of ``ALIKE``.

    Most links come from candidates within RADIUS of each other's fingerprint in
    the Gray index, and each set with the first one in each of its bands. Longer
    bands hold closer copies, so that those unlike the first of a short one meet
    each other. No band's pairs are made. These find classes, but not all links:
    so all sets still in different classes that share a shingle of their prefixes
    follow (``unlinked``), which leaves out no pair that can be a link. All
    candidates are compared exactly before they are linked.
    """
    rows = staged(banded(docs, size), "bands")
    first = staged(rows.groupBy("same").agg(F.min("doc_id").alias("least"), F.min_by(F.struct("fp", "keys"), "doc_id").alias("of")).select("same", "least", "of.*"), "sets")
    keys = first.select("least", F.explode("keys").alias("key"))
    heads = keys.groupBy("key").agg(F.min("least").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    found = keys.join(heads, "key").where("least > b").select(F.col("least").alias("a"), "b")
    classes = first.groupBy("fp").agg(F.min("least").alias("b"))
    found = found.union(first.join(classes, "fp").where("least > b").select(F.col("least").alias("a"), "b"))
    near = links(grouped(classes.select("fp"))).join(classes.select(F.col("fp").alias("a"), F.col("b").alias("one")), "a").join(
        classes.select(F.col("fp").alias("b"), F.col("b").alias("other")), "b")
    found = found.union(near.select(F.greatest("one", "other"), F.least("one", "other")))
    roots = components(compared(docs, size, found))
    of_set = first.select("same", "least").join(roots.select(F.col("a").alias("least"), F.col("b").alias("root")), "least", "left").select(
        "same", "least", F.coalesce("root", "least").alias("root"))
    sets = of_set.join(rows.select("same", F.col("doc_id").alias("least"), "n", "prefix"), ["same", "least"]).select("least", "root", "n", "prefix")
    release(docs.sparkSession)
    more = compared(docs, size, unlinked(sets))
    roots = components(roots.union(more)).select(F.col("a").alias("least"), F.col("b").alias("root"))
    return rows.join(first.select("same", "least"), "same").join(roots, "least", "left").select(
        "doc_id", F.coalesce("root", "least").alias("component_id"))


def representatives(docs: DataFrame, size: int = 5) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id (a null one last), with its own columns."""
    rows = keyed(docs)
    found = near_copies(rows.select(F.col("row").alias("doc_id"), "text"), size).withColumnRenamed("doc_id", "row")
    first = rows.select("row", "doc_id").join(found, "row").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("first.row")
    return rows.join(first, "row", "left_semi").select(*unpacked(docs.columns, text=F.col("text")))
