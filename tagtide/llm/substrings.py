"""Repeated substrings of a corpus, found with suffix arrays of shards, and their removal.

A string of ``length`` bytes that starts at two places or more is a repeat. So
that equal strings meet in one shard, each string (window) is named by the least
hash of the short grams inside it: equal windows have equal names. Neighbouring
windows of one name form a segment. Segments whose name comes from a single
place hold no place hold no repeat and go. Equal segments are folded into one that stands for
several; each is cut out of the texts once and dealt to a shard by name, and every
shard builds a suffix array by induced sorting: a window is a repeat if its
segment stands for several or its neighbour in order shares ``length`` bytes with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtide.llm.columns import DOC, keyed
from tagtide.llm.rawtext import binary, parts
from tagtide.llm.staging import release, staged
from tagtide.llm.suffixes import common_prefixes, suffix_array
from tagtide.llm.words import mixed, ragged

LENGTH = 200
#: Bytes of the grams whose least hash names a window.
GRAM = 24
#: Windows of a segment at most; a longer run of one name goes on in the next segment.
WINDOWS = 256
#: Bytes of a shard's string; a name's segments stay together.
SHARD = 1 << 19
#: Different segments of one name that are sorted together, some 1.2 MB. The windows of a fuller name are counted one by one.
CROWD = 4096

_U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_SEGMENT = "row long, start int, windows int, tied boolean, name long, content long"
_PLACE_BITS = 20
_PLACE = _U((1 << _PLACE_BITS) - 1)


class Hashes:
    """Polynomial hashes modulo 2^64 of any stretch of some bytes."""

    def __init__(self, data: np.ndarray, base: int):
        self.down = np.full(len(data) + 1, pow(base, -1, 1 << 64), _U)
        self.down[0] = 1
        np.cumprod(self.down, dtype=_U, out=self.down)
        up = np.full(len(data), base, _U)
        up[:1] = 1
        np.cumprod(up, dtype=_U, out=up)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(up * data, dtype=_U, out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mixed((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(_U) * _U(_BASES[1]))

    def grams(self, size: int) -> np.ndarray:
        """Of every stretch of ``size`` bytes."""
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    reach, known = values, 1
    while 2 * known <= width:
        reach, known = np.minimum(reach[:-known], reach[known:]), 2 * known
    return np.minimum(reach[: len(values) - width + 1], reach[width - known :][: len(values) - width + 1])


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start in it, windows, whether its name comes from two places in it, name, content) of the segments of some texts."""
    gram = min(GRAM, length)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    at = ragged(offsets[:-1], counts)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    grams = Hashes(data, _BASES[0]).grams(gram)
    # The low bits hold the place, so that the least hash tells where it comes from; names are the bits above.
    grams = (grams & ~_PLACE) | (np.arange(len(grams), dtype=_U) & _PLACE)
    found = least(grams, length - gram + 1)[at]
    moved = np.zeros(len(at), bool)
    moved[1:] = found[1:] != found[:-1]
    names = (found >> _U(_PLACE_BITS)).view(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = names[1:] != names[:-1]
    fresh[(np.cumsum(counts) - counts)[counts > 0]] = True
    place = np.arange(len(at))
    fresh |= (place - np.maximum.accumulate(np.where(fresh, place, 0))) % WINDOWS == 0
    first = np.flatnonzero(fresh)
    behind = np.append(first[1:], len(at))
    moves = np.cumsum(moved)
    starts = at[first]
    text = np.searchsorted(offsets, starts, "right") - 1
    content = Hashes(data, _BASES[1]).of(starts, starts + (behind - first) + length - 1)
    return text, starts - offsets[text], behind - first, moves[behind - 1] > moves[first], names[first], content.view(np.int64)


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, rows in parts(batch.column("text"), batch.column("row").to_numpy()):
                text, start, windows, tied, name, content = segments(data, offsets, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[text]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)),
                     pa.array(tied.astype(bool)), pa.array(name), pa.array(content)],
                    names=["row", "start", "windows", "tied", "name", "content"])

    return run


def repeats(data: np.ndarray, offsets: np.ndarray, several: np.ndarray, length: int) -> np.ndarray:
    """Which places of the pieces' bytes start a string of ``length`` bytes, inside its piece, that starts elsewhere too.

    ``several`` marks the pieces that stand for more than one of the same bytes.
    """
    sizes = np.diff(offsets)
    text = np.ones(len(data) + len(sizes) + 1, np.uint16)  # 1 behind every piece, 0 at the end
    text[-1] = 0
    ends = np.cumsum(sizes + 1)
    inside = ragged(ends - sizes - 1, sizes)
    text[inside] = data.astype(np.uint16) + 2
    before, shared = common_prefixes(text, suffix_array(text))
    close = np.flatnonzero(shared >= length)
    found = np.zeros(len(text), bool)
    found[close] = True
    found[before[close]] = True
    last = np.repeat(ends - length, sizes)  # behind the last start with the whole string inside its piece
    return (found[inside] | np.repeat(several, sizes)) & (inside < last)


def _found(length: int):
    """Runs of repeated windows of every segment; a name's rows come together."""

    def runs(table: pa.Table) -> pa.RecordBatch:
        column = table.column("piece").combine_chunks().cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]]
        names, contents, several = (table.column(c).to_numpy() for c in ("name", "content", "several"))
        offsets = at - at[0]
        steps = np.diff(repeats(data, offsets, several.astype(bool), length).astype(np.int8), prepend=0, append=0)
        first, behind = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
        piece = np.searchsorted(offsets, first, "right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(names[piece]), pa.array(contents[piece]), pa.array((first - offsets[piece]).astype(np.int32)),
             pa.array((behind - offsets[piece]).astype(np.int32))], names=["name", "content", "first", "behind"])

    def shards(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = table.column("name").to_numpy()
        turns = np.append(np.flatnonzero(np.diff(names)) + 1, len(names))
        size = np.cumsum(pa.compute.binary_length(table.column("piece")).to_numpy())
        done = 0
        while done < len(names):
            base = size[done - 1] if done else 0
            stop = int(turns[min(np.searchsorted(size[turns - 1], base + SHARD), len(turns) - 1)])
            yield runs(table.slice(done, stop - done))
            done = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            turns = np.flatnonzero(np.diff(held.column("name").to_numpy())) + 1
            if len(turns) and held.nbytes >= SHARD:
                yield from shards(held.slice(0, turns[-1]))
                held = held.slice(turns[-1]).combine_chunks()
        if held is not None and len(held):
            yield from shards(held)

    return run


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            beside = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("name", "content", "several"))
            for data, offsets, names, contents, several in parts(batch.column("piece"), *beside):
                counts = np.diff(offsets) - length + 1
                at = ragged(offsets[:-1], counts)
                of = np.repeat(np.arange(len(counts)), counts)
                both = [pa.array(Hashes(data, base).of(at, at + length).view(np.int64)) for base in _BASES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[of]), pa.array(contents[of]), pa.array((at - offsets[of]).astype(np.int32)),
                     pa.array(several[of].astype(np.int32) + 1), *both], names=["name", "content", "first", "times", "one", "two"])

    return run


_RUNS = "name long, content long, first int, behind int"


def repeated_runs(texts: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(segments with a shared name, runs of repeated windows of each different segment) of texts (row, text).

    Names are counted first. Of a name that comes from two places or more, equal
    segments are folded and one of each goes to the name's shard. A name with over
    ``CROWD`` different segments (the edge of a passage that a third of the corpus
    quotes) would fill a shard: its windows are counted one by one by two hashes
    of all their bytes instead, added up before the shuffle.
    """
    spark = texts.sparkSession
    found = staged(texts.mapInArrow(_segments(length), _SEGMENT), "segments")
    shared = found.groupBy("name").agg(F.sum(F.when(F.col("tied"), 2).otherwise(1)).alias("places")).filter("places > 1").select("name")
    held = staged(found.drop("tied").join(shared, "name", "left_semi"), "held")
    release(spark)
    folded = held.groupBy("name", "content").agg(F.min(F.struct("row", "start", "windows")).alias("p"), F.count("*").alias("n"))
    crowd = folded.groupBy("name").count().filter(F.col("count") > CROWD).select("name", F.lit(True).alias("crowded"))
    by_row = folded.join(crowd, "name", "left").groupBy(F.col("p.row").alias("row")).agg(F.collect_list(F.struct(
        "name", "content", (F.col("n") > 1).alias("several"), F.coalesce("crowded", F.lit(False)).alias("crowded"), "p.start", "p.windows",
    )).alias("wanted"))
    cut = F.transform("wanted", lambda w: F.struct(
        w["name"].alias("name"), w["content"].alias("content"), w["several"].alias("several"), w["crowded"].alias("crowded"),
        F.substring(F.col("text"), w["start"] + 1, w["windows"] + (length - 1)).alias("piece")))
    pieces = staged(texts.join(by_row, "row").select(F.explode(cut).alias("c")).select("c.*"), "pieces")
    release(spark)
    columns = ["name", "content", "several", "piece"]
    sorted_runs = (
        pieces.filter(~F.col("crowded")).select(*columns).repartition("name").sortWithinPartitions("name")
        .mapInArrow(_found(length), _RUNS))
    crowded = pieces.filter("crowded").select(*columns).mapInArrow(
        _windows(length), "name long, content long, first int, times int, one long, two long")
    often = crowded.groupBy("name", "one", "two").agg(F.sum("times").alias("times")).filter("times > 1").select("name", "one", "two")
    counted = crowded.join(often, ["name", "one", "two"], "left_semi").select(
        "name", "content", "first", (F.col("first") + 1).alias("behind")).distinct()
    runs = staged(sorted_runs.unionByName(counted), "runs")
    release(spark)
    return held, runs


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_columns = [DOC]
    for batch in batches:
        spans = batch.column("spans")
        bounds = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy(zero_copy_only=False))])
        flat = spans.flatten()
        first, behind = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        done = 0
        for data, offsets, _ in parts(batch.column("text"), np.arange(batch.num_rows)):
            rows = len(offsets) - 1
            a, b = int(bounds[done]), int(bounds[done + rows])
            base = np.repeat(offsets[:-1], np.diff(bounds[done : done + rows + 1]))
            steps = np.zeros(len(data) + 1, np.int64)
            np.add.at(steps, base + first[a:b], 1)
            np.add.at(steps, base + behind[a:b], -1)
            gone = np.cumsum(steps[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[offsets[:-1][offsets[:-1] < len(data)]] |= gone[offsets[:-1][offsets[:-1] < len(data)]]
            lost = np.concatenate([[0], np.cumsum(gone)])[offsets]
            begun = np.concatenate([[0], np.cumsum(opens)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(done, rows) for c in kept_columns), pa.array(np.diff(offsets)), pa.array(np.diff(lost)),
                 pa.array(np.diff(begun)), binary(data[~gone], offsets - lost)],
                names=[*kept_columns, "n_bytes", "n_removed", "n_spans", "kept"])
            done += rows


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_doc, n_bytes, n_removed, n_spans, kept) of every row, ``kept`` being the bytes that no repeat covers.

    A repeat is a string of ``length`` bytes that starts at two places or more of
    the texts, of one text too, overlaps included; all its places are removed,
    as judged on the texts as they came. A null text is empty; a text shorter
    than ``length`` keeps all; equal texts lose all if they are long enough.
    ``_doc`` holds the other columns. Empty tables give empty ones.
    """
    rows = keyed(docs)
    texts = rows.select("row", F.col("text").cast("binary").alias("text"))
    held, runs = repeated_runs(texts, length)
    span = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("behind") + (length - 1)).alias("behind"))
    spans = held.join(runs, ["name", "content"]).groupBy("row").agg(F.collect_list(span).alias("spans"))
    joined = rows.select(DOC, "row", F.col("text").cast("binary").alias("text")).join(spans, "row", "left").select(DOC, "text", "spans")
    return joined.mapInArrow(_without, T.StructType([
        joined.schema[DOC], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
        T.StructField("kept", T.BinaryType())]))
