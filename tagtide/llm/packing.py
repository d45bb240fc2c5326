"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

Pieces of one length are alike, so the bins are planned from the counts by
length alone: at most ``capacity`` numbers on the driver, whatever the corpus.
The plan says how often each pattern of lengths is used; every piece then finds
its place from its rank among the pieces of its length.

Defined cases: an empty table packs into nothing; a length below 1, above the
capacity or null is an error; repeated rows are separate pieces; equal lengths
are ranked by their keys.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtide.llm.staging import staged
from tagtide.llm.tokens import encoder

#: Pieces ranked in one group, about. More pieces make more groups.
GROUP = 50_000
LEAST_GROUPS = 256


def token_pieces(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """Whole texts as ids and an end id, cut into pieces where they are longer than a sequence.

    One row per piece: doc_id, piece, start, length, ids_crc32. A null or empty
    text is the end id alone.
    """

    def cut(batches):
        encode = encoder(path).encode
        for batch in batches:
            rows: list[tuple] = []
            ids_of = batch.column(0)
            for first, stop, ids, bounds in encode(batch.column(1), end):
                ids = ids.astype("<u4")
                for k in range(stop - first):
                    a, b = int(bounds[k]), int(bounds[k + 1])
                    doc = ids_of[first + k].as_py()
                    for piece, at in enumerate(range(a, b, capacity)):
                        part = ids[at : min(at + capacity, b)]
                        rows.append((doc, piece, at - a, len(part), zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], ids_of.type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many bins, the lengths in each of them), from the number of pieces of each length."""
    left = {length: n for length, n in counts.items() if n}
    lengths = sorted(left)
    out = []
    while lengths:
        gap, used = capacity, Counter()
        k = len(lengths)
        while gap and (k := bisect_right(lengths, gap, 0, k)):  # greedily: the longest that fits
            k -= 1
            n = min(left[lengths[k]], gap // lengths[k])
            used[lengths[k]] += n
            gap -= n * lengths[k]
        if gap:
            least = min(used)
            pair = _tightest_pair(lengths, left, used, gap + least)
            if sum(pair) > least:
                used[least] -= 1
                used.update(pair)
                used = +used
        times = min(left[length] // n for length, n in used.items())
        out.append((times, sorted(used.elements(), reverse=True)))
        for length, n in used.items():
            left[length] -= n * times
            if not left[length]:
                del left[length], lengths[bisect_left(lengths, length)]
    return out


def _tightest_pair(lengths: list[int], left: dict[int, int], used: Counter, room: int) -> tuple[int, ...]:
    """Two unpacked lengths of the largest sum within the room."""
    best: tuple[int, ...] = ()
    total, low, high = 0, 0, bisect_left(lengths, room) - 1
    while low <= high and total < room:
        a, b = lengths[low], lengths[high]
        if left[b] - used[b] < 1:
            high -= 1
        elif a + b > room:
            high -= 1
        elif left[a] - used[a] < 1 + (a == b):
            low += 1
        else:
            if a + b > total:
                best, total = (a, b), a + b
            low += 1
    return best


def places(bins: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by ranges of their ranks: sorted by length and first rank."""
    seen, rows, sequence = Counter(), [], 0
    for times, lengths in bins:
        offset = 0
        for length in lengths:
            rows.append((length, seen[length], sequence, offset))
            seen[length] += times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 40) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def ranked(pieces: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Adds each piece's rank among those of its length, counted in salted groups."""
    groups = max(LEAST_GROUPS, rows // GROUP)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys)) - 1
    return (
        salted.withColumn("_within", within).join(base, ["length", "_salt"])
        .withColumn("_rank", F.col("_base") + F.col("_within")).drop("_salt", "_base", "_within")
    )


def pack(pieces: DataFrame, keys: list[str], capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces with a length; ``keys`` tell pieces apart."""
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    wrong = [length for length in counts if length is None or not 1 <= length <= capacity]
    if wrong:
        raise ValueError(f"lengths outside 1 to {capacity}: {wrong[:5]}")
    table = pieces.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    ranks = ranked(pieces, keys, sum(counts.values()))
    out = pieces.schema.fieldNames()

    def place(batches):
        at = table.value
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            row = np.searchsorted(at["key"], (batch.column("length").to_numpy() << 40) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in out), pa.array(at["sequence"][row] + rank - at["rank"][row]), pa.array(at["offset"][row])],
                [*out, "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranks.select(*out, F.col("_rank").cast("long")).mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Every document's pieces with their sequence and their place in it."""
    return pack(staged(token_pieces(docs, path, capacity, end), "pieces"), ["doc_id", "piece"], capacity)
