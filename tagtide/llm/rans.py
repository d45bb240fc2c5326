"""Token ids in files of independent blocks, coded by a static range asymmetric numeral system.

A folder holds one table of symbol frequencies (all blocks share it) and blocks.
A block has whole documents, in ascending order of doc_id over the blocks in
order of (shard, block). Its ids are coded in interleaved lanes: id i goes to
lane i mod ``lanes``. States are 64 bits wide and give up 32 bits at a time.
Checkpoints hold all lanes' states and the place in the words every ``every``
rows of lanes, so parts of one block decode side by side; a checksum covers each
block, and the table's checksum is in it. Blocks are binary values in Parquet,
which Spark writes to and reads from any store.

Defined cases: a null or empty text is its end id alone; repeated rows are coded
each; an empty table gives a folder without blocks; a document is never split,
so a block may be longer than ``block_ids``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tagtide.llm.staging import staged
from tagtide.llm.tokens import encoder

BITS = 20  # the frequencies' sum, as a power of 2
LOW = np.uint64(1 << 31)
MAGIC = b"TTRANS01"
_HEAD = struct.Struct("<8sIIIIIIII")  # magic, table's checksum, lanes, every, documents, ids, checkpoints, words, checksum of the rest


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Whole-number shares of 2^bits, at least 1 for a symbol that occurs; the commonest takes up the rest."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    share = np.where(counts > 0, np.maximum(1, (counts.astype(np.float64) * (1 << bits) / total).astype(np.int64)), 0)
    order = np.argsort(-share, kind="stable")
    rest = (1 << bits) - int(share.sum())
    for k in order if rest < 0 else order[:1]:
        change = max(rest, 1 - int(share[k]))
        share[k] += change
        rest -= change
        if not rest:
            break
    if rest:
        raise ValueError("more symbols than shares")
    return share


class Coder:
    """Codes and decodes blocks by one table of frequencies."""

    def __init__(self, share: np.ndarray, bits: int = BITS):
        self.bits, self.digest = np.uint64(bits), zlib.crc32(share.astype("<u4").tobytes())
        self.share = share.astype(np.uint64)
        self.base = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64)
        self.limit = self.share << np.uint64(63 - bits)
        self.symbols = np.repeat(np.arange(len(share), dtype=np.uint32), share)

    def encode(self, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray, lanes: int, every: int) -> bytes:
        rows = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        chunks, checkpoints, words = [], [], 0
        share, base, limit = self.share[ids], self.base[ids], self.limit[ids]
        low32, half = np.uint64(0xFFFFFFFF), np.uint64(32)
        for row in range(rows - 1, -1, -1):
            a, b = row * lanes, min((row + 1) * lanes, len(ids))
            x, f = state[: b - a], share[a:b]
            full = x >= limit[a:b]
            if full.any():
                out = (x[full] & low32).astype("<u4")
                chunks.append(out)
                words += len(out)
                x = np.where(full, x >> half, x)
            whole, part = np.divmod(x, f)
            state[: b - a] = (whole << self.bits) + part + base[a:b]
            if row % every == 0:
                checkpoints.append((row, words, state.astype("<u8").tobytes()))
        chunks.reverse()
        points = b"".join(struct.pack("<II", row, words - done) + states for row, done, states in reversed(checkpoints))
        known = np.array([d is not None for d in docs], np.uint8).tobytes()
        body = b"".join([
            np.array([d or 0 for d in docs], "<i8").tobytes(), known, sizes.astype("<u4").tobytes(), points, *(c.tobytes() for c in chunks),
        ])
        return _HEAD.pack(MAGIC, self.digest, lanes, every, len(docs), len(ids), len(checkpoints), words, zlib.crc32(body)) + body

    def decode(self, block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
        """(doc_ids, number of ids of each, all ids)."""
        docs, sizes, points, words, lanes, n = self._open(block)
        ids = np.empty(n, np.uint32)
        rows = -(-n // lanes)
        for k, (row, at, states) in enumerate(points):  # each of these could be its own task
            self._decode_rows(ids, row, points[k + 1][0] if k + 1 < len(points) else rows, at, states, words, lanes)
        return docs, sizes, ids

    def decode_part(self, block: bytes, k: int) -> tuple[int, np.ndarray]:
        """(first position, ids) from checkpoint k to the next, without the rest of the block."""
        _, _, points, words, lanes, n = self._open(block)
        row, at, states = points[k]
        stop = points[k + 1][0] if k + 1 < len(points) else -(-n // lanes)
        ids = np.empty(n, np.uint32)
        self._decode_rows(ids, row, stop, at, states, words, lanes)
        return row * lanes, ids[row * lanes : stop * lanes]

    def _open(self, block: bytes):
        magic, digest, lanes, _, n_docs, n, n_points, n_words, check = _HEAD.unpack_from(block)
        body = memoryview(block)[_HEAD.size :]
        if magic != MAGIC or digest != self.digest or zlib.crc32(body) != check:
            raise ValueError("a damaged block, or another table's")
        docs = np.frombuffer(body, "<i8", n_docs)
        known = np.frombuffer(body, np.uint8, n_docs, 8 * n_docs)
        sizes = np.frombuffer(body, "<u4", n_docs, 9 * n_docs)
        at, points = 13 * n_docs, []
        for _ in range(n_points):
            row, done = struct.unpack_from("<II", body, at)
            points.append((row, done, np.frombuffer(body, "<u8", lanes, at + 8).astype(np.uint64)))
            at += 8 + 8 * lanes
        words = np.frombuffer(body, "<u4", n_words, at)
        return [d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)], sizes, points, words, lanes, n

    def _decode_rows(self, ids, row, stop, at, states, words, lanes) -> None:
        state, mask, half = states.copy(), np.uint64((1 << int(self.bits)) - 1), np.uint64(32)
        for r in range(row, stop):
            a, b = r * lanes, min((r + 1) * lanes, len(ids))
            x = state[: b - a]
            slot = x & mask
            symbol = self.symbols[slot]
            x = self.share[symbol] * (x >> self.bits) + slot - self.base[symbol]
            need = np.flatnonzero(x < LOW)
            if len(need):
                x[need] = (x[need] << half) | words[at : at + len(need)].astype(np.uint64)
                at += len(need)
            state[: b - a] = x
            ids[a:b] = symbol


def encoded(docs: DataFrame, path: str, end: int, bounds: np.ndarray) -> DataFrame:
    """doc_id, its ids (little-endian, 16 bits where the vocabulary allows, else 32) with the end id, and its shard.

    ``bounds`` part doc_ids into shards: in ascending order, a null doc_id first.
    """

    def tokens(batches):
        use = encoder(path)
        kind = "<u2" if use.size <= 1 << 16 else "<u4"
        for batch in batches:
            values = []
            for _, _, ids, at in use.encode(batch.column(1), end):
                ids = ids.astype(kind)
                values += [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            shard = np.where(known, 1 + np.searchsorted(bounds, batch.column(0).fill_null(0).to_numpy(), "right"), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.binary()), pa.array(shard.astype(np.int32))], ["doc_id", "ids", "shard"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        tokens, "doc_id long, ids binary, shard int")


def write(docs: DataFrame, folder: str, path: str, end: int = 2, lanes: int = 1024, every: int = 64, block_ids: int = 1 << 18) -> None:
    """Encodes every text and writes ``folder``/table and ``folder``/blocks, in ascending order of doc_id."""
    spark = docs.sparkSession
    size = encoder(path).size
    kind = "<u2" if size <= 1 << 16 else "<u4"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / (4 * parts) for k in range(1, 4 * parts)]  # some shards a task, so tasks are even
    bounds = docs.agg(F.percentile_approx("doc_id", cuts)).first()[0] or []
    ids = staged(encoded(docs, path, end, np.unique(np.array(bounds, np.int64))), "ids")

    def count(batches):
        n = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0):
                n += np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    share = np.zeros(size, np.int64)
    for row in counts.collect():  # a row for each of the vocabulary's ids at most
        share[row["id"]] = row["n"]
    share = frequencies(share)
    table = Row(bits=BITS, path_size=size, share=share.astype("<u4").tobytes())
    spark.createDataFrame([table], "bits int, path_size int, share binary").write.parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(share)

    def blocks(batches):
        coder = Coder(shared.value)
        held, sizes, parts, n, block, shard = [], [], [], 0, 0, None

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([n], pa.int64()),
                 pa.array([coder.encode(held, np.array(sizes), np.concatenate(parts), lanes, every)], pa.binary())],
                ["shard", "block", "n_ids", "data"])

        for batch in batches:
            for doc, value, s in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if held and (n >= block_ids or s != shard):
                    yield made()
                    block = block + 1 if s == shard else 0
                    held, sizes, parts, n = [], [], [], 0
                shard = s
                got = np.frombuffer(value.as_buffer(), kind).astype(np.int64)
                held.append(doc)
                sizes.append(len(got))
                parts.append(got)
                n += len(got)
        if held:
            yield made()

    # A whole shard goes to one task: how files are split between readers doesn't matter.
    (ids.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id").select("doc_id", "ids", "shard")
     .mapInArrow(blocks, "shard int, block int, n_ids long, data binary").write.parquet(f"{folder}/blocks"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    share = np.frombuffer(spark.read.parquet(f"{folder}/table").first()["share"], "<u4").astype(np.int64)
    shared = spark.sparkContext.broadcast(share)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # Two levels: the shards' totals are few, and a shard's blocks are numbered by themselves.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    own = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("within"))
    starts = starts.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("start"))

    def decode(batches):
        coder = Coder(shared.value)
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, sizes, ids = coder.decode(data.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(sizes.astype(np.int64))
                begins = ends - sizes
                checks = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(begins + start), pa.array(sizes.astype(np.int64)), pa.array(checks, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(starts, ["shard", "block"]).select("start", "data").mapInArrow(
        decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
