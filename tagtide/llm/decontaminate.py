"""Finds benchmark items in documents, also reworded ones, by latent semantic retrieval and alignment.

Texts are words without case and ASCII punctuation, in passages of ``SPAN`` words,
one every ``STEP`` words, over whole documents. Words weigh by their inverse
frequency in the whole corpus. Passages whose words in items hold ``MASS`` of
their weight, and the items' own (weighted up, so that their directions stay),
give the latent directions: a randomised singular value decomposition whose
product with the matrix is summed in Spark, feature by feature. Every passage of
every document is then projected onto them and compared with every item's own
passages in blocks; a cosine of ``COSINE`` makes a candidate. Only passages whose
words in items weigh less than the lightest quarter of the lightest item's are
passed over, as they can hold no leak.

A candidate's surroundings are aligned with the whole item by their longest
common subsequence, unless they hold too few of its words in any order. ``COPY`` of the item's words make a leak; ``REWORDED`` of
them do if the item's answer (its own column, or its last ``ANSWER`` words) stands
there as well.

Items are taken in blocks of ``ITEMS`` items and ``WORDS`` words (or one longer
item), so what is broadcast has a bound: a block's words, a row of directions for
each feature, and a latent vector for each of its passages.

Defined cases: null or empty texts and items without words match nothing;
repeated items and rows are matched each; no documents or no items give no leaks.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.llm.columns import carried, id_and_text, unpacked, without_text
from tagtide.llm.words import KeyTable, Words, ragged, slices

SPAN, STEP = 32, 16
MASS, COSINE = 0.45, 0.6
COPY, REWORDED, ANSWER = 0.8, 0.5, 3
ITEMS, WORDS = 5_000, 250_000
FEATURES, DIMENSIONS = 8192, 192
HASHED = 1 << 20  # counters of words of the corpus
CACHED = 512  # words projected at once
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def plain(data: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, ASCII punctuation as spaces."""
    return _PLAIN[data]


def plain_words(text: bytes | None) -> Words:
    data = plain(np.frombuffer(text or b"", np.uint8))
    return Words(data, np.array([0, len(data)]))


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, number of words) of the passages of texts with the words bounds[i] to bounds[i + 1]."""
    sizes = np.diff(bounds)
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - SPAN) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[text] + k * STEP
    return text, first, np.minimum(SPAN, bounds[text + 1] - first)


def _summed(parts: DataFrame, kind) -> dict[int, np.ndarray]:
    """Sums of (key, array as bytes) rows by key, array by array, so no task holds more than its keys' sums."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = np.frombuffer(data, kind).astype(np.float64)
                sums[key] = sums[key] + value if key in sums else value
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int64()), pa.array([v.astype(kind).tobytes() for v in sums.values()], pa.binary())], ["key", "data"])

    rows = parts.repartition("key").mapInArrow(add, "key long, data binary").collect()  # a few MB: one row a key
    return {row["key"]: np.frombuffer(row["data"], kind) for row in rows}


def word_frequencies(docs: DataFrame) -> np.ndarray:
    """Occurrences of every word of the corpus, by hashed key."""
    size = 4096

    def count(batches):
        n = np.zeros(HASHED, np.int64)
        for batch in batches:
            for _, _, words in slices(batch.column(0), change=plain):
                n += np.bincount((words.keys % np.uint64(HASHED)).astype(np.int64), minlength=HASHED)
        if n.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(HASHED // size)), pa.array([n[k : k + size].tobytes() for k in range(0, HASHED, size)], pa.binary())], ["key", "data"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "key long, data binary")
    found = _summed(parts, np.int64)
    return np.concatenate([found[k] for k in range(HASHED // size)]) if found else np.zeros(HASHED, np.int64)


class Items:
    """A block of benchmark items: words, passages and weights."""

    def __init__(self, rows: list[tuple], frequencies: np.ndarray):
        total = max(1, int(frequencies.sum()))
        self.idf = np.log((total + 1.0) / (frequencies + 1.0)).astype(np.float32)
        self.ids = [row[0] for row in rows]
        words = [plain_words(row[1]) for row in rows]
        self.words = [w.keys for w in words]
        self.answers = [plain_words(row[2]).keys if row[2] is not None else w.keys[-ANSWER:] for row, w in zip(rows, words, strict=True)]
        keys = np.unique(np.concatenate([*self.words, np.zeros(0, np.uint64)]))
        self.table = KeyTable()
        self.table.add(keys)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in self.words])])
        self.owner, first, size = passages(bounds)
        flat = np.concatenate([*self.words, np.zeros(0, np.uint64)])
        feature, weight = self.features(flat)
        at = ragged(first, size)
        # The items' own passages: (passage, feature, weight) of their words.
        self.cells = np.repeat(np.arange(len(size)), size), feature[at], weight[at]
        # A leak holds half of an item's words, and some passage of it half of three quarters of a passage's:
        # the lightest quarter of the lightest passage's words is the least that it can weigh.
        squares = weight[at].astype(np.float64) ** 2
        ends = np.cumsum(size)
        self.least = min((np.sort(squares[e - n : e])[: n // 4].sum() for e, n in zip(ends, size, strict=True)), default=0.0)

    def features(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature (-1: in no item) and weight of each word."""
        feature = self.table.find(keys)
        feature = np.where(feature >= 0, feature % FEATURES, -1)
        return feature, self.idf[(keys % np.uint64(HASHED)).astype(np.int64)]

    def chosen(self, words: Words):
        """Passages that share MASS of their weight with items: (text, first word, size, words in items one after another, their passages, features and weights)."""
        text, first, size = passages(words.bounds)
        feature, weight = self.features(words.keys)
        shared = np.concatenate([[0], np.cumsum(np.where(feature >= 0, weight, 0).astype(np.float64) ** 2)])
        part = shared[first + size] - shared[first]
        square = np.concatenate([[0], np.cumsum(weight.astype(np.float64) ** 2)])
        at = np.flatnonzero(part >= MASS * np.maximum(square[first + size] - square[first], 1e-9))
        text, first, size = text[at], first[at], size[at]
        at = ragged(first, size)
        owner = np.repeat(np.arange(len(size)), size)
        inside = feature[at] >= 0
        return text, first, size, owner[inside], feature[at[inside]], weight[at[inside]]


def _projected(directions: np.ndarray, owner: np.ndarray, feature: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, directions.shape[1]), np.float32)
    if len(owner):
        which, starts = np.unique(owner, return_index=True)
        ends = np.append(starts[1:], len(owner))
        a = 0
        while a < len(which):  # about CACHED words at a time: their rows stay in the processor's cache
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + CACHED, "right")))
            part = slice(starts[a], ends[b - 1])
            out[which[a:b]] = np.add.reduceat(directions[feature[part]] * weight[part, None], starts[a:b] - starts[a], axis=0)
            a = b
    return out


def _product(docs: DataFrame, items: Items, basis: np.ndarray) -> tuple[np.ndarray, int]:
    """(A'A basis, number of rows of A), A being the chosen passages of all documents."""
    shared = docs.sparkSession.sparkContext.broadcast((items, basis))

    def multiply(batches):
        own, by = shared.value
        out, n = np.zeros_like(by), 0
        for batch in batches:
            for _, _, words in slices(batch.column(0), change=plain):
                _, _, size, owner, feature, weight = own.chosen(words)
                n += len(size)
                for a in range(0, len(size), 1024):
                    cut = slice(*np.searchsorted(owner, [a, a + 1024]))
                    o, f, w = owner[cut] - a, feature[cut], weight[cut]
                    if not len(o):
                        continue
                    y = _projected(by, o, f, w, min(1024, len(size) - a))
                    order = np.argsort(f, kind="stable")
                    which, starts = np.unique(f[order], return_index=True)
                    out[which] += np.add.reduceat(y[o[order]] * w[order][:, None], starts, axis=0)
        rows = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(rows, -1)), pa.array([*(out[k].tobytes() for k in rows), np.float32(n).tobytes()], pa.binary())], ["key", "data"])

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(multiply, "key long, data binary")
    found = _summed(parts, np.float32)  # FEATURES rows at most
    n = int(found.pop(-1, np.zeros(1))[0])
    out = np.zeros_like(basis)
    for feature, row in found.items():
        out[feature] = row
    return out, n


def latent_directions(docs: DataFrame, items: Items) -> np.ndarray:
    """Right singular vectors of the passages' matrix, the items' own passages holding half its rows' weight.

    One product with a random basis is enough: A'A is approximated from it
    (Nystroem), and that approximation's eigenvectors are the directions.
    """
    owner, feature, weight = items.cells
    count, rank = len(items.owner), min(DIMENSIONS, FEATURES)
    basis = np.linalg.qr(np.random.default_rng(5).standard_normal((FEATURES, rank + 16)))[0].astype(np.float32)
    product, n = _product(docs, items, basis)
    own = np.zeros_like(basis)
    np.add.at(own, feature, _projected(basis, owner, feature, weight, count)[owner] * weight[:, None])
    product = product.astype(np.float64) + max(1.0, n / max(1, count)) * own
    shift = 1e-6 * np.linalg.norm(product)
    product += shift * basis
    core = basis.T @ product
    values, turn = np.linalg.eigh((core + core.T) / 2)
    root = product @ (turn / np.sqrt(np.maximum(values, shift * 1e-3)))
    return np.linalg.svd(root, full_matrices=False)[0][:, :rank].astype(np.float32)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two sequences of keys, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for k, key in enumerate(a.tolist()):
        places[key] = places.get(key, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for key in b.tolist():
        if key not in places:  # changes nothing
            continue
        hit = row & places[key]
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _contains(words: np.ndarray, part: np.ndarray) -> bool:
    if not len(part) or len(part) > len(words):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(words, len(part)) == part).all(1).any())


def aligned(keys: np.ndarray, item: np.ndarray, answer: np.ndarray) -> tuple[int, bool]:
    """(common words, whether they make a leak) of an item and the words around a candidate."""
    common = common_subsequence(item, keys)
    return common, common >= COPY * len(item) or (common >= REWORDED * len(item) and _contains(keys, answer))


def may_align(keys: list[int], bag: dict[int, int], size: int) -> bool:
    """Whether an item of ``size`` words, counted in ``bag``, can have enough words in common with others, in whatever order they stand."""
    enough = min(COPY, REWORDED) * size
    inside = [key for key in keys if key in bag]
    return len(inside) >= enough and sum(min(n, bag[key]) for key, n in Counter(inside).items()) >= enough


class Search:
    """Looks for a block of items in Arrow columns of texts."""

    def __init__(self, items: Items, directions: np.ndarray):
        self.items, self.directions = items, directions
        self.bags: dict[int, dict[int, int]] = {}  # words of the items met so far; a block's words at most
        latent = _projected(directions, *items.cells, len(items.owner))
        self.targets = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def latent(self, words: Words) -> tuple[np.ndarray, ...]:
        """(text, first word, size, latent vector) of the passages that can hold a leak, some at a time.

        Passages overlap by halves of ``STEP`` words, so halves are projected and added in pairs.
        """
        feature, weight = self.items.features(words.keys)
        text, first, size = passages(words.bounds)
        shared = np.concatenate([[0], np.cumsum(np.where(feature >= 0, weight, 0).astype(np.float64) ** 2)])
        part = shared[first + size] - shared[first]
        may = (part >= self.items.least * (1 - 1e-6)) & (part > 0)
        # A passage's halves are numbered after the first words of all passages and, of a text's last one, its middle.
        last = np.append(text[1:] != text[:-1], True)
        tail = last & (size > STEP)
        begins = np.concatenate([first, first[tail] + STEP])
        lengths = np.minimum(STEP, np.concatenate([first + size, (first + size)[tail]]) - begins)
        order = np.argsort(begins)
        half = np.empty(len(begins), np.int64)
        half[order] = np.arange(len(begins))
        begins, lengths = begins[order], lengths[order]
        own = half[: len(first)]
        both = size > STEP  # the second half follows: the next passage's first one, or the tail
        for a in range(0, len(first), 1024):
            b = min(a + 1024, len(first))
            low, high = own[a], own[b - 1] + 1 + int(both[b - 1])
            at = ragged(begins[low:high], lengths[low:high])
            owner = np.repeat(np.arange(high - low), lengths[low:high])
            inside = feature[at] >= 0
            sums = _projected(self.directions, owner[inside], feature[at[inside]], weight[at[inside]], high - low)
            x = sums[own[a:b] - low]
            x[both[a:b]] += sums[own[a:b][both[a:b]] - low + 1]
            keep = np.flatnonzero(may[a:b])
            yield text[a:b][keep], first[a:b][keep], size[a:b][keep], x[keep]

    def candidates(self, words: Words):
        """(text, item, first word, size, cosine) of passages within the cosine of an item's."""
        for text, first, size, x in self.latent(words):
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            cosine = x @ self.targets.T
            near, target = np.divmod(np.flatnonzero(cosine.ravel() >= COSINE), len(self.targets))
            yield from zip(text[near].tolist(), self.items.owner[target].tolist(), first[near].tolist(), size[near].tolist(),
                           cosine[near, target].tolist(), strict=True)

    def matches(self, column: pa.Array) -> list[tuple]:
        """(row, item, common words, cosine) of the leaks in a column."""
        found: dict[tuple, tuple] = {}
        tried: set[tuple] = set()
        for row0, _, words in slices(column, change=plain):
            keys = words.keys.tolist()
            for text, item, first, size, cosine in self.candidates(words):
                if (row0 + text, item) in found or (row0 + text, item, first) in tried:
                    continue
                tried.add((row0 + text, item, first))
                own = self.items.words[item]
                low, high = words.bounds[text], words.bounds[text + 1]
                low, high = max(low, first - len(own)), min(high, first + size + len(own))
                if item not in self.bags:
                    self.bags[item] = Counter(own.tolist())
                if not may_align(keys[low:high], self.bags[item], len(own)):
                    continue
                common, leak = aligned(words.keys[low:high], own, self.items.answers[item])
                if leak:
                    found[row0 + text, item] = (common, cosine)
        return [(row, item, *value) for (row, item), value in found.items()]


def searches(docs: DataFrame, benchmark: DataFrame) -> list[Search]:
    """One for each block of items, learned from all documents."""
    answer = F.col("answer") if "answer" in benchmark.columns else F.lit(None)
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("text"), answer.cast("string").cast("binary").alias("answer"))
    blocks: list[list[tuple]] = []
    held = 0
    for row in rows.where("text IS NOT NULL").orderBy("item_id").toLocalIterator():
        if size := len(plain_words(bytes(row["text"])).keys):
            if not blocks or len(blocks[-1]) == ITEMS or held + size > WORDS:
                blocks.append([])
                held = 0
            held += size
            blocks[-1].append((row["item_id"], bytes(row["text"]), None if row["answer"] is None else bytes(row["answer"])))
    if not blocks:
        return []
    frequencies = word_frequencies(docs)
    return [Search(items, latent_directions(docs, items)) for items in (Items(block, frequencies) for block in blocks)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, common_words, item_words, cosine: every item that a document holds."""
    schema = "doc_id long, item_id long, common_words long, item_words long, cosine double"
    found = docs.sparkSession.createDataFrame([], schema)
    for search in searches(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def look(batches, shared=shared):
            own = shared.value
            for batch in batches:
                rows = own.matches(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([own.items.ids[r[1]] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([len(own.items.words[r[1]]) for r in rows], pa.int64()),
                     pa.array([float(r[3]) for r in rows], pa.float64())],
                    ["doc_id", "item_id", "common_words", "item_words", "cosine"])

        found = found.union(id_and_text(docs).mapInArrow(look, schema))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold an item, with their own columns. Rows are judged where they are, so nothing is shuffled."""
    out = carried(docs, "text", own=without_text(docs)).withColumn("text", F.col("text").cast("binary"))
    for search in searches(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(search)

        def sift(batches, shared=shared):
            own = shared.value
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, *_ in own.matches(batch.column(1))]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(sift, out.schema)
    return out.select(*unpacked(docs.columns, text=F.col("text").cast("string")))
