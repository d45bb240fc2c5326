"""Document quality by the votes of labelled neighbours in a latent-semantic space.

Texts become TF-IDF vectors of hashed features: words, the shapes of words (runs
of letters and digits drawn together), words that repeat the one before, and the
text's length by powers of 2. The inverse document frequencies come from all
documents. A randomised singular value decomposition of a bounded sample of
labelled documents gives the latent directions; their vectors and labels are
broadcast (``SAMPLE`` x ``DIMENSIONS`` numbers). Every document gets its exact
cosines with all of them, block by block; the ``NEIGHBOURS`` nearest vote with
their similarity as the weight.

Defined cases: a null text is an empty one, and has only a length; labels that
are null teach nothing; repeated rows are scored each; equal similarities are
taken in the sample's order; without labels the score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.columns import id_and_text
from tagtide.llm.words import LOWER, Words, slices

#: The bound of the sample that the classifier is fitted on: labelled rows with the smallest hashes of their ids
#: (of several labels of one document, the largest).
SAMPLE = 4096
DIMENSIONS, NEIGHBOURS = 32, 15
HASHED, SHAPES = 2048, 1024  # features of words and of shapes
REPEAT = HASHED + SHAPES
LENGTH = REPEAT + 1
FEATURES = LENGTH + 40
#: Weights of the families of features, each of length 1 before.
WEIGHTS = {"words": 0.3, "shapes": 1.0, "repeat": 1.0, "length": 0.5}
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91], _SHAPE[48:58] = ord("A"), ord("0")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of some texts, sorted by text and feature."""
    n = len(words.bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(words.bounds))
    low = Words(LOWER[words.data], words.offsets)
    shape = _SHAPE[words.data]
    keep = np.ones(len(shape), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~np.isin(shape[1:], np.frombuffer(b"aA0", np.uint8))
    keep[words.starts] = True
    shapes = Words(shape[keep], np.concatenate([[0], np.cumsum(keep)])[words.offsets])
    again = np.flatnonzero((low.keys[1:] == low.keys[:-1]) & (doc[1:] == doc[:-1])) + 1
    sizes = np.diff(words.bounds)
    parts = [
        (doc, (low.keys % np.uint64(HASHED)).astype(np.int64)), (doc, HASHED + (shapes.keys % np.uint64(SHAPES)).astype(np.int64)),
        (doc[again], np.full(len(again), REPEAT)), (np.arange(n), LENGTH + np.log2(sizes + 1).astype(np.int64)),
    ]
    key, count = np.unique(np.concatenate([d * FEATURES + f for d, f in parts]), return_counts=True)
    return key // FEATURES, key % FEATURES, count


def weighted(doc: np.ndarray, feature: np.ndarray, count: np.ndarray, sizes: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Values of TF-IDF vectors, each family scaled to its weight."""
    value = (1 + np.log(count)) * idf[feature]
    family = np.digitize(feature, [HASHED, REPEAT, LENGTH])
    norm = np.sqrt(np.bincount(doc * 4 + family, value * value, 4 * len(sizes)))[doc * 4 + family]
    value = value / np.maximum(norm, 1e-12) * np.array([WEIGHTS[k] for k in ("words", "shapes", "repeat", "length")])[family]
    repeats = feature == REPEAT  # its share of the words says more than that it occurs
    value[repeats] = np.sqrt(count[repeats] / np.maximum(1, sizes[doc[repeats]]))
    return value


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; over all rows."""

    def count(batches):
        n, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for first, stop, words in slices(batch.column(0), lower=False):
                n += np.bincount(features(words)[1], minlength=FEATURES)
                total += stop - first
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], ["feature", "n"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "feature long, n long")
    found = {r["feature"]: r["n"] for r in rows.groupBy("feature").agg(F.sum("n").alias("n")).collect()}  # FEATURES rows at most
    n = np.zeros(FEATURES, np.int64)
    for k, v in found.items():
        if k >= 0:
            n[k] = v
    return n, found.get(-1, 0)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple:
    """(idf, directions, unit vectors of the sample, their labels)."""
    n, total = document_frequencies(docs)
    idf = np.log((total + 1) / (n + 1)) + 1
    rows = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "y").orderBy("h", "doc_id").limit(SAMPLE)
    # SAMPLE rows at most, so texts stay where they are.
    sample = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("h", "doc_id", "text", "y")

    def vectors(batches):
        for batch in batches:
            for first, stop, words in slices(batch.column(2), lower=False):
                doc, feature, count = features(words)
                value = weighted(doc, feature, count, np.diff(words.bounds), idf).astype(np.float32)
                cut = np.searchsorted(doc, np.arange(1, stop - first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:stop], batch.column(1)[first:stop], batch.column(3)[first:stop],
                     pa.array(np.split(feature.astype(np.int32), cut), pa.list_(pa.int32())), pa.array(np.split(value, cut), pa.list_(pa.float32()))],
                    ["h", "doc_id", "y", "at", "value"])

    some = sample.mapInArrow(vectors, "h long, doc_id long, y int, at array<int>, value array<float>")
    found = some.orderBy("h", "doc_id", "y").limit(SAMPLE).toPandas()
    matrix = np.zeros((len(found), FEATURES), np.float32)
    for k, (at, value) in enumerate(zip(found["at"], found["value"], strict=True)):
        matrix[k, at] = value
    if not len(found):
        return idf, np.zeros((FEATURES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0)
    random = np.random.default_rng(11).standard_normal((FEATURES, DIMENSIONS + 8)).astype(np.float32)
    basis = matrix @ random
    for _ in range(2):
        basis, _ = np.linalg.qr(basis)
        basis = matrix @ (matrix.T @ basis)
    basis, _ = np.linalg.qr(basis)
    directions = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:DIMENSIONS].T.astype(np.float32)
    return idf, directions, _unit(matrix @ directions), found["y"].to_numpy(float)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def votes(vectors: np.ndarray, sample: np.ndarray, labels: np.ndarray, block: int = 512) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest of the sample, from exact cosines."""
    out = np.full(len(vectors), 0.5)
    if not len(labels):
        return out
    k = min(NEIGHBOURS, len(labels))
    for a in range(0, len(vectors), block):
        cosine = vectors[a : a + block] @ sample.T
        least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        more, tied = cosine > least, cosine == least
        # Of those as similar as the last one taken, the first in the sample's order.
        taken = more | (tied & (np.cumsum(tied, axis=1) <= k - more.sum(1, keepdims=True)))
        near = np.nonzero(taken)[1].reshape(len(cosine), k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(float) ** 8
        out[a : a + block] = (weight * labels[near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def classified(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        idf, directions, sample, labels = shared.value
        for batch in batches:
            scores = []
            for first, stop, words in slices(batch.column(1), lower=False):
                doc, feature, count = features(words)
                value = weighted(doc, feature, count, np.diff(words.bounds), idf).astype(np.float32)
                starts = np.searchsorted(doc, np.arange(stop - first))  # every text has a length at least
                vectors = np.add.reduceat(directions[feature] * value[:, None], starts, axis=0)
                scores.append(votes(_unit(vectors), sample, labels))
            scores = np.concatenate([*scores, np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int")
