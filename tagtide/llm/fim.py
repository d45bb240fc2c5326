"""Fill-in-the-middle transformation by displacement scatter, and its inverse.

Every byte of a batch goes to its old place plus a displacement. Displacements
change at the start of a text and at its two cuts only, so they are written as
differences at these places and summed up once; one numpy scatter then builds
all outputs of a batch, and one gather takes them apart again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagtide.llm.columns import DOC, carried, without_text
from tagtide.llm.rawtext import binary, parts

#: What stands before prefix, suffix and middle. All have the same size and no two overlap.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_SIZE = 3
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]

_OUT = [
    T.StructField("output", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
]


def marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the three markers in the bytes, none of them across the end of a row; by place, with kind and row."""
    if len(data) < _SIZE:
        none = np.zeros(0, np.int64)
        return none, none, none
    open_, close = data[:-2] == PREFIX[0], data[2:] == PREFIX[2]
    at = np.flatnonzero(open_ & close)
    kind = np.full(len(at), -1)
    for k, mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
        kind[data[at + 1] == mark[1]] = k
    row = np.searchsorted(offsets, at, "right") - 1
    real = (kind >= 0) & (at + _SIZE <= offsets[row + 1])
    return at[real], kind[real], row[real]


def shifts(size: int, places: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """The displacement of each of ``size`` bytes: ``values[k]`` holds from ``places[k]`` to the next place of its row."""
    steps = np.zeros(size + 1, np.int64)
    flat = np.stack(values, 1).ravel()  # rows in order, each with its places in order
    np.add.at(steps, np.stack(places, 1).ravel(), np.diff(flat, prepend=0))
    return np.cumsum(steps[:size])


def scattered(
    data: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, form: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Outputs (bytes, offsets) of texts whose prefix ends at ``a`` and whose middle ends at ``b`` (places in ``data``)."""
    start, end = offsets[:-1], offsets[1:]
    marked = form != PLAIN
    into = np.concatenate([[0], np.cumsum(end - start + 3 * _SIZE * marked)])
    base = into[:-1] - start
    prefix, middle, suffix = a - start, b - a, end - b
    spm = form == SPM
    to_prefix = base + np.where(spm, 2 * _SIZE + suffix, _SIZE) * marked
    to_middle = base + (3 * _SIZE + suffix) * marked
    to_suffix = base + np.where(spm, _SIZE - prefix - middle, 2 * _SIZE - middle) * marked
    out = np.empty(int(into[-1]), np.uint8)
    out[np.arange(len(data)) + shifts(len(data), [start, a, b], [to_prefix, to_middle, to_suffix])] = data
    for mark, before in ((PREFIX, start + to_prefix), (SUFFIX, b + to_suffix), (MIDDLE, a + to_middle)):
        for k, byte in enumerate(mark):
            out[before[marked] - _SIZE + k] = byte
    return out, into


def gathered(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts again, from outputs and forms alone."""
    start, end = offsets[:-1], offsets[1:]
    marked = form != PLAIN
    at, kind, row = marks(data, offsets)
    place = np.full((3, len(form)), -1, np.int64)
    inside = marked[row]
    place[kind[inside], row[inside]] = at[inside]
    if (place[:, marked] < 0).any():
        raise ValueError("an output lacks a marker of its form")
    p, s, m = np.where(marked, place, 0)
    spm = form == SPM
    prefix = np.where(marked, np.where(spm, m, s) - p - _SIZE, 0)
    suffix = np.where(marked, np.where(spm, p, m) - s - _SIZE, 0)
    sizes = end - start - 3 * _SIZE * marked
    into = np.concatenate([[0], np.cumsum(sizes)])
    first = into[:-1]
    from_prefix = np.where(marked, p + _SIZE, start) - first
    from_middle = np.where(marked, m + _SIZE - prefix, start) - first
    from_suffix = np.where(marked, s + _SIZE - (sizes - suffix), start) - first
    cuts = [first, first + prefix, first + sizes - suffix]
    return data[np.arange(int(into[-1])) + shifts(int(into[-1]), cuts, [from_prefix, from_middle, from_suffix])], into


def _transform(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
            done = 0
            for data, offsets, h1, h2, h3, h4 in parts(batch.column("text"), *h):
                starts = np.flatnonzero((data & 0xC0) != 0x80)  # of code points
                own = np.searchsorted(starts, offsets)  # each text's first
                n = np.diff(own)
                low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
                starts = np.append(starts, len(data))
                form = np.where(h4 % 100 < 20, SPM, PSM)
                form[(n == 0) | (h3 % 100 >= 90)] = PLAIN
                form[marks(data, offsets)[2]] = PLAIN
                out, into = scattered(data, offsets, starts[own[:-1] + low], starts[own[:-1] + high], form)
                plain = form == PLAIN
                rows = len(n)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(done, rows) for c in names), binary(out, into), pa.array(n, pa.int64()),
                    pa.array(FORMS).take(pa.array(form)), pa.array(low, pa.int64(), mask=plain),
                    pa.array(high - low, pa.int64(), mask=plain),
                ], names=[*names, "output", "n", "form", "prefix_chars", "middle_chars"])
                done += rows

    return run


def _restore(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("_form").to_numpy(zero_copy_only=False)
            form = np.select([kinds == "psm", kinds == "spm"], [PSM, SPM], PLAIN)
            done = 0
            for data, offsets, own in parts(batch.column("_output"), form):
                out, into = gathered(data, offsets, own)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(done, len(own)) for c in names), binary(out, into)], names=[*names, "restored"])
                done += len(own)

    return run


def draws(doc_id: Column) -> list[Column]:
    """h1 to h4 of a document: the first 8-digit groups of the hex SHA-256 of ``1:`` and its id. A null id counts as empty."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transformed(docs: DataFrame) -> DataFrame:
    """(_doc, output, n, form, prefix_chars, middle_chars) of every row.

    ``_doc`` holds the row's columns but for its text. A null text is empty;
    empty texts and those that hold a marker stay plain. Repeated rows are
    transformed alike, an empty table gives an empty one, and no row needs
    another, so nothing is shuffled.
    """
    rows = carried(docs, "text", own=without_text(docs)).select(
        DOC, F.col("text").cast("binary").alias("text"), *draws(F.col(f"{DOC}.doc_id")))
    return rows.mapInArrow(_transform([DOC]), T.StructType([rows.schema[DOC], *_OUT]))


def restored(outputs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``restored``, the text from ``output`` and ``form`` alone.

    A marked output that lacks one of its markers is an error.
    """
    rows = outputs.select(*keep, F.col("output").alias("_output"), F.col("form").alias("_form"))
    kept = T.StructType([*(rows.schema[c] for c in keep), T.StructField("restored", T.BinaryType())])
    return rows.mapInArrow(_restore(keep), kept)
