"""Embedding whitening with MLlib's distributed matrices.

Centred rows are numbered and gathered into the blocks of a BlockMatrix. Its
transpose times itself is the scatter, whose eigenvectors are found on the
driver (a matrix of dimension x dimension, however many vectors there are); a
second block product projects every row.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagtide.llm.staging import staged

#: Rows and columns of a block: 512 KB for vectors of 64 entries.
BLOCK = 1024
#: Row blocks that one task of the scatter multiplies.
TOGETHER = 16
SCHEMA = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def finite(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, x) of the rows whose vector is neither null nor empty and holds finite entries only; x = floor(1024 c) + 100000.

    The dimension is the most frequent one (of two, the larger); vectors of others can't be
    whitened with these and go.
    """
    whole = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    shifted = F.transform(vector, lambda c: F.floor(c.cast("double") * 1024).cast("long") + 100_000)
    rows = vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_column).alias("id"), shifted.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("x") == (sizes["size"] if sizes else 0))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``number`` 0, 1, 2, ...: the place in the partition plus the sizes of those before, without a sort.

    The rows are stored first, so that a task that runs again gives the same numbers.
    """
    part = F.shiftright("_place", 33)
    stored = staged(rows.withColumn("_place", F.monotonically_increasing_id()), "vectors").withColumn("_part", part)
    sizes = {r["_part"]: r["count"] for r in stored.groupBy("_part").count().collect()}  # a number a partition
    before, total = [], 0
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    starts = rows.sparkSession.createDataFrame(before, "_part long, _start long")
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return stored.join(starts, "_part").withColumn("number", F.col("_start") + within).drop("_part", "_start", "_place")


def block_product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right with the inner dimension dealt over ``splits`` tasks for each block of the result."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def row_blocks(rows: DataFrame, number: str, values: Column) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col(number), array_to_vector(values).alias("vector")), "vector")
    return IndexedRowMatrix(vectors).toBlockMatrix(BLOCK, BLOCK)


def local_blocks(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix as a BlockMatrix."""
    blocks = [
        ((i // BLOCK, j // BLOCK), DenseMatrix(part.shape[0], part.shape[1], part.ravel("F").tolist()))
        for i in range(0, matrix.shape[0], BLOCK) for j in range(0, matrix.shape[1], BLOCK)
        for part in [matrix[i : i + BLOCK, j : j + BLOCK]]
    ]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), BLOCK, BLOCK, *matrix.shape)


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of the covariance by fall, unit eigenvectors as columns, and the trace.

    Directions without variance (to double precision) can't be whitened and are left out.
    """
    covariance = (scatter + scatter.T) / (2 * n)
    values, directions = np.linalg.eigh(covariance)
    values, directions = values[::-1], directions[:, ::-1]
    real = values > len(values) * np.finfo(float).eps * max(values[0], 0)
    keep = min(most, int(real.sum()))
    return values[:keep], directions[:, :keep], float(np.trace(covariance))


def whitened(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", most: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row a vector and component.

    Rows with a null vector, an empty one, or null or non-finite entries are
    dropped. Repeated ids and vectors are rows like others; a null id stays null.
    ``deviation`` is the exact sum over dimensions of (n x - S)^2 and null where
    it is beyond a long. Without a vector, or without variance, there is no row.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_column]
    rows = numbered(finite(vectors, id_column, vector))
    found = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    sums = [(r["s"], r["n"]) for r in found.orderBy("d").collect()]  # a number a dimension
    nothing = spark.createDataFrame([], f"`{id_column}` {kind}, {SCHEMA}")
    if not sums:
        return nothing
    n, totals = sums[0][1], [s for s, _ in sums]
    means = F.lit([s / n for s in totals])
    centred = F.zip_with("x", means, lambda x, m: x - m)
    matrix = row_blocks(rows, "number", centred)
    tall = matrix.numRowBlocks
    scatter = block_product(matrix.transpose(), matrix, -(-tall // TOGETHER)).toLocalMatrix().toArray()
    values, directions, trace = components(scatter, n, most)
    if not len(values):
        return nothing
    projected = block_product(matrix, local_blocks(spark, directions / np.sqrt(values)), 1).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    projected = staged(projected.select(F.col("index").alias("number"), vector_to_array("vector").alias("w")), "projected")

    k = len(values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    spread = projected.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(spread, pairs, strict=True))

    # n x - S = n (x - m) - r with m near S / n: the products stay small, and their sum is exact in 38 digits.
    middle = [s // n for s in totals]
    rest = [s - n * m for s, m in zip(totals, middle, strict=True)]
    y = F.zip_with("x", F.lit(middle), lambda x, m: x - m)
    add = lambda a, b: a + b
    squares = F.aggregate(F.transform(y, lambda v: v * v), F.lit(0).cast("long"), add).cast("decimal(38,0)")
    mixed = F.aggregate(F.zip_with(y, F.lit(rest), lambda v, r: v.cast("decimal(19,0)") * r), F.lit(0).cast("decimal(38,0)"),
                        lambda a, b: (a + b).cast("decimal(38,0)"))
    whole = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    deviation = (whole(n * n) * squares - whole(2 * n) * mixed + whole(sum(r * r for r in rest))).cast("decimal(38,0)")
    shares = F.lit([float(v / trace) for v in values])
    each = rows.select("number", F.col("id").alias(id_column), deviation.try_cast("long").alias("deviation"))
    return each.join(projected, "number").select(id_column, "deviation", F.posexplode("w").alias("_c", "whitened")).select(
        id_column, (F.col("_c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("_c")].alias("explained"), F.lit(float(error)).alias("identity_error"))
