"""Whitened principal components of embeddings by distributed block matrices (operator 11)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm._common import numbered, pick, stored

#: Bytes of a block of rows at most.
BLOCK_BYTES = 8 << 20
#: Beyond these the exact sum of squares is not computed, as it leaves 64 bits.
_LONG = 1 << 62


def finite(vec: Column) -> Column:
    """Whether a vector is there and holds neither nulls nor non-finite entries."""
    return vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def usual_length(rows: DataFrame, col: str) -> int | None:
    """The length that most vectors have (the longer on a tie); None without rows."""
    size = rows.groupBy(F.size(col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return size[0]["d"] if size else None


def scaled(vec: Column) -> Column:
    """Entries as whole numbers, floor(256 * entry)."""
    return F.transform(vec, lambda c: F.floor(c * 256.0))


def blocks(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """The rows (index long, vector array<double>) as a block matrix with blocks of bounded size.

    The driver plans products from one pair of numbers a block, so blocks grow with the rows up to ``BLOCK_BYTES``."""
    per = int(max(1, min(BLOCK_BYTES // (8 * d), max(1024, -(-n // 4096)))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, F.floor(F.col("index") / per)) if n > per else rows
    rows = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("vector").alias("vector")), "vector")
    return IndexedRowMatrix(rows, n, d).toBlockMatrix(per, d)


def gram(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix. Its rows are split between as many products as there are blocks, whose sums are combined
    before they meet; a product in one piece would send every row to the task of its one block."""
    mid = -(-matrix.numRows() // matrix.rowsPerBlock)
    left = matrix.transpose()._java_matrix_wrapper
    product = left.call("multiply", matrix._java_matrix_wrapper._java_model, int(max(1, min(mid, 4096))))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(index, w array<double>): every row of the matrix times the weights."""
    d, k = weights.shape
    sc = matrix.blocks.ctx
    right = BlockMatrix(sc.parallelize([((0, 0), Matrices.dense(d, k, weights.T.ravel().tolist()))], 1), d, k)
    rows = matrix.multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    return found.select("index", vector_to_array("vector").alias("w"))


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable row and component up to ``components``: vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Entries are floor(256 * entry). The fit list is every distinct vector once (n of them, with sums S by dimension). Its
    rows, centred, are indexed into distributed blocks; transpose times matrix is the scatter, whose covariance (divisor
    n) is decomposed on the driver (d x d numbers); the matrix times the whitening matrix projects the rows, and the
    covariance of what comes out is measured by another product. ``deviation`` is sum((n * x - S)^2), exact, ``explained``
    the share of the trace, and ``identity_error`` the largest absolute entry of that covariance minus the identity.

    Equal vectors meet as one: they are made distinct before any product, and the join that gives rows their components
    can be split where a vector is frequent.

    Nulls and edge cases: vectors that are null or hold null or non-finite entries take no part; nor do empty ones and
    those of another length than most (the longer on a tie), which have no covariance with the rest. Ids may be null or
    repeated: each row comes out. A component without variance has a null ``whitened`` and counts in no identity error
    (null if none has any; so is ``explained`` where all vectors are alike). ``deviation`` is null where it leaves 64
    bits. Equal eigenvalues come in either order. No usable vector gives no rows. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=id_col, vec=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.filter(finite(F.col("vec"))).select("vec_id", scaled(F.col("vec")).alias("x")).filter("size(x) > 0")
    rows = stored(rows, "whole-numbers")
    d = usual_length(rows, "x")
    if d is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = rows.filter(F.size("x") == d)
    fit = stored(numbered(rows.select("x").distinct(), name="index", what="distinct"), "fit")
    sums = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)]).first()
    n, s = sums["n"], [int(sums[f"s{i}"]) for i in range(d)]

    mean = F.array(*[F.lit(float(v) / n) for v in s])
    centred = fit.select("index", F.zip_with("x", mean, lambda a, m: a.cast("double") - m).alias("vector"))
    matrix = blocks(stored(centred, "centred"), n, d)
    cov = gram(matrix) / n
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, d)
    trace = float(np.trace(cov))
    live = [i for i in range(k) if values[i] > d * np.finfo(float).eps * max(values[0], 0)]
    weights = np.zeros((d, k))
    for i in live:
        weights[:, i] = axes[:, i] / math.sqrt(values[i])
    flat = stored(projected(matrix, weights), "projected")
    error = None
    if live:
        error = float(np.abs((gram(blocks(flat.select("index", F.col("w").alias("vector")), n, k)) / n - np.eye(k))[np.ix_(live, live)]).max())

    if max(map(abs, s), default=0) < _LONG:
        total = F.array(*[F.lit(v).cast("long") for v in s])
        off = F.zip_with("x", total, lambda a, t: F.try_subtract(F.try_multiply(a, F.lit(n)), t))
        deviation = F.aggregate(off, F.lit(0).cast("long"), lambda t, v: F.try_add(t, F.try_multiply(v, v)))
    else:
        deviation = F.lit(None).cast("long")
    parts = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("component"),
                (F.col("w")[i] if i in live else F.lit(None).cast("double")).alias("whitened"),
                F.lit(float(max(values[i], 0.0)) / trace if trace > 0 else None).cast("double").alias("explained"),
            )
            for i in range(k)
        ]
    )
    each = fit.join(flat, "index").select("x", deviation.alias("deviation"), parts.alias("parts"))
    out = rows.join(each, "x").select("vec_id", "deviation", F.explode("parts").alias("p"))
    return out.select("vec_id", "p.component", F.lit(n).cast("long").alias("n"), "deviation", "p.whitened", "p.explained", F.lit(error).cast("double").alias("identity_error"))
