"""Embedding whitening with Spark MLlib's distributed matrices.

Vectors become integers, so means are exact. Centred rows are indexed and dealt into the blocks of a BlockMatrix X; X'X is
the scatter, whose eigenvectors are found on the driver (its size is dimensions squared), and X times the whitening matrix
projects the rows, block by block.

All stays in the JVM. The middle dimension of X'X, the rows, is split over as many tasks as there are blocks, and their
products are summed before they meet, so no task gets more than a block of each side however many rows there are. The
driver holds a pair of numbers for each block.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, shared_dir, table, written

#: Components beyond this, after scaling, count as it; doubles can't tell such numbers apart by less than one anyway.
FAR = 1 << 52
#: Bytes of a block of rows at most, and its fewest rows.
BLOCK_BYTES, BLOCK_ROWS = 32 << 20, 256
#: Share of the largest eigenvalue below which a component has no variance but rounding.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """Components that are kept, and what entries are multiplied by and moved by to be integers."""

    components: int = 8
    scale: int = 1024
    shift: int = 100_000


def finite(column: str) -> Column:
    x = F.col(column)
    return x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def indexed(vectors: DataFrame, id: str, vector: str, config: Whitening) -> DataFrame:
    """(index, id, x): the rows that take part as integers, numbered from 0 in no special order, and written once so that
    they keep their numbers."""
    kept = vectors.filter(finite(vector)).select(F.col(id).alias("id"), F.col(vector).alias("x"))
    length = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    far = F.lit(float(FAR))
    entry = lambda c: F.floor(F.greatest(F.least(c.cast("double") * config.scale, far), -far)).cast("long") + config.shift
    kept = kept.filter(F.size("x") == (length.d if length else 0)).select("id", F.transform("x", entry).alias("x"))
    rows = written(kept.withColumn("_at", F.monotonically_increasing_id()))
    # A row for each task that wrote; the rows say themselves which one and where in it.
    counts = sorted(map(tuple, rows.groupBy(F.shiftrightunsigned("_at", 33).alias("p")).count().collect()))
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    starts = vectors.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_p long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(F.broadcast(starts), F.shiftrightunsigned("_at", 33) == F.col("_p")).select(place.alias("index"), "id", "x")


def sums(rows: DataFrame) -> tuple[int, list[int], list[tuple[int, int]]]:
    """Rows, and each dimension's exact sum, smallest and largest entry."""
    each = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.min("v").alias("low"), F.max("v").alias("high"))
    found = sorted(map(tuple, each.collect()))  # a row for each dimension
    return (found[0][1] if found else 0), [int(r[2]) for r in found], [(r[3], r[4]) for r in found]


def block_matrix(rows: DataFrame, n: int, d: int, per_block: int) -> BlockMatrix:
    """(index, row) as a distributed matrix of row blocks; JVM vectors all the way."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(per_block, d)


def product(left: BlockMatrix, right: BlockMatrix, parts: int) -> BlockMatrix:
    """left times right, its middle dimension dealt out to ``parts`` tasks (Scala's multiply takes that number)."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def rows_of(matrix: BlockMatrix) -> DataFrame:
    """(index, row) of a distributed matrix."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("row"))


def deviation(n: int, total: list[int], ends: list[tuple[int, int]]) -> Column:
    """Sum over the dimensions of (n x - S)^2, exact; null where it is beyond a long."""
    most = sum(max(abs(n * x - s) for x in e) ** 2 for s, e in zip(total, ends, strict=True))
    if most < 1 << 63:  # no row can overflow
        apart = F.transform("x", lambda v, j: v * F.lit(n) - F.array(*[F.lit(s) for s in total])[j])
        return F.aggregate(F.transform(apart, lambda v: v * v), F.lit(0).cast("long"), lambda a, v: a + v)
    wide = "decimal(38,0)"
    sums_ = F.array(*[F.lit(Decimal(s)).cast(wide) for s in total])
    apart = F.transform("x", lambda v, j: (v.cast("decimal(19,0)") * F.lit(Decimal(n)).cast("decimal(18,0)")).cast(wide) - sums_[j])
    squares = F.transform(apart, lambda v: F.when(F.abs(v) < F.lit(Decimal(1 << 62)), F.try_multiply(v.cast("decimal(19,0)"), v.cast("decimal(19,0)")).cast(wide)))
    added = F.aggregate(squares, F.lit(Decimal(0)).cast(wide), lambda a, v: F.try_add(a, v).cast(wide))
    return added.try_cast("long")


def whitened(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", config: Whitening = Whitening()) -> DataFrame:
    """id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error: a row for each
    row that takes part and each component, fewer than ``components`` where there are fewer dimensions.

    Rows whose vector is null or holds null or non-finite entries are dropped, and so are those of another length than
    most vectors have (of equally frequent lengths the longest counts). Repeated rows and rows without an id count as
    rows. A component without variance has whitened 0, and stays out of identity_error, the same value in every row; of a
    table without variance, or of one row, all are 0 and explained is 0. Entries beyond 2^52 after scaling count as that,
    and a deviation beyond a long is null. An empty table gives no rows. Only the two named columns are read."""
    spark = vectors.sparkSession
    shared_dir(spark)
    rows = durable(indexed(vectors, id, vector, config))
    n, total, ends = sums(rows)
    d, kept = len(total), min(config.components, len(total))
    kind = vectors.schema[id].dataType.simpleString()
    if not kept:
        return spark.createDataFrame([], f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    per_block = max(1, min(BLOCK_BYTES // (8 * d), max(BLOCK_ROWS, n // (4 * spark.sparkContext.defaultParallelism))))
    mean = F.array(*[F.lit(s / n) for s in total])
    matrix = block_matrix(rows.select("index", F.transform("x", lambda v, j: v.cast("double") - mean[j]).alias("row")), n, d, per_block)
    matrix.persist(StorageLevel.MEMORY_AND_DISK)  # read by each product, twice by the first; made again where it is lost
    parts = -(-n // per_block)
    scatter = product(matrix.transpose(), matrix, parts).toLocalMatrix().toArray()
    values, basis = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, basis = np.maximum(values[::-1], 0), basis[:, ::-1]
    varies = [float(v) > FLAT * float(values[0]) for v in values[:kept]]
    matrix_w = np.array([basis[:, j] / np.sqrt(values[j]) if varies[j] else np.zeros(d) for j in range(kept)])
    weights = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(d, kept, matrix_w.ravel().tolist()))], 1), d, kept, d, kept)
    projected = product(matrix, weights, 1)
    both = rows.select("index", F.col("id"), deviation(n, total, ends).alias("deviation")).join(rows_of(projected), "index")
    both = written(both.select("id", "deviation", "row"))
    matrix._java_matrix_wrapper.call("blocks").unpersist(False)
    # Every pair's covariance in one pass, centred as it goes.
    pairs = [(i, j) for i in range(kept) for j in range(i, kept) if varies[i] and varies[j]]
    found = both.agg(F.count("*"), *[F.covar_pop(F.col("row")[i], F.col("row")[j]) for i, j in pairs]).first()[1:]
    error = max((abs(v - (i == j)) for (i, j), v in zip(pairs, found, strict=True)), default=0.0)
    share = F.array(*[F.lit(float(v / values.sum()) if values.sum() > 0 else 0.0) for v in values[:kept]])
    out = both.select(F.col("id").alias(id), "deviation", F.posexplode("row").alias("_j", "whitened"))
    return out.select(id, (F.col("_j") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("_j")].alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE_SQL: dict[str, str] = {}
