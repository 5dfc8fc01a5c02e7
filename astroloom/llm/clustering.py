"""Centroid clustering over subvector dictionaries.

Vectors become integers and are kept in slabs of rows. In a slab each block of dimensions is dictionary-encoded without
loss: its distinct subvectors, and a code for each row. In every round the squared distances of a dictionary's subvectors
to all centroids are computed once, exactly, and a row's distance is the sum of its blocks' distances, looked up by code.
The wider the blocks, the fewer sums and the more subvectors: each slab takes the width that needs the fewest operations,
by counting its distinct subvectors at each.

Dictionaries belong to slabs, so none is broadcast, joined or grows with the table: a round reads the slabs where they
lie, and only sums of each cluster and dimension leave a task. Centroids are the only thing that is sent out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Components beyond this, after scaling, count as it; all that is nearer is exact.
FAR = 1 << 54
#: Up to this distance between components, squares summed over the dimensions fit 64 bits; beyond it Python's integers.
NARROW = 1 << 28
#: Sums and squares beyond this are given as it.
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Clustering:
    """Centroids, rounds, components of a vector, what they are multiplied by, the prefix of the hashed ids that choose
    the first centroids, and the rows of a slab."""

    k: int = 40
    rounds: int = 5
    dim: int = 64
    scale: int = 256
    seed: str = "2:"
    slab: int = 65_536


def whole(column: str, dim: int) -> Column:
    """Whether a vector has exactly ``dim`` components, none null or non-finite."""
    x = F.col(column)
    # What is compared with an infinity or NaN this way is false, and null beside a null.
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return x.isNotNull() & (F.size(x) == dim) & finite


def integers(flat: np.ndarray, config: Clustering) -> np.ndarray:
    """floor(scale * x) of each component, a row for each vector."""
    scaled = np.floor(config.scale * flat.astype(np.float64).reshape(-1, config.dim))
    return np.clip(scaled, -FAR, FAR).astype(np.int64)


def encode(x: np.ndarray, k: int) -> tuple[int, list[np.ndarray], list[np.ndarray]]:
    """(width, subvectors of each block, codes of each block) at the width that needs the fewest operations in a round."""
    n, dim = x.shape
    codes, firsts = [], []
    for j in range(dim):
        _, first, code = np.unique(x[:, j], return_index=True, return_inverse=True)
        codes.append(code), firsts.append(first)
    width, best = 1, None
    while True:
        # A distance takes a difference, a square and a sum in each dimension, a row one sum in each block.
        work = 3 * sum(len(f) for f in firsts) * width * k + n * len(codes) * k
        if best is None or work < best[0]:
            best = work, width, firsts, codes
        if len(codes) % 2:
            break
        # A subvector of twice the width is a pair of codes, so wider dictionaries are made of narrower ones.
        pairs = [np.unique(a.astype(np.int64) * len(f) + b, return_index=True, return_inverse=True) for a, b, f in zip(codes[::2], codes[1::2], firsts[1::2], strict=True)]
        firsts, codes, width = [p[1] for p in pairs], [p[2] for p in pairs], 2 * width
    _, width, firsts, codes = best
    return width, [x[f, b * width : (b + 1) * width] for b, f in enumerate(firsts)], [c.astype(np.int32) for c in codes]


def slabs(vectors: DataFrame, id: str, vector: str, config: Clustering) -> DataFrame:
    """(ids, n, width, sizes, subvectors, codes): the vectors that take part, encoded; a task's rows make slabs of up to
    ``slab`` rows."""
    ids = vectors.schema[id].dataType.simpleString()
    kind = pa.int64() if ids == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def packed(rows: pa.Table) -> pa.RecordBatch:
            width, subs, codes = encode(integers(rows.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False), config), config.k)
            named = rows.column(0).combine_chunks()
            named = pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named if kind is None else named.cast(kind))
            held = [[len(named.values)], [width], [[len(s) for s in subs]], [b"".join(s.tobytes() for s in subs)], [b"".join(c.tobytes() for c in codes)]]
            types = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([named, *(pa.array(v, t) for v, t in zip(held, types, strict=True))], names=["ids", "n", "width", "sizes", "subvectors", "codes"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, config.slab - sum(b.num_rows for b in waiting))
                waiting.append(part)
                batch = batch.slice(part.num_rows)
                if sum(b.num_rows for b in waiting) == config.slab:
                    yield packed(pa.Table.from_batches(waiting))
                    waiting = []
        if waiting:
            yield packed(pa.Table.from_batches(waiting))

    kept = vectors.filter(whole(vector, config.dim)).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    return kept.mapInArrow(run, f"ids array<{ids}>, n long, width int, sizes array<int>, subvectors binary, codes binary")


def decoded(row: dict, dim: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Subvectors and codes of each block of a stored slab."""
    n, width = row["n"], row["width"]
    flat, ends = np.frombuffer(row["subvectors"], np.int64).reshape(-1, width), np.cumsum([0, *row["sizes"]])
    codes = np.frombuffer(row["codes"], np.int32).reshape(dim // width, n)
    return [flat[a:b] for a, b in zip(ends, ends[1:])], list(codes)


def nearest(subs: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row, exact, ties to the smaller number: distances of the subvectors once, then
    sums by code. ``centroids`` are Python integers where they or the subvectors are far out."""
    width, span = subs[0].shape[1], int(abs(centroids).max()) + max(int(np.abs(s).max()) for s in subs)
    kind = np.int64 if span < NARROW else object
    centroids = centroids.astype(kind)
    total = np.zeros((len(codes[0]), len(centroids)), kind)
    for b, (sub, code) in enumerate(zip(subs, codes, strict=True)):
        sub = sub.astype(kind)
        apart = sum((sub[:, j, None] - centroids[None, :, b * width + j]) ** 2 for j in range(width))
        total += apart[code]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def sums(rows: DataFrame, centroids: np.ndarray, config: Clustering) -> dict[tuple[int, int], tuple[int, int]]:
    """{(cluster, dimension): (vectors, exact sum of their component)} of one assignment."""
    exact = Context(prec=38)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), config.dim), object)
        for batch in batches:
            for row in batch.to_pylist():
                subs, codes = decoded(row, config.dim)
                cluster, _ = nearest(subs, codes, centroids)
                order = np.argsort(cluster, kind="stable")
                found, start = np.unique(cluster[order], return_index=True)
                count += np.bincount(cluster, minlength=len(centroids))
                for b, (sub, code) in enumerate(zip(subs, codes, strict=True)):
                    # 64 bits hold a slab's sum unless components are far out.
                    x = sub[code[order]] if int(np.abs(sub).max()) < NARROW else sub[code[order]].astype(object)
                    total[found, b * row["width"] : (b + 1) * row["width"]] += np.add.reduceat(x, start, axis=0).astype(object)
        c, d = np.nonzero(np.broadcast_to(count[:, None] > 0, total.shape))
        made = [pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(count[c]), pa.array([exact.create_decimal(int(v)) for v in total[c, d]], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(made, names=["cluster", "dim", "n", "total"])

    parts = rows.drop("ids").mapInArrow(run, "cluster int, dim int, n long, total decimal(38,0)")
    # One row for each cluster and dimension reaches the driver.
    return {(r.cluster, r.dim): (r.n, int(r.total)) for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()}


def first_centroids(vectors: DataFrame, id: str, vector: str, config: Clustering) -> np.ndarray:
    """The ``k`` vectors whose hashed ids are smallest; rows without an id come last, ties go to the smaller vector."""
    named = vectors.filter(whole(vector, config.dim)).select(F.sha2(F.concat(F.lit(config.seed), F.col(id).cast("string")), 256).alias("h"), F.col(vector).cast("array<double>").alias("x"))
    rows = named.orderBy(F.asc_nulls_last("h"), "x").limit(config.k).collect()
    return integers(np.array([r.x for r in rows]), config).astype(object)


def assigned(rows: DataFrame, centroids: np.ndarray, id: str, config: Clustering) -> DataFrame:
    ids = rows.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.drop_columns(["ids"]).to_pylist()):
                cluster, distance = nearest(*decoded(row, config.dim), centroids)
                distance = np.minimum(distance, LONG).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(k, 1).flatten(), pa.array(cluster, pa.int32()), pa.array(distance)], names=[id, "cluster", "distance"])

    return rows.mapInArrow(run, f"`{id}` {ids}, cluster int, distance long")


def clustered(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", config: Clustering = Clustering()) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256; one row for each vector that takes
    part, after ``rounds`` rounds and one more assignment.

    Vectors that are null, of another length, or hold null or non-finite components take no part. Repeated rows and rows
    without an id count as rows; of equal distances the smaller number wins, so of equal first centroids the later ones
    stay empty, and an empty centroid stays where it is. Fewer vectors than centroids make as many centroids as there are;
    none makes no rows. Components are exact up to 2^54 after scaling and count as that beyond; a distance or sum beyond a
    long is given as the largest one. Only the two named columns are read."""
    rows = written(slabs(vectors, id, vector, config))
    centroids = first_centroids(vectors, id, vector, config)
    if not len(centroids):
        centroids = np.zeros((1, config.dim), object)  # of no vectors
    for _ in range(config.rounds):
        found = sums(rows, centroids, config)
        centroids = np.array([[found[c, d][1] // found[c, d][0] if (c, d) in found else centroids[c, d] for d in range(config.dim)] for c in range(len(centroids))], dtype=object)
    out = written(assigned(rows, centroids, id, config))
    bounded = lambda total: F.least(total, F.lit(Decimal(LONG))).cast("long")
    # A row for each centroid.
    per = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("held")).collect()
    digest = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centroids]
    about = [(r.cluster, r.held, sum(x.held for x in per), digest[r.cluster]) for r in per]
    about = vectors.sparkSession.createDataFrame(about, "cluster int, held decimal(38,0), all decimal(38,0), centroid_sha256 string")
    return out.join(F.broadcast(about), "cluster").select(id, "cluster", "distance", bounded(F.col("held")).alias("cluster_inertia"), bounded(F.col("all")).alias("inertia"), "centroid_sha256")


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_clustering": op11_clustering}
ORACLE_SQL: dict[str, str] = {}
