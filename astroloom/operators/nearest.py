"""Approximate vector search by random hyperplanes, and the searches over vectors of several languages or modalities.

A vector's side of each plane is a bit; a band of bits is a bucket, so vectors at a small angle share a bucket in some
band. A query also asks the buckets across the planes it lies nearest to, so fewer bands are needed. Searches match a tile
of queries and rows at a time where the rows lie, so no pair is shuffled, and score those that share a bucket, exactly. A
saved index keeps its bands as a table too, bucketed by their key, to list the pairs that share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..sources.shared import stored
from .retrieval import QUERY_BLOCK, TILE, matrix, top_k, vector_search

#: Bytes of queries' buckets that a task holds, and the share of a tile's pairs from which on all are multiplied at once.
HELD, DENSE = 1 << 28, 16


@dataclass(frozen=True)
class Planes:
    """Bands, planes of each, the seed they are drawn from, and the buckets that a query asks beside its own. A bucket
    holds about rows / 2 ** bits rows: more rows want more bits, and these more bands for the same recall."""

    bands: int = 24
    bits: int = 8
    seed: int = 7
    probes: int = 6

    @classmethod
    def for_rows(cls, rows: int, bucket: int = 64, angle: float = 60.0) -> Planes:
        """Planes that keep about ``bucket`` rows in a bucket, and bands enough to find 95 in 100 of the vectors at this
        angle: one and its query are on one side of a plane with probability p, and share a bucket or one that is probed
        with p^bits (1 + bits (1 - p) / p)."""
        bits, p = max(4, int(np.ceil(np.log2(max(rows, 1) / bucket)))), 1 - angle / 180
        return cls(bands=int(np.ceil(3 / (p**bits * (1 + bits * (1 - p) / p)))), bits=bits, probes=bits)

    def drawn(self, dim: int) -> np.ndarray:
        return np.random.default_rng(self.seed).standard_normal((self.bands * self.bits, dim))


def banded(vectors: DataFrame, key: str, vector: str, planes: Planes, probes: int = 0) -> DataFrame:
    """(key, band, bucket) of each vector, and of its ``probes`` nearest neighbours among the buckets of a band: those
    across the one plane it lies nearest to. Null vectors are in none."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in batch.column("v").to_pylist()])
            drawn = planes.drawn(x.shape[1]) if drawn is None else drawn
            side = (x @ drawn.T).reshape(len(x), planes.bands, planes.bits)
            bits = 1 << np.arange(planes.bits, dtype=np.int64)
            own = ((side > 0) * bits).sum(axis=2)
            near = own[..., None] ^ bits[np.argsort(np.abs(side), axis=2)[..., :probes]]
            buckets = np.concatenate([own[..., None], near], axis=2)
            shape = buckets.shape
            at, band, _ = np.indices(shape)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at.ravel())), pa.array(band.ravel().astype(np.int32)), pa.array(buckets.ravel())], names=["k", "band", "bucket"])

    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    return rows.mapInArrow(run, f"k {kind}, band int, bucket long").withColumnRenamed("k", key)


@dataclass(frozen=True)
class VectorIndex:
    """``vectors`` (doc_id, embedding of length one) and their ``bands`` (doc_id, band, bucket), which are made when read
    unless the index was saved."""

    vectors: DataFrame
    bands: DataFrame
    planes: Planes

    @classmethod
    def of(cls, embedded: DataFrame, planes: Planes | None = None) -> VectorIndex:
        """An index of (doc_id, embedding), whose vectors are written once."""
        rows = stored(embedded.filter("embedding IS NOT NULL").select("doc_id", vx.unit(F.col("embedding")).alias("embedding")))
        planes = planes or Planes.for_rows(rows.count())
        return cls(rows, banded(rows, "doc_id", "embedding", planes), planes)

    def save(self, name: str, buckets: int = 64) -> VectorIndex:
        """Two tables of the warehouse, bucketed by what searches join on, so neither is shuffled by a search."""
        self.bands.write.mode("overwrite").bucketBy(buckets, "band", "bucket").sortBy("band", "bucket").saveAsTable(f"{name}_bands")
        self.vectors.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id").saveAsTable(f"{name}_vectors")
        return self.load(self.vectors.sparkSession, name, self.planes)

    @classmethod
    def load(cls, spark: SparkSession, name: str, planes: Planes) -> VectorIndex:
        return cls(spark.table(f"{name}_vectors"), spark.table(f"{name}_bands"), planes)

    def candidates(self, asked: DataFrame) -> DataFrame:
        """(qid, doc_id) of rows and queries (qid, q) that share a bucket."""
        return banded(asked, "qid", "q", self.planes, self.planes.probes).join(self.bands, ["band", "bucket"]).select("qid", "doc_id").distinct()

    def search(self, asked: DataFrame, k: int = 5, threshold: float = 0.1) -> DataFrame:
        """(qid, doc_id, score, rank) as ``vector_search`` gives them, of the rows that share a bucket with a query."""
        asked = asked.filter("q IS NOT NULL").select("qid", vx.unit(F.col("q")).alias("q"))
        block = max(1, min(QUERY_BLOCK, HELD // (self.planes.bands * (8 + self.planes.probes))))
        rows = asked.limit(block + 1).toArrow()
        if len(rows) > block:
            asked, blocks = stored(asked), 1 + 2 * asked.count() // block
            return reduce(DataFrame.unionByName, [self.search(asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b), k, threshold) for b in range(blocks)])
        planes = self.planes
        shared = asked.sparkSession.sparkContext.broadcast((rows.column("qid").combine_chunks(), matrix(rows.column("q"))))
        kinds = {c: f.schema[c].dataType.simpleString() for c, f in (("qid", asked), ("doc_id", self.vectors))}
        hits = self.vectors.mapInArrow(lambda batches: _near(batches, *shared.value, planes, k, threshold), f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, score double")
        return top_k(hits.select("qid", "doc_id", F.round("score", 6).alias("score")), k)


def _buckets(x: np.ndarray, drawn: np.ndarray, planes: Planes, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each vector and band, and the numbers of the planes that it lies nearest to, some vectors at a time."""
    own, near = np.zeros((len(x), planes.bands), dtype=np.int64), np.zeros((len(x), planes.bands, probes), dtype=np.uint8)
    step = max(1, TILE // len(drawn))
    for at in range(0, len(x), step):
        side = (x[at : at + step] @ drawn.T).reshape(-1, planes.bands, planes.bits)
        own[at : at + step] = ((side > 0) * (1 << np.arange(planes.bits, dtype=np.int64))).sum(axis=2)
        if probes:
            near[at : at + step] = np.argsort(np.abs(side), axis=2)[..., :probes]
    return own, near


def _near(batches: Iterator[pa.RecordBatch], names: pa.Array, q: np.ndarray, planes: Planes, k: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Each batch's k best rows of a query among those that share a bucket with it, a tile of queries at a time."""
    floor, drawn = np.full(len(q), threshold), None
    for batch in batches:
        if not batch.num_rows or not q.size:
            continue
        batch = batch.take(pc.sort_indices(batch.column("doc_id"), null_placement="at_start"))
        x, found = matrix(batch.column("embedding")), []
        if drawn is None:
            drawn = planes.drawn(x.shape[1])
            asks, near = _buckets(q, drawn, planes, min(planes.probes, planes.bits))
        own = _buckets(x, drawn, planes, 0)[0].T
        orders = np.argsort(own, axis=1, kind="stable")
        held = [np.unique(b[o], return_index=True, return_counts=True) for b, o in zip(own, orders, strict=True)]
        step = max(1, TILE // len(x))
        for at in range(0, len(q), step):
            some = q[at : at + step]
            shares = np.zeros((len(some), len(x)), dtype=bool)
            for band, (order, (bucket, first, n)) in enumerate(zip(orders, held, strict=True)):
                mine = asks[at : at + step, band, None]
                all_ = np.concatenate([mine, mine ^ (1 << near[at : at + step, band].astype(np.int64))], axis=1)
                place = np.minimum(np.searchsorted(bucket, all_), len(bucket) - 1)
                i, j = np.nonzero(bucket[place] == all_)
                place = place[i, j]
                each = n[place]
                rows = order[np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(first[place], each)]
                shares[np.repeat(i, each), rows] = True
            least = floor[at : at + step]
            if np.count_nonzero(shares) * DENSE > shares.size:
                value = some @ x.T
                i, j = np.nonzero(shares & (value > least[:, None] - 1e-6))
                v = value[i, j]
            else:
                i, j = np.nonzero(shares)
                v = np.einsum("ij,ij->i", some[i], x[j])
            v = np.round(v, 6)
            good = np.isfinite(v) & (v >= least[i])
            i, j, v = i[good], j[good], v[good]
            order = np.lexsort((j, -v, i))
            i, j, v = i[order], j[order], v[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            least[i[place == k - 1]] = v[place == k - 1]
            i, j, v = i[place < k], j[place < k], v[place < k]
            found.append((i + at, j, v))
        i, j, v = (np.concatenate(c) for c in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(i)), batch.column("doc_id").take(pa.array(j)), pa.array(v)], names=["qid", "doc_id", "score"])


Search = Callable[[DataFrame, DataFrame, int], DataFrame]


def exact(embedded: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    return vector_search(embedded, asked, k, -1.0)


def by_planes(planes: Planes | None = None) -> Search:
    """A search that builds an index of its rows; keep a ``VectorIndex`` where the same rows are searched again."""
    return lambda embedded, asked, k: VectorIndex.of(embedded, planes).search(asked, k, -1.0)


def bilingual_search(entries: DataFrame, asked: DataFrame, k: int = 3, search: Search = exact) -> DataFrame:
    """(qid, doc_id, score, rank): entries (doc_id, one, two), a vector in each language, by the average of the two; an
    entry that lacks a language is left out, as it has no aligned vector."""
    both = entries.filter("one IS NOT NULL AND two IS NOT NULL").select("doc_id", vx.aligned(F.col("one"), F.col("two")).alias("embedding"))
    return search(both, asked, k)


def translate_concept(entries: DataFrame, asked: DataFrame, target: str = "auto", k: int = 3, search: Search = exact) -> DataFrame:
    """(qid, language, translation, score, rank): the k nearest entries' texts (``text_one``, ``text_two``) in the target
    language, ``one`` or ``two``, or in both for ``auto``."""
    hits = bilingual_search(entries, asked, k, search).join(entries.select("doc_id", "text_one", "text_two"), "doc_id")
    wanted = [F.struct(F.lit(n).alias("language"), F.col(f"text_{n}").alias("translation")) for n in ("one", "two") if target in (n, "auto")]
    return hits.withColumn("t", F.explode(F.array(*wanted))).select("qid", "t.language", "t.translation", "score", "rank")


# What the modalities weigh, spectrum, light curve and text.
MODALITIES = {"spectrum": 0.4, "lightcurve": 0.35, "text": 0.25}


def fused(items: DataFrame, modalities: dict[str, float] | None = None, method: str = "weighted", dim: int = 64) -> DataFrame:
    """(doc_id, embedding): the modalities' vectors in one. ``weighted`` and ``average`` are means over those that are
    present, ``concat`` puts these one after the other and cuts or pads with zeros to ``dim``; none if all are absent."""
    weights = modalities or MODALITIES
    columns = [F.col(c) for c in weights]
    if method == "concat":
        made = vx.concatenated(columns, dim)
    else:
        made = vx.weighted(columns, [1.0] * len(columns) if method == "average" else list(weights.values()))
    return items.select("doc_id", made.alias("embedding")).filter("embedding IS NOT NULL")


def cross_modal_search(items: DataFrame, asked: DataFrame, modalities: dict[str, float] | None = None, method: str = "weighted", k: int = 5, search: Search = exact, dim: int = 64) -> DataFrame:
    """(qid, doc_id, score, rank, modalities): items by the cosine of their fused vector with the query, and which
    modalities an item has."""
    names = list(modalities or MODALITIES)
    hits = search(fused(items, modalities, method, dim), asked, k)
    has: Column = F.concat_ws("+", *[F.when(F.col(n).isNotNull(), n) for n in names])
    return hits.join(items.select("doc_id", has.alias("modalities")), "doc_id").select("qid", "doc_id", "score", "rank", "modalities")
