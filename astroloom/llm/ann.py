"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance. A bounded sample is cut
into balanced clusters; every vector goes to its nearest centroid's posting list, and a boundary vector to each further
list whose centroid is nearly as near. Centroids are searched by best-first walks over an in-memory neighbour graph. A
query opens the lists whose centroids are within a ratio of its nearest one's distance. How many lists and which ratio
that takes is measured: some sampled queries are answered by brute force over all vectors, and the limits are set so that
the lists of their true neighbours are opened. A query meets its nearest lists first; the score of its k-th best there
is a bound that what the other lists hand on must reach. Lists are cut into segments of bounded size, the queries of a
list into parts, and each pair of them is compared in a group of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import durable, f64, i64, table, written


@dataclass(frozen=True)
class Lists:
    """``size``: vectors of a list aimed at. ``most``: lists at most, which with the dimension bounds what is broadcast.
    ``sample``: sampled vectors for each list; ``sampled``: in all, at most. ``copies``, ``edge``: lists of a vector, and
    how much farther than the nearest centroid a further one may be. ``placing``: centroids that a vector's walk keeps
    in view. ``aim``: the share of true neighbours whose lists a query opens, ``trials``: sampled queries that measure
    it; ``first``: lists that it meets first, for the bound. ``segment``: vectors of a segment, ``part``: queries that meet it at a time."""

    size: int = 256
    most: int = 16_384
    sample: int = 16
    sampled: int = 131_072
    copies: int = 2
    edge: float = 1.08
    placing: int = 24
    aim: float = 0.965
    trials: int = 256
    first: int = 4
    degree: int = 24
    segment: int = 2048
    part: int = 4096
    rounds: int = 2
    seed: int = 3


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of vectors that are neither null, empty, zero nor hold nulls or non-finite values. Floats stay so, to
    be half as large in a shuffle; other numbers become doubles. All sums are in double precision."""
    v = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return rows.filter(finite & F.exists("v", lambda x: x != 0))


def balanced_centroids(x: np.ndarray, lists: int, p: Lists) -> np.ndarray:
    """Splits the sample in two again and again, each time the largest part into equal halves along its main direction,
    so that lists are balanced; then some rounds of nearest-centroid means, which may not empty a list."""
    rng = np.random.default_rng(p.seed)
    parts = [np.arange(len(x))]
    while len(parts) < lists:
        k = int(np.argmax([len(i) for i in parts]))
        rows = parts[k]
        if len(rows) < 2:
            break
        centred = x[rows] - x[rows].mean(axis=0)
        direction = rng.normal(size=x.shape[1])
        for _ in range(5):
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) + 1e-30
        order = rows[np.argsort(centred @ direction, kind="stable")]
        parts[k] = order[: len(order) // 2]
        parts.append(order[len(order) // 2 :])
    c = np.stack([x[i].mean(axis=0) for i in parts])
    for _ in range(p.rounds):
        near = np.concatenate([np.argmin((c * c).sum(axis=1)[None, :] - 2 * x[k : k + 4096] @ c.T, axis=1) for k in range(0, len(x), 4096)])
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


class CentroidGraph:
    """Neighbour graph over the centroids with best-first search for many queries at a time."""

    def __init__(self, centroids: np.ndarray, p: Lists):
        self.c, n = centroids.astype(np.float32), len(centroids)
        self.square = (self.c * self.c).sum(axis=1)
        rng, degree = np.random.default_rng(p.seed), min(p.degree, max(n - 1, 1))
        near = []
        for k in range(0, n, 1024):
            d = self.square[None, :] - 2 * self.c[k : k + 1024] @ self.c.T
            d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf if n > 1 else 0
            near.append(np.argpartition(d, degree - 1, axis=1)[:, :degree])
        # Some far edges keep clusters of centroids reachable from each other.
        self.edges = np.concatenate([np.concatenate(near), rng.integers(0, n, (n, 4))], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(int))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the ``beam`` best found for each query, nearest first; -1 and inf pad.
        Where the beam is a large part of all centroids, there is nothing to save by walking."""
        q, beam = q.astype(np.float32), min(beam, len(self.c))
        m, n, rows = len(q), len(self.c), np.arange(len(q))[:, None]
        if 4 * beam >= n:
            return self.every(q, beam)
        far = lambda ids: self.square[ids] - 2 * np.einsum("mkd,md->mk", self.c[ids], q)
        seen = np.zeros((m, n), dtype=bool)
        ids = np.full((m, beam), -1, dtype=np.int64)
        dist, done = np.full((m, beam), np.inf, dtype=np.float32), np.zeros((m, beam), dtype=bool)
        new = np.repeat(self.entries[None, :], m, axis=0)
        fresh = np.ones(new.shape, dtype=bool)
        for _ in range(4 * beam):
            seen[rows, new] = True
            d = np.where(fresh, far(new), np.inf)
            every, gap = np.concatenate([ids, new], axis=1), np.concatenate([dist, d], axis=1)
            marks = np.concatenate([done, np.zeros(new.shape, dtype=bool)], axis=1)
            keep = np.argsort(gap, axis=1, kind="stable")[:, : beam]
            ids, dist, done = every[rows, keep], gap[rows, keep], marks[rows, keep]
            open_ = ~done & np.isfinite(dist)
            if not open_.any():
                break
            # The nearest four unexpanded of each query.
            pick = np.argsort(np.where(open_, dist, np.inf), axis=1, kind="stable")[:, :4]
            valid = open_[rows, pick]
            done[rows, pick] |= valid
            new = self.edges[np.where(valid, ids[rows, pick], 0)].reshape(m, -1)
            fresh = np.repeat(valid, self.edges.shape[1], axis=1) & ~seen[rows, new]
            # Of a node that several of the four lead to, the first counts.
            order = np.argsort(new, axis=1, kind="stable")
            ordered = new[rows, order]
            again = np.zeros(new.shape, dtype=bool)
            again[rows, order] = np.concatenate([np.zeros((m, 1), dtype=bool), ordered[:, 1:] == ordered[:, :-1]], axis=1)
            fresh &= ~again
            if not fresh.any():
                new, fresh = new[:, :1], fresh[:, :1]
        return np.where(np.isfinite(dist), ids, -1), dist + (q * q).sum(axis=1)[:, None]

    def every(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from the distances to all centroids."""
        q = q.astype(np.float32)
        d = self.square[None, :] - 2 * q @ self.c.T
        ids = np.argsort(d, axis=1, kind="stable")[:, :most]
        return ids, np.take_along_axis(d, ids, axis=1) + (q * q).sum(axis=1)[:, None]


def _within(squared: np.ndarray, ratio: float) -> np.ndarray:
    return squared <= np.maximum(squared[:, :1], 0) * ratio**2 + 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1 if len(column) else 1)


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], type=column.type)


class Opening:
    """Which lists a vector goes to and which a query opens."""

    def __init__(self, graph: CentroidGraph, top: float, p: Lists):
        self.graph, self.top, self.p = graph, top, p
        self.probes, self.ratio = 1, 1.0

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.top**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def scale(self, x: np.ndarray) -> np.ndarray:
        """A query's length does not change its order of nearness."""
        x = x * (self.top / np.sqrt((x * x).sum(axis=1, keepdims=True)))
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1)

    def places(self, x: np.ndarray) -> list[list[int]]:
        """Lists of each vector, the nearest first."""
        ids, squared = self.graph.search(self.lift(x), self.p.placing)
        ids, squared = ids[:, : self.p.copies], squared[:, : self.p.copies]
        return [row[keep].tolist() for row, keep in zip(ids, (ids >= 0) & _within(squared, self.p.edge), strict=True)]

    def measure(self, asked: np.ndarray, near: list[np.ndarray]) -> None:
        """Sets probes and ratio so that of the queries' true neighbours (a matrix for each) the share ``aim`` lies in
        opened lists; of the ways to do so, the one that opens the fewest lists."""
        if not sum(map(len, near)):
            return
        order, squared = self.graph.every(self.scale(asked), len(self.graph.c))
        rank = np.argsort(order, axis=1)
        away = np.sqrt(np.maximum(squared, 0) / np.maximum(squared[:, :1], 1e-12))
        of = np.repeat(np.arange(len(asked)), [len(x) for x in near])
        needed = np.array([min(rank[i, c] for c in lists) for i, lists in zip(of, self.places(np.concatenate(near)), strict=True)])
        far, best = away[of, needed], None
        for share in np.linspace(self.p.aim, 1, 12):
            ratio = float(np.quantile(far, share, method="higher")) * (1 + 1e-6)
            probes = 1 + int(np.quantile(np.where(far <= ratio, needed, len(rank[0]) - 1), self.p.aim, method="higher"))
            cost = np.minimum((away <= ratio).sum(axis=1), probes).mean()
            if best is None or cost < best[0]:
                best = cost, probes, ratio
        _, self.probes, self.ratio = best

    def opens(self, x: np.ndarray, own: np.ndarray, floor: int) -> tuple[list[list[int]], list[int]]:
        """Lists of each query, nearest first: those within the limits, and in any case the nearest ones whose own
        vectors (``own``: how many have the list as their nearest) are ``floor``, or all lists. Also, how many of them
        come first: what holds that many, and ``first`` at least."""
        x = self.scale(x)
        ids, squared = self.graph.search(x, self.probes)
        size = np.where(ids >= 0, own[ids], 0)
        total = np.cumsum(size, axis=1)
        opened = (ids >= 0) & (_within(squared, self.ratio) | (total - size < floor))
        out = [row[keep].tolist() for row, keep in zip(ids, opened, strict=True)]
        first = (1 + (total < floor).sum(axis=1)).tolist()
        short = np.flatnonzero(total[:, -1] < floor)
        for at in range(0, len(short), 64):
            rows = short[at : at + 64]
            ids, _ = self.graph.every(x[rows], len(own))
            for i, row in zip(rows.tolist(), ids, strict=True):
                first[i] = min(1 + int(np.searchsorted(np.cumsum(own[row]), floor)), len(row))
                out[i] = row[: first[i]].tolist()
        return out, [min(max(n, self.p.first), len(row)) for n, row in zip(first, out, strict=True)]


def best_of(score: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k largest and of all that may tie with the last of them, if they reach the bound."""
    k = min(k, score.shape[1])
    least = np.maximum(np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k], bound)
    return np.nonzero(score >= (least - 1e-9 * (1 + np.abs(np.where(np.isfinite(least), least, 0))))[:, None])


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in one order wherever the pair is met."""
    return np.concatenate([np.zeros(0), *(np.cumsum(q[n : n + 20_000] * x[n : n + 20_000], axis=1)[:, -1] for n in range(0, len(q), 20_000))])


def top_pairs(queries: np.ndarray, q: np.ndarray, nodes: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, score) of each query's k best that reach its bound; ties go to the smaller node."""
    out = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
    for at in range(0, len(q) if len(x) else 0, 256):
        i, j = best_of(q[at : at + 256] @ x.T, k, bound[at : at + 256])
        score = exact(q[at + i], x[j])
        order = np.lexsort((nodes[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((queries[at + i[keep]], j[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _nearest(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table([i64([]), i64([]), f64(np.zeros(0))], names=["query", "found", "score"])
        x, nodes = _matrix(_column(left, "v")), _column(left, "node").to_numpy()
        query, j, score = top_pairs(_column(right, "query").to_numpy(), _matrix(_column(right, "v")), nodes, x, k, _column(right, "bound").to_numpy())
        return pa.table([i64(query), i64(nodes[j]), f64(score)], names=["query", "found", "score"])

    return run


def _top(rows: DataFrame, by: str, k: int) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), by))).filter(F.col("r") <= k)


def _trials(groups: DataFrame, nodes: np.ndarray, x: np.ndarray, k: int) -> list[np.ndarray]:
    """The true neighbours of a few vectors among all: each task hands on its own best."""
    shared = groups.sparkSession.sparkContext.broadcast((nodes, x))

    def run(batches):
        for batch in batches:
            nodes, q = shared.value
            trial, j, score = top_pairs(np.arange(len(q)), q, batch.column("node").to_numpy(), _matrix(batch.column("v")), k + 1, np.full(len(q), -np.inf))
            other = nodes[trial] != batch.column("node").to_numpy()[j]
            yield pa.RecordBatch.from_arrays([i64(trial[other]), f64(score[other]), *(batch.column(c).take(i64(j[other])) for c in ("node", "v"))], names=["query", "score", "node", "v"])

    v = groups.schema["v"].dataType.simpleString()
    best = _top(groups.select("node", "v").mapInArrow(run, f"query long, score double, node long, v {v}"), "node", k)
    rows = best.select("query", "v").toArrow()
    of, v = _column(rows, "query").to_numpy(), _matrix(_column(rows, "v"))
    return [v[of == i] for i in range(len(x))]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, p: Lists = Lists()) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for each query over all other rows.

    ``vectors`` and ``queries``: (vec_id, embedding); all usable vectors have one length. Null, zero and non-finite
    vectors take no part on either side. Equal vectors are indexed once; of each group, the k + 1 smallest ids can be
    among a query's k nearest, since ties go to the smaller id, and all its queries share one search. A query opens
    lists that hold more than k vectors, however near its first list is. An empty table gives no rows. Rows that repeat
    an id count as one, the smallest vector."""
    spark = vectors.sparkSession
    one = lambda rows: usable(rows).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("h", F.xxhash64("v"))
    # No more than k + 1 of equal vectors can be needed; the window limits before it shuffles.
    first = one(vectors).withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    groups = written(first.groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("v", "ids", F.element_at("ids", 1).alias("node")))
    stats = groups.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m")).first()
    if not stats.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = int(np.clip(stats.n // p.size, 1, p.most))
    want = min(p.sample * lists, p.sampled)
    share = min(1.0, 1.2 * want / stats.n + 16 / stats.n)
    picked = groups if share == 1 else groups.filter(F.xxhash64("node", F.lit(p.seed)).cast("double") < F.lit((share - 0.5) * 2.0**64))
    rows = picked.select("node", "v").limit(2 * want + 64).toArrow()
    nodes, sample = _column(rows, "node").to_numpy(), _matrix(_column(rows, "v"))
    opening = Opening(None, float(np.sqrt(stats.m)), p)
    lifted = opening.lift(sample)
    opening.graph = CentroidGraph(balanced_centroids(lifted, min(lists, len(lifted)), p), p)
    asked = np.random.default_rng(p.seed + 1).choice(len(sample), min(p.trials, len(sample)), replace=False)
    opening.measure(sample[asked], _trials(groups, nodes[asked], sample[asked], k))
    shared = spark.sparkContext.broadcast(opening)
    v = groups.schema["v"].dataType.simpleString()

    def listed(choose):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    found, first = choose(_matrix(part.column("v")))
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("v"), pa.array(found, type=pa.list_(pa.int64())), pa.array(first, type=pa.int32())], names=["node", "v", "lists", "first"])

        return lambda rows: rows.select("node", "v").mapInArrow(run, f"node long, v {v}, lists array<long>, first int")

    placed = written(listed(lambda x: (shared.value.places(x), [1] * len(x)))(groups))
    sizes = placed.groupBy(F.get("lists", F.lit(0)).alias("list")).agg(F.count("*").alias("own")).toPandas()
    own = np.zeros(len(opening.graph.c), dtype=np.int64)
    own[sizes["list"]] = sizes["own"]
    points = one(queries).groupBy("h", "v").agg(F.min("vec_id").alias("node"))
    opened = written(listed(lambda x: shared.value.opens(x, own, k + 1))(points)).withColumnRenamed("node", "query")

    def meet(held: DataFrame, asked: DataFrame) -> DataFrame:
        """(query, found, score) of vectors (node, v, list) and queries (query, v, bound, list) that share a list."""
        # A list is cut into segments and its queries into parts, both by hash; each pair is a group.
        segments = held.groupBy("list").agg(F.ceil(F.count("*") / p.segment).alias("segments"))
        parts = asked.groupBy("list").agg(F.ceil(F.count("*") / p.part).alias("parts"))
        both = F.broadcast(segments.join(parts, "list"))  # two numbers for each list
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = held.join(both, "list").select("list", F.pmod(F.xxhash64("node"), "segments").alias("segment"), each("parts").alias("part"), "node", "v")
        right = asked.join(both, "list").select("list", each("segments").alias("segment"), F.pmod(F.xxhash64("query"), "parts").alias("part"), "query", "v", "bound")
        key = ("list", "segment", "part")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_nearest(k + 1), "query long, found long, score double")

    nearest = opened.select("query", "v", F.lit(float("-inf")).alias("bound"), F.explode(F.slice("lists", F.lit(1), F.col("first"))).alias("list"))
    near = durable(_top(meet(placed.select("node", "v", F.get("lists", F.lit(0)).alias("list")), nearest), "found", k + 1))
    bounds = near.filter(F.col("r") == k + 1).select("query", F.col("score").alias("bound"))
    # A list that came first was met without the copies that are nearer to another list.
    every = opened.join(bounds, "query", "left").select("query", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), F.explode("lists").alias("list"))
    hits = meet(placed.select("node", "v", F.explode("lists").alias("list")), every)
    hits = hits.unionByName(near.drop("r")).groupBy("query", "found").agg(F.max("score").alias("score"))
    hits = _top(hits, "found", k + 1).join(groups.select(F.col("node").alias("found"), "ids"), "found")
    hits = _top(hits.select("query", "score", F.explode("ids").alias("vec_id")), "vec_id", k + 1)
    ranked = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("hits"))
    # Back to every query of the point: its own row goes, the first k of the rest stay.
    of = one(queries).join(points.withColumnRenamed("node", "query"), ["h", "v"]).select(F.col("vec_id").alias("query_id"), "query")
    mine = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)
    ranked = of.join(ranked, "query").select("query_id", F.posexplode(mine).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.minus")).alias("score"))


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.filter("vec_id % 20 = 0"))


QUERIES = {"op1_nearest": op1_nearest}
ORACLE_SQL: dict[str, str] = {}
