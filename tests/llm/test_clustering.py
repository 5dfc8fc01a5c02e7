import hashlib
import math
import random

import numpy as np
import pytest

from astroloom.llm import clustering

SMALL = clustering.Clustering(k=4, rounds=3, dim=4, slab=7)
SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, ids string"


def brute(rows, c):
    """The rows of clustered(), vector by vector with Python's integers."""
    kept = [(i, [math.floor(c.scale * float(v)) for v in x]) for i, x in rows if x is not None and len(x) == c.dim and all(v is not None and math.isfinite(v) for v in x)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{c.seed}{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(x) for _, x in hashed[: c.k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, m)), j) for j, m in enumerate(centroids)) for _, x in kept]

    for _ in range(c.rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [x for (_, x), (_, k) in zip(kept, found) if k == j]
            if mine:
                centroids[j] = [sum(v) // len(mine) for v in zip(*mine)]
    found = assign()
    inertia = lambda j: sum(d for d, k in found if j is None or k == j)
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    return [(i, k, d, inertia(k), inertia(None), digest[k]) for (i, _), (d, k) in zip(kept, found)]


def check(spark, rows, config):
    df = spark.createDataFrame([(i, x, "x", 0, "y") for i, x in rows], SCHEMA)
    seen = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats hold them
    got = [tuple(r) for r in clustering.clustered(df, config=config).collect()]
    assert sorted(got, key=str) == sorted(brute(seen, config), key=str)
    return got


def test_against_loops(spark):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [(k, [float(k % 3)] * 4) for k in range(60, 90)]
    rows += [(90, None), (91, [1.0, 2.0]), (92, [1.0, None, 0.0, 0.0]), (93, [float("nan")] * 4), (94, [float("inf"), 0.0, 0.0, 0.0]), (95, []), (96, [0.0] * 5), (None, [0.5] * 4), rows[0], rows[0]]
    assert len(check(spark, rows, SMALL)) == 93
    assert check(spark, rows[:3], SMALL), "fewer vectors than centroids"
    assert check(spark, rows[90:93], SMALL) == []
    assert check(spark, [(k, [1.0] * 4) for k in range(9)], SMALL), "equal centroids: the later ones stay empty"


def test_far_components(spark):
    rows = [(k, [1e6 * (k % 5), -3e6, 2.5, float(k)]) for k in range(30)] + [(99, [2e7, 0.0, 0.0, 0.0])]
    assert check(spark, rows, SMALL)
    df = spark.createDataFrame([(1, [1e30] * 4), (2, [-1e30] * 4), (3, [0.0] * 4)], "vec_id long, embedding array<float>")
    out = clustering.clustered(df, config=clustering.Clustering(k=1, rounds=1, dim=4)).collect()
    assert {r.vec_id: r.distance for r in out} == {1: clustering.LONG, 2: clustering.LONG, 3: 0}


@pytest.mark.parametrize("values", [2, 40, 10_000])
def test_encoding_is_lossless(values):
    rng = np.random.default_rng(2)
    x = rng.integers(-values, values, (500, 8))
    width, subs, codes = clustering.encode(x, 40)
    assert (np.concatenate([s[c] for s, c in zip(subs, codes)], axis=1) == x).all()
    assert all(len(np.unique(s, axis=0)) == len(s) for s in subs)
    assert width == {2: 2, 40: 1, 10_000: 8}[values]  # in the last nothing repeats


def test_whole_table(spark):
    """Production parameters over the whole table of sf0.001, slabs and all, against loops over numpy rows."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    c = clustering.Clustering()
    rows = df.select("vec_id", "embedding").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows])).astype(np.int64)
    ids = np.array([r.vec_id for r in rows])
    centroids = x[np.argsort([hashlib.sha256(f"2:{i}".encode()).hexdigest() for i in ids])[:40]]
    apart = lambda: ((x[:, None, :] - centroids[None]) ** 2).sum(2)
    for _ in range(c.rounds):
        near = apart().argmin(1)
        centroids = np.array([x[near == j].sum(0) // (near == j).sum() if (near == j).any() else centroids[j] for j in range(40)])
    d = apart()
    got = {r.vec_id: r for r in clustering.op11_clustering(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(ids)
    for i, row in zip(ids, d):
        assert (got[i].cluster, got[i].distance) == (row.argmin(), row.min())
        assert got[i].inertia == d.min(1).sum()
