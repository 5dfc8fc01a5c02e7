import numpy as np
import pytest

from astroloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double, v string"


def brute(rows, asked, k=20):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            good[i] = np.array(v, dtype=np.float32).astype(float)
    out = {}
    for q in asked:
        if q in good:
            scored = sorted((-round(float(good[q] @ v), 12), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1, 0.0, "x") for i, v in rows], SCHEMA)
    out = {}
    for r in ann.search(frame, frame.filter("vec_id % 20 = 0"), **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 12)))
        assert r.rank == len(out[r.query_id])
    return out


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    rows += [(60, None), (80, [0.0] * 4), (100, [1.0, float("nan"), 0.0, 0.0]), (120, [1.0, None, 0.0, 0.0]), (140, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (61, []), (0, rows[0][1])]
    rows += [(200 + i, rows[40][1]) for i in range(90)] + [(300, [9.0, 9.0, 9.0, 9.0])]  # copies, more than k; a long one
    want = brute(rows, [i for i, _ in rows if i is not None and i % 20 == 0])
    got = found(spark, rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]])


def test_few_and_none(spark):
    assert found(spark, []) == {}
    assert found(spark, [(20, [1.0, 0.0])]) == {}
    assert found(spark, [(20, [1.0, 0.0]), (7, [2.0, 1.0]), (5, [2.0, 1.0])]) == {20: [(5, 2.0), (7, 2.0)]}


def test_segments_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    every = ann.Lists(size=100, aim=1.0, trials=600, segment=40, part=7)
    got, want = found(spark, rows, p=every), brute(rows, range(0, 600, 20))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_recall(spark, sf):
    got = {}
    for r in ann.op1_nearest(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    x, ids = np.stack([r.embedding for r in rows]).astype(float), np.array([r.vec_id for r in rows])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        order = np.lexsort((ids, -(x @ x[q])))
        true = set(ids[[i for i in order if i != q][:20]].tolist())
        hit, total = hit + len(true & got[int(ids[q])]), total + len(true)
    assert len(got) == (ids % 20 == 0).sum() and hit / total >= 0.95


def recall(spark, rows, **more):
    got, want = found(spark, rows, **more), brute(rows, [i for i, _ in rows if i % 20 == 0])
    return np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("shape", ["normal", "clustered"])
def test_recall_with_many_lists(spark, shape):
    """Far more lists than a query opens at first."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    if shape == "clustered":
        x = rng.normal(size=(150, 32))[rng.integers(0, 150, 6000)] + 0.2 * x
    assert recall(spark, [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], p=ann.Lists(size=16)) >= 0.9


def test_small_tight_groups_find_k(spark):
    """Queries that sit on a centroid of few vectors still get k rows."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 8)), 50 + 1e-4 * rng.normal(size=(3, 8))])
    rows = [(i + 1, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(1000, [50.0] * 8)]
    got = found(spark, rows, p=ann.Lists(size=4, aim=0.3))
    assert {len(v) for v in got.values()} == {20}


def test_ties_of_unequal_vectors(spark):
    """399 candidates of one score: the smallest ids win."""
    rows = [(i, [1.0, float(i), float(-i)]) for i in range(1, 400)] + [(400, [1.0, 0.0, 0.0])]
    got = found(spark, [(i, [a, b / 400, c / 400]) for i, (a, b, c) in rows])
    assert got[400] == [(i, 1.0) for i in range(1, 21)]
