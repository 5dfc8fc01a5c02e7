import math
import random

import numpy as np
import pytest

from astroloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, component string, n int, x string, index string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "c", 1, "x", "i", 2) for i, x in rows], SCHEMA)


def check(spark, rows, components=8):
    """Every column against numpy over the whole matrix; projections up to a component's sign."""
    kept = [(i, [math.floor(1024 * v) + 100_000 for v in x]) for i, x in rows]
    x, n = np.array([v for _, v in kept], dtype=float), len(kept)
    total = [sum(v) for v in zip(*(v for _, v in kept))]
    centred = x - np.array([s / n for s in total])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    got = {}
    for r in whitening.whitened(frame(spark, rows)).collect():
        got.setdefault(r.component, []).append(r)
    k = min(components, x.shape[1])
    assert sorted(got) == list(range(1, k + 1))
    for c, found in got.items():
        want = centred @ basis[:, c - 1] / np.sqrt(values[c - 1])
        # Rows are matched by id and deviation; ids repeat only in equal rows.
        key = lambda i, v: (i is None, i or 0, sum((n * a - s) ** 2 for a, s in zip(v, total)))
        order = sorted(range(n), key=lambda j: key(*kept[j]))
        found.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0, math.inf if r.deviation is None else r.deviation))
        assert [r.vec_id for r in found] == [kept[j][0] for j in order]
        assert [r.deviation for r in found] == [v if (v := key(*kept[j])[2]) < 1 << 63 else None for j in order]
        have = np.array([r.whitened for r in found])
        assert np.allclose(have, want[order], atol=1e-6) or np.allclose(have, -want[order], atol=1e-6)
        assert found[0].explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-6)
        assert {r.n for r in found} == {n} and all(r.identity_error < 1e-6 for r in found)


def test_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)  # many blocks
    rng = random.Random(4)
    rows = [(k, [rng.gauss(j, 1 + j) for j in range(10)]) for k in range(300)]
    rows += [rows[0], rows[0], (None, [1.5] * 10)]
    check(spark, rows)


def test_few_dimensions(spark):
    rng = random.Random(4)
    check(spark, [(k, [rng.gauss(0, 1), rng.gauss(0, 3)]) for k in range(50)])


def test_odd_rows(spark):
    rng = random.Random(4)
    good = [(k, [rng.gauss(0, 1 + j) for j in range(9)]) for k in range(40)]
    odd = [(90, None), (91, []), (92, [None] * 9), (93, [float("nan")] * 9), (94, [float("-inf")] + [0.0] * 8), (95, [1.0] * 3)]
    want = whitening.whitened(frame(spark, good)).select("vec_id", "component", "deviation", "n")
    got = whitening.whitened(frame(spark, good + odd)).select("vec_id", "component", "deviation", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert whitening.whitened(frame(spark, good).limit(0)).collect() == []
    assert whitening.whitened(frame(spark, odd[:2])).collect() == []


def test_without_variance(spark):
    for rows in ([(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)]):
        out = whitening.whitened(frame(spark, rows)).collect()
        assert len(out) == 2 * len(rows) and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in out} == {(0.0, 0.0, 0, 0.0)}
    line = whitening.whitened(frame(spark, [(k, [float(k), 5.0]) for k in range(20)])).collect()
    assert all(r.whitened == 0 for r in line if r.component == 2) and all(r.identity_error < 1e-6 for r in line)


def test_far_entries(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])]
    out = whitening.whitened(frame(spark, rows)).collect()
    assert len(out) == 6 and all(r.deviation is None for r in out if r.vec_id < 3)
    wide = [(k, [1e3 * k, -3.0 * (k % 7), 2.0 * (k * k % 11)]) for k in range(400)]
    check(spark, wide)
    assert any(r.deviation is not None for r in whitening.whitened(frame(spark, wide)).collect())


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check(spark, [(r.vec_id, [float(v) for v in r.embedding]) for r in df.select("vec_id", "embedding").collect()])
    assert whitening.op12_whitening(spark, "/root/testdata/sf0.001").count() == 8 * df.count()
