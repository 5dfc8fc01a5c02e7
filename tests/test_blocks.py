"""Ordered work on groups of any size, against plain Python, with one group of most rows."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from astroloom.operators import blocks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [("hot" if k % 3 else rng.choice(["a", "b", None]), k % 50, float(rng.randint(-9, 9)) if rng.random() < 0.8 else None, k) for k in range(600)]
    return out + [("one", 1, 2.0, 600), ("empty", 1, None, 601), ("hot", 7, 1.5, 602), ("hot", 7, 1.5, 602)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, t int, x double, id int")


def groups(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r[1], r[3])):
        found.setdefault(r[0], []).append(r)
    return found


def test_scan(frame, rows):
    got = sorted(blocks.scanned(frame, ["g"], ["t", "id"], {"total": F.col("x")}, {"seen": F.col("x")}).select("g", "t", "x", "id", "total", "seen").collect(), key=str)
    want = []
    for found in groups(rows).values():
        total = seen = None
        for r in found:
            if r[2] is not None:
                total, seen = (total or 0.0) + r[2], r[2]
            want.append((*r, total, seen))
    assert [tuple(r) for r in got] == sorted(want, key=str)


def test_neighbours_across_blocks(frame, rows):
    means = lambda w: {"mean": F.round(F.avg("x").over(w.rowsBetween(-2, 1)), 9), "prior": F.lag("id").over(w)}
    got = blocks.windowed(frame, ["g"], ["t", "id"], 2, 1, means, size=5).select("g", "id", "mean", "prior").collect()
    want = []
    for g, found in groups(rows).items():
        for k, r in enumerate(found):
            near = [q[2] for q in found[max(0, k - 2) : k + 2] if q[2] is not None]
            want.append((g, r[3], round(sum(near) / len(near), 9) if near else None, found[k - 1][3] if k else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_blocks_smaller_than_the_window_are_widened(frame):
    count = lambda w: {"n": F.count("*").over(w.rowsBetween(-40, 40))}
    hot = blocks.windowed(frame.filter("g = 'hot'"), ["g"], ["t", "id"], 40, 40, count, size=3).agg(F.max("n"), F.min("n")).first()
    assert tuple(hot) == (81, 41)


def test_places_of_equal_keys(spark):
    frame = spark.range(1000).select(F.lit(1).alias("g"), F.lit(5).alias("t"))
    assert sorted(r.place for r in blocks.placed(frame, ["g"], ["t"]).collect()) == list(range(1000))
    assert blocks.placed(frame.limit(0), ["g"], ["t"]).collect() == []


def test_quantiles(frame, rows):
    shares = {"low": 0.16, "mid": 0.5, "high": 0.84}
    got = {r.g: r for r in blocks.quantiles(frame, ["g"], "x", shares, hot=100).collect()}
    near = lambda df: sorted(str((r.g, round(r.low, 9), r.mid, round(r.high, 9))) for r in df.collect())
    assert near(blocks.spread_quantiles(frame, ["g"], "x", shares)) == near(blocks.quantiles(frame, ["g"], "x", shares))
    assert set(got) == {"hot", "a", "b", None, "one"}
    for g, r in got.items():
        x = [q[2] for q in rows if q[0] == g and q[2] is not None]
        assert r.mid == statistics.median(x)
        assert np.allclose([r.low, r.high], np.quantile(x, [0.16, 0.84]))
    assert blocks.quantiles(frame, [], "x", {"mid": 0.5}).first().mid == statistics.median(q[2] for q in rows if q[2] is not None)


def test_no_task_holds_a_group(frame):
    """Windows are cut by range or block, never by the group alone."""
    plan = blocks.scanned(frame, ["g"], ["t", "id"], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_scan_p" in plan


def test_light_curves_with_a_hot_source(spark, monkeypatch):
    """Detrending, medians, differences and statistics in small blocks and ranges give what one window for each source
    gives; a third of all samples are one source's."""
    from astroloom.operators import timeseries as ts

    rng = random.Random(8)
    rows = [(0 if k % 3 == 0 else k % 40, "r", rng.random() * 30 + (20 if rng.random() < 0.3 else 0), 10 + rng.random(), 0) for k in range(900)]
    lc = spark.createDataFrame([*rows, (5, "r", float("nan"), 1.0, 0), (5, "r", 1.0, float("inf"), 0)], "source int, band string, t double, mag double, flag int")
    lc = ts.good(lc)
    assert lc.count() == 900

    def results():
        flat = ts.detrend_rolling(lc, 2, 1.5).select("source", "t", "run", F.round("trend", 9), F.round("flat", 9))
        smooth = ts.running_median(lc, 2).select("source", "t", F.round("smooth", 9))
        diff = ts.difference_features(lc).select("source", F.round("diff_abs", 9), F.round("p75", 9))
        stats = ts.statistics(lc).select("source", "n", F.round("mag_median", 9), F.round("rel_semi_amp", 9))
        mid = ts.centred(lc).select("source", "t", F.round("c", 9), F.round("lifted", 9))
        return [sorted(map(tuple, df.collect())) for df in (flat, smooth, diff, stats, mid)]

    want = results()
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "HOT", 50)
    assert results() == want
    found = {}
    for s, _, t, m, _ in sorted(rows, key=lambda r: (r[0], r[2])):
        found.setdefault(s, []).append(m)
    smooth = {s: [round(statistics.median(m[max(0, k - 2) : k + 3]), 9) for k in range(len(m))] for s, m in found.items()}
    assert [r[2] for r in want[1]] == [v for s in sorted(smooth) for v in smooth[s]]
    assert {r[0]: r[2] for r in want[3]} == {s: round(statistics.median(m), 9) for s, m in found.items()}
