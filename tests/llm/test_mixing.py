import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from astroloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target int, _rank double"


def brute(rows, mix=mixing.Mix()):
    """(doc_id, size, source_size, target, taken), by loops over sources and sorted documents."""
    size = lambda t: len(re.findall(mixing.WORDS, t or ""))
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    held = {s: sum(size(r[1]) for r in rows if r[2] == s) for s in names}
    weight = {s: mix.weights[k % len(mix.weights)] for k, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        level = (sum(held.values()) * mix.share - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if mix.most * held[s] < weight[s] * level}
        target |= {s: float(mix.most * held[s]) for s in over}
        free -= over
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
    out = []
    for s in names:
        quota = int(target[s] + 0.5)
        copies = quota // held[s] if held[s] else 0
        left = quota - copies * held[s]
        u = lambda r: (int(hashlib.sha256(f"{'' if r[0] is None else r[0]}:{r[1] or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (u(r), r[0] is not None, r[0])):
            more = min(size(r[1]), left)
            left -= more
            out.append((r[0], size(r[1]), held[s], target[s], copies * size(r[1]) + more))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r[:3], "x", 0, 0.0) for r in rows], SCHEMA)


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=str)


def test_against_loops(spark):
    rng = random.Random(1)
    text = lambda: rng.choice([" ", "\t", "\n"]).join(f"w{k}" for k in range(rng.choice([0, 1, 3, 10, 200])))
    rows = [(k, text(), "hot" if k % 3 == 0 else rng.choice(["a", "b", "tiny" if k < 40 else "c", None])) for k in range(300)]
    rows += [(300, "x " * 30_000, "long"), (301, None, "a"), (302, "", "void"), (7, "another text of seven", "a"), (None, "no id", "b"), (None, "nor here", "b")]
    rows += [rows[3]] * 3
    df = frame(spark, rows)
    got, want = result(mixing.mixed(df)), sorted(brute(rows), key=str)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert all(a[3] == pytest.approx(b[3]) for a, b in zip(got, want, strict=True))
    assert all(r[4] <= 3 * r[1] for r in got)
    assert result(mixing.mixed(df.repartition(7))) == got, "reruns agree however the rows lie"
    uneven = mixing.Mix((1.0, 100.0), 0.5, 2)
    assert sum(r[4] for r in result(mixing.mixed(df, uneven))) == pytest.approx(sum(r[4] for r in brute(rows, uneven)))


def test_one_source_and_none(spark):
    rows = [(1, "a b c", "s"), (2, "d", "s")]
    assert result(mixing.mixed(frame(spark, rows))) == [(1, 3, 4, 4.0, 3), (2, 1, 4, 4.0, 1)]
    assert result(mixing.mixed(frame(spark, [(1, None, None)]))) == [(1, 0, 0, 0.0, 0)]
    assert result(mixing.mixed(frame(spark, rows).limit(0))) == []


def test_inclusion(spark):
    """Over many draws a document is taken as often as its source's target over its size says."""
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").otherwise("z").alias("source"))
    got = mixing.mixed(docs).groupBy("source").agg(F.avg(F.col("taken") / F.col("size")).alias("copies"), F.avg(F.when(F.col("doc_id") < 6000, F.col("taken") / F.col("size"))).alias("early"), F.first("target"), F.first("source_size")).collect()
    for _, copies, early, target, size in got:
        assert copies == pytest.approx(target / size, abs=1e-3) and early == pytest.approx(target / size, abs=0.05)


def test_drawn(spark):
    rows = [(k, f"w{k} x y z", "s" if k < 3 else "t") for k in range(30)]
    docs = frame(spark, rows)
    mixture = mixing.mixed(docs)
    out = mixing.drawn(docs, mixture)
    assert out.columns == [*docs.columns, "repeat"]
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORDS))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in mixture.collect() if r.taken}


def test_sql(spark, small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    want = con.sql(mixing.ORACLE_SQL["op13_mixing"])
    got = mixing.op13_mixing(spark, small)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
