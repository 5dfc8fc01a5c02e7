"""Steps whose work must follow their input: what they hand on is counted on small tables that show it."""

import itertools
import math
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from astroloom.functions import astro
from astroloom.operators import corpus, fields, nearest, pruned, retrieval, sky, timeseries


def shuffled(spark, df):
    """The rows of a query, and how many rows its stages wrote for others."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    rows = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return rows, written() - before


FACT = "id long, kind string, value double, entities array<long>, terms array<string>"


def test_conflicts_hand_on_no_candidates(spark):
    """Facts of two entities, each of which many others name too: only equal pairs are alike."""
    facts = [(2 * n + half, "k", 1.0 + half, [i, 100 + j], ["t"]) for n, (i, j) in enumerate(itertools.product(range(40), range(40))) for half in (0, 1)]
    df = spark.createDataFrame(facts, FACT)
    rows, n = shuffled(spark, corpus.conflicts(df.filter("id % 2 = 1"), df.filter("id % 2 = 0")))
    assert sorted((r.n_id, r.o_id) for r in rows) == [(2 * n + 1, 2 * n) for n in range(1600)]
    assert n < 40_000  # pairs that share an entity are 64,000 for each half of the product


def test_conflicts_of_all_sizes(spark):
    """Against every pair, for sets from 1 to 40 entities, with repeated and missing ones."""
    draw = random.Random(5)
    facts = []
    for n in range(400):
        base = random.Random(draw.randrange(30))
        e = base.sample(range(200), base.choice([1, 2, 3, 4, 5, 6, 8, 11, 13, 16, 17, 20, 40]))
        e = [x for x in e if draw.random() > 0.06] + draw.sample(range(200), draw.choice([0, 0, 1, 2]))
        facts.append((n, "k", draw.choice([1.0, 2.0, 50.0]), e + e[:1] + [None] * draw.choice([0, 1]), draw.choice([["a"], ["a", "b"]])))
    df = spark.createDataFrame(facts, FACT)
    got = corpus.conflicts(df.filter("id % 2 = 1"), df.filter("id % 2 = 0")).collect()
    want = set()
    for a, b in itertools.product(facts[1::2], facts[::2]):
        x, y = set(a[3]) - {None}, set(b[3]) - {None}
        if x and y and x & y and abs(a[2] - b[2]) > 0.2 * max(a[2], b[2], 1):
            if round(0.6 * len(x & y) / max(len(x), len(y)) + 0.4 * len(set(a[4]) & set(b[4])) / len(set(a[4]) | set(b[4])), 6) > 0.85:
                want.add((a[0], b[0]))
    assert want and sorted((r.n_id, r.o_id) for r in got) == sorted(want)
    assert max(len(set(facts[a][3])) for a, _ in want) > 16


def workers():
    """Python workers of this machine's Spark."""
    for p in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{p}/cmdline") as f:
                if "pyspark" in f.read():
                    yield p
        except OSError:
            pass


def test_vector_search_holds_a_tile(spark):
    """Forty million pairs of one batch, none of them below the threshold, with copies and null vectors; a worker's peak."""
    x = F.array(*[F.sin(F.col("id") % 5000 * k + k) for k in (1.0, 2.0, 3.0, 4.0)])
    rows = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 != 999, x).alias("embedding"))
    asked = rows.filter("doc_id < 4000").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("q"))
    for p in workers():
        with open(f"/proc/{p}/clear_refs", "w") as f:
            f.write("5")
    got = retrieval.vector_search(rows, asked, 3, -1.0).collect()
    peaks = []
    for p in workers():
        with open(f"/proc/{p}/status") as f:
            peaks += [int(line.split()[1]) / 1024 for line in f if line.startswith("VmHWM")]
    assert len(got) == 3 * (4000 - 4)
    assert all(r.score >= 1 - 2e-6 for r in got if r["rank"] == 1)
    assert max(peaks) < 1000


def test_flux_of_a_huge_magnitude(spark):
    """Its flux is zero, which is no division by zero."""
    flux = spark.createDataFrame([(20.0,), (1000.0,)], "mag double").withColumn("flux", astro.mag_to_flux(F.col("mag")))
    rows = flux.select(F.round(astro.mag_error(F.col("flux"), 0.02 * F.col("flux")), 6).alias("e")).collect()
    assert [r.e for r in rows] == [0.021715, None]


def test_pdm_ties_despite_the_order_of_sums(spark):
    """Two periods whose thetas differ in the last bit only: the shorter is the best."""
    rows = [(1, 0, 1.0, 0.1 + 0.2), (1, 1, 2.0, 0.3), (1, 2, 3.0, 0.9)]
    best = timeseries.pdm_best(spark.createDataFrame(rows, "source long, k int, period double, theta double")).first()
    assert (best.period, best.theta, best.period_error) == (1.0, 0.3, 0.5)


def test_periodograms_shuffle_samples_alone(spark):
    """Sources spread over all tasks: neither they nor their sums meet the grid before they are shuffled."""
    sample = F.struct((F.col("id") % 200).alias("source"), F.lit("b").alias("band"), (F.col("id") / 77.0).alias("t"), (F.sin("id") + 3).alias("mag"), F.lit(0).alias("flag"))
    lc = spark.range(0, 4000, 1, 4).select(sample.alias("s")).select("s.*")
    for found in (timeseries.prewhiten(lc, 0.05, 1.0, 50), timeseries.pdm(lc, 1.0, 20.0, 50)):
        rows, n = shuffled(spark, found)
        assert len(rows) in (400, 10_000)
        assert n < 20_000  # partial sums would be 40,000 a search


def test_large_sources_stay_spread(spark):
    """Sources above a limit take another way to the same sums."""
    lc = spark.range(0, 600, 1, 3).select(F.expr("IF(id % 3 = 0, id % 5, 9)").alias("source"), (F.col("id") / 7.0).alias("t"), F.sin("id").alias("mag"))
    count = lambda rows: rows.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("mag"), 6).alias("s"))
    plain = sorted(map(tuple, count(lc).collect()))
    assert sorted(map(tuple, timeseries.by_source(lc, count, 100).collect())) == plain
    assert sorted(map(tuple, timeseries.by_source(lc, count).collect())) == plain


def test_nearest_meets_few_of_a_dense_catalogue(spark, monkeypatch):
    """All of a catalogue lies within the radius of most targets, some of which have fewer matches than asked for."""
    u = lambda name: F.pmod(F.xxhash64("id", F.lit(name)), F.lit(100_003)) / 100_003
    spot = lambda n, wide: spark.range(n).select("id", (358.5 + wide * u(f"ra{n}")).alias("ra"), (10 + u(f"dec{n}")).alias("dec"))
    stars = spot(20_000, 1.0)
    targets = spot(500, 1.0).unionByName(spark.createDataFrame([(900, 1.4, 10.5), (901, 180.0, 0.0)], "id long, ra double, dec double"))
    met, plain = [], sky.cross_match
    monkeypatch.setattr(sky, "cross_match", lambda t, c, r: met.append(t.count() * c.count() if r >= 3 else sky.pairs_met(t, c, r)) or plain(t, c, r))
    got = {(r.target, r["rank"]): (r.id, r.sep and round(r.sep, 9)) for r in sky.nearest(targets, stars, 3.0, 2).collect()}
    assert max(met) <= sky.MET * 2 * (502 + 20_000)  # the full radius meets 10 million
    all_ = targets.select(F.col("id").alias("target"), "ra", "dec").crossJoin(stars.select("id", F.col("ra").alias("ra2"), F.col("dec").alias("dec2")))
    all_ = all_.withColumn("sep", astro.separation(F.col("ra"), F.col("dec"), F.col("ra2"), F.col("dec2"))).filter("sep <= 3")
    best = all_.groupBy("target").agg(F.slice(F.array_sort(F.collect_list(F.struct("sep", "id"))), 1, 2).alias("h")).collect()
    want = {(r.target, i + 1): (h.id, round(h.sep, 9)) for r in best for i, h in enumerate(r.h)} | {(901, None): (None, None)}
    assert len(want) == 501 * 2 + 1
    assert got == want


def test_searches_index_asked_terms_alone(spark, small, monkeypatch):
    """Queries that only search for the benchmark items write no posting of another term."""
    from astroloom.plans import knowledge, training

    for module, name in ((knowledge, "merged_retrieval"), (training, "augmented_training_set")):
        held, index = [], module._index
        monkeypatch.setattr(module, "_index", lambda *a: held.append(index(*a)) or held[-1])
        getattr(module, name)(spark, small)
        asked = retrieval.query_terms(module._asked(spark, small))
        assert held[0][0].join(asked, "term", "left_anti").count() == 0


def letters(n):
    return "".join(chr(97 + int(c)) for c in f"{n:03d}")


def test_keyword_search_shuffles_postings_once(spark, monkeypatch):
    """Against plain Python, with repeated and null ids, documents without terms and equal scores."""
    draw = random.Random(3)
    docs = [(n, " ".join(letters(draw.randrange(60)) for _ in range(draw.randrange(30)))) for n in range(1500)]
    asked = [(q, letters(t), 1 + q % 2) for q in range(40) for t in draw.sample(range(70), 8)]
    queries = spark.createDataFrame(asked, "qid long, term string, m long")

    def want(docs, value, k, least):
        out = set()
        index = [(i, len(x.split()), {t: x.split().count(t) for t in x.split()}) for i, x in docs]
        df = {letters(t): sum(letters(t) in held for _, _, held in index) for t in range(70)}
        for q in range(40):
            terms = [(t, m) for p, t, m in asked if p == q]
            hits = [(-round(sum(m * value(held[t], n, df[t]) for t, m in terms if t in held), 6), i, sum(t in held for t, _ in terms)) for i, n, held in index]
            best = sorted(h for h in hits if h[2] >= least)[:k]
            out |= {(q, i, -s, m, r) for r, (s, i, m) in enumerate(best, 1)}
        return out

    values = {"count": lambda tf, n, df: 1.0, "idf": lambda tf, n, df: math.log(1500 / (df + 1)) + 1, "tfidf": lambda tf, n, df: tf / n * (math.log(1501 / (df + 1)) + 1)}
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for method, value in values.items():
        rows, n = shuffled(spark, retrieval.keyword_search(retrieval.postings(frame, queries, 1500), 1500, queries, method, 3, 2))
        assert {tuple(r) for r in rows} == want(docs, value, 3, 2)
        assert n < 1.5 * retrieval.postings(frame, queries, 1500).count()  # nor is a sum of a query and a document
    again = spark.createDataFrame([*docs, docs[7], (None, docs[9][1])], "doc_id long, text string")
    once, twice = (retrieval.postings(again, queries, n) for n in (1502, None))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    assert once.filter("doc_id IS NULL").count() and max(r.n for r in once.groupBy("term", "doc_id").agg(F.count("*").alias("n")).collect()) == 1
    monkeypatch.setattr(retrieval, "ASKED", 50)  # block by block of queries
    got = retrieval.keyword_search(retrieval.postings(frame, queries, 1500), 1500, queries, "count", 3, 2)
    assert {tuple(r) for r in got.collect()} == want(docs, values["count"], 3, 2)


def test_tiles_of_documents_and_queries(monkeypatch):
    """A task's rows in batches that cut documents, a tile of one document at a time and all at once."""
    rows = [(d // 2 if d else None, d * 7 % 5, float(d % 4)) for d in range(60)]
    ids, t, x = zip(*rows, strict=True)
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(t, pa.int32()), pa.array(x)], names=["doc_id", "t", "x"])
    starts = np.array([0, 2, 3, 3, 5, 6])
    terms = (starts, np.array([0, 1, 1, 0, 2, 2]), np.array([1.0, 2, 3, 1, 1, 2]), pa.array([10, 20, 30]), [])

    def best():
        found = pa.Table.from_batches(retrieval._best((batch.slice(a, 7) for a in range(0, 60, 7)), terms, 2, 1, None)).to_pylist()
        return {q: sorted((-r["score"], r["doc_id"] or 0, r["matched"]) for r in found if r["qid"] == q)[:2] for q in (10, 20, 30)}

    all_at_once = best()
    for name, value in (("PAIRS", 1), ("TILE", 7)):
        monkeypatch.setattr(retrieval, name, value)
        assert best() == all_at_once
    assert all(len(h) == 2 for h in all_at_once.values())


def test_field_search_shuffles_no_pairs(spark):
    """Names in queries and queries in names, against every pair in plain Python."""
    draw = random.Random(8)
    words = [letters(n) for n in range(25)]
    entries = [(n, " ".join(draw.choices(words, k=draw.choice([0, 1, 2, 2, 2]))), " ".join(draw.choices(words, k=20))) for n in range(800)]
    queries = [(q, " ".join(draw.choices(words, k=draw.choice([1, 2, 6, 15])))) for q in range(40)] + [(40, ""), (41, None)]
    frame = spark.createDataFrame(entries, "doc_id long, key string, content string").repartition(3)
    rows, n = shuffled(spark, fields.field_search(frame, spark.createDataFrame(queries, "qid long, text string"), 4))
    want = set()
    for q, text in queries:
        asked, hits = (text or "").split(), []
        for d, key, content in entries:
            keyed, held = (len(set(x.split()) & set(asked)) for x in (key, content))
            same = keyed and (f" {key} " in f" {text} " or f" {text} " in f" {key} ")
            hits += [(-(3 * keyed + held + 10 * bool(same)), d)] if keyed or held else []
        want |= {(q, d, -s, r) for r, (s, d) in enumerate(sorted(hits)[:4], 1)}
    assert {(r.qid, r.doc_id, r.score, r["rank"]) for r in rows} == want and max(s for *_, s, _ in want) > 20
    assert n < 25_000  # pairs of a query and an entry are 32,000


def test_field_search_of_entries_that_share_nothing(spark):
    """Tasks whose last entry, or all, share no word with any query; a query without an id has no rows."""
    entries = [(0, "star dust", "star dust\n\ndust"), *((n, "", "") for n in range(1, 9)), (9, None, None), (10, "moon", "moon rock")]
    queries = spark.createDataFrame([(1, "red star"), (2, "star dust falls"), (3, "comet"), (None, "star dust")], "qid long, text string")
    got = fields.field_search(spark.createDataFrame(entries, "doc_id long, key string, content string"), queries, 2).collect()
    assert sorted((r.qid, r.doc_id, r.score, r["rank"], r.best) for r in got) == [(1, 0, 4, 1, "star dust"), (2, 0, 18, 1, "star dust")]
    nothing = fields.field_search(spark.createDataFrame(entries[1:9], "doc_id long, key string, content string"), queries, 2)
    assert nothing.count() == 0


def test_planes_shuffle_no_pairs(spark, monkeypatch):
    """Copies and near copies, which share their buckets: as exact search gives them, in one block of queries and in many."""
    x = F.array(*[F.sin(F.col("id") % 7 * 0.01 * k + k) for k in (1.0, 2.0, 3.0, 4.0)])
    rows = spark.range(0, 2000, 1, 3).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 != 999, x).alias("embedding"))
    queries = rows.filter("doc_id % 10 = 0 OR doc_id = 999").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("q"))
    want = sorted(map(tuple, retrieval.vector_search(rows, queries).collect()))
    got, n = shuffled(spark, nearest.VectorIndex.of(rows).search(queries))
    assert sorted(map(tuple, got)) == want and len(want) == 5 * 200
    assert n < 20_000  # pairs that share a bucket are 400,000
    monkeypatch.setattr(nearest, "HELD", 10_000)
    assert sorted(map(tuple, nearest.VectorIndex.of(rows).search(queries).collect())) == want


def handed_on(spark, do):
    """What ``do`` returns, and how many rows its stages wrote for others, those it runs on the way too."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    return do(), written() - before


def test_pruned_search_shuffles_no_pairs(spark, monkeypatch):
    """Few words, so that most documents meet most queries; with null, empty and repeated texts, in one block of queries and in many."""
    draw = random.Random(4)
    docs = [(n, " ".join(letters(draw.randrange(40)) for _ in range(draw.choice([3, 20, 60])))) for n in range(2000)]
    docs += [(2000, None), (2001, ""), *((2010 + n, docs[n][1]) for n in range(50))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(q, letters(t), 1 + q % 2) for q in range(60) for t in draw.sample(range(45), 8)] + [(None, letters(1), 1)], "qid long, term string, m long")
    index, n = pruned.ImpactIndex.of(frame, len(docs), queries), retrieval.postings(frame, queries).count()
    for method, least in (("tfidf", 1), ("idf", 1), ("count", 2)):
        full = retrieval.keyword_search(retrieval.postings(frame, queries), len(docs), queries.filter("qid IS NOT NULL"), method, 3, least)
        want = sorted(map(tuple, full.collect()))
        got, rows = handed_on(spark, lambda: pruned.keyword_search(index, queries, method, 3, least).collect())  # noqa: B023
        assert sorted(map(tuple, got)) == want and len(want) == 180
        if method == "tfidf":
            assert rows < 3 * n  # a query and a document that meet are 100,000 pairs
    monkeypatch.setattr(pruned, "ASKED", 500)
    assert sorted(map(tuple, pruned.keyword_search(index, queries, "count", 3, 2).collect())) == want
    none = spark.createDataFrame([(1, "nebula", 1)], "qid long, term string, m long")
    assert pruned.keyword_search(index, none, "tfidf").count() == 0
    assert pruned.keyword_search(pruned.ImpactIndex.of(frame, len(docs), none), none, "tfidf").count() == 0
