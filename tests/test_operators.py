"""Small fixtures with known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from astroloom.functions import astro, text, vectors
from astroloom.operators import corpus, evaluation, models, retrieval, sky
from astroloom.operators import timeseries as ts
from astroloom.sources import readers, sinks

LC = "source string, band string, t double, mag double, flag int"


def sine(spark, period, n=400, second=0.0):
    rows = [("a", "g", k * 0.05, 15 + 0.3 * math.sin(2 * math.pi * k * 0.05 / period) + second * math.sin(2 * math.pi * k * 0.05 * 1.4), 0) for k in range(n)]
    return spark.createDataFrame(rows, LC)


def test_periods_are_found(spark):
    lc = sine(spark, 1.7)
    assert abs(ts.pdm_best(ts.pdm(lc, 1.0, 2.5, 151)).first().period - 1.7) < 0.011
    best = ts.best_frequency(ts.lomb_scargle(lc, 0.1, 2.0, 381)).first()
    assert abs(1 / best.freq - 1.7) < 0.02 and abs(best.amplitude - 0.3) < 0.01 and best.power > 0.99


def test_prewhitening_finds_the_second(spark):
    found = {r.round: r.freq for r in ts.prewhiten(sine(spark, 1.7, second=0.1), 0.1, 2.0, 381).collect()}
    assert abs(found[1] - 1 / 1.7) < 0.01 and abs(found[2] - 1.4) < 0.02


def test_constant_and_short_curves(spark):
    flat = spark.createDataFrame([("c", "g", float(k), 5.0, 0) for k in range(12)] + [("s", "g", float(k), float(k), 0) for k in range(9)], LC)
    assert {(r.source, r.theta) for r in ts.pdm(flat, 1.0, 2.0, 3).collect()} == {("c", 1.0)}
    assert {r.source for r in ts.lomb_scargle(flat, 0.1, 0.4, 3).collect()} == {"c"}


def test_clip_and_peaks(spark):
    lc = spark.createDataFrame([("a", "g", float(k), 1.0 + 0.01 * (k % 2), 0) for k in range(30)] + [("a", "g", 99.0, 50.0, 0)], LC)
    assert ts.sigma_clip(lc).count() == 30
    series = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([0, 5, 0, 9, 0, 0, 0, 4, 0])], "source string, k long, power double")
    assert sorted(r.k for r in ts.peaks(series, 1.0, 2).collect()) == [3, 7]
    assert ts.peak_ladder(series, 2, 2).first().n_peaks >= 2


@pytest.mark.parametrize("radius", [0.5, 5.0])
def test_cross_match_against_brute_force(spark, radius):
    rng = random.Random(1)
    points = [(k, rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for k in range(150)]
    points += [(200, 0.0, 0.0), (201, 359.9999, 0.0), (202, 10.0, 89.9), (203, 190.0, 89.95), (204, 100.0, -89.99), (205, 280.0, -90.0), (206, 0.0, 90.0), (207, 360.0, 45.0), (208, 0.01, 45.0)]
    cat = spark.createDataFrame(points, "id long, ra double, dec double")

    def sep(a, b):
        (_, r1, d1), (_, r2, d2) = ((i, math.radians(r), math.radians(d)) for i, r, d in (a, b))
        h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
        return math.degrees(2 * math.asin(min(1, math.sqrt(h))))

    want = {(a[0], b[0]) for a in points for b in points if sep(a, b) <= radius}
    assert {(r.target, r.id) for r in sky.cross_match(cat, cat, radius).collect()} == want
    for ra, dec in ((0.1, 45.0), (50.0, 89.7), (180.0, 0.0)):
        assert {r.id for r in sky.cone(cat, ra, dec, radius).collect()} == {p[0] for p in points if sep((0, ra, dec), p) <= radius}
    alone = spark.createDataFrame([(1, 0.0, 0.0)], "id long, ra double, dec double")
    assert sky.nearest(alone, cat.filter("dec > 80"), 0.1).first().id is None


def test_healpix_is_equal_area_and_whole(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(rng.uniform(0, 360), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(6000)], "ra double, dec double")
    pixels = [r[0] for r in rows.select(astro.healpix_ring(F.col("ra"), F.col("dec"), 2)).collect()]
    counts = [pixels.count(k) for k in range(48)]
    assert min(pixels) == 0 and max(pixels) == 47 and min(counts) > 70 and max(counts) < 190
    edge = spark.createDataFrame([(0.0, 90.0), (0.0, -90.0), (360.0, 0.0)], "ra double, dec double").select(astro.healpix_ring(F.col("ra"), F.col("dec"), 2).alias("p")).collect()
    assert [r.p for r in edge][:2] == [0, 44] and 0 <= edge[2].p < 48


def test_names_and_coordinates(spark):
    one = spark.createDataFrame([(13.1316, 53.8585), (278.5, -16.25)], "ra double, dec double").select(astro.sexagesimal_name(F.col("ra"), F.col("dec")).alias("n")).collect()
    assert one[0].n.startswith("J005231.58+53513") and one[1].n == "J183400.00-161500.0"
    # Sentences and the positions that stand in them.
    golden = [("分析 13.1316, 53.8585", 13.1316, 53.8585), ("查询 150.5 23.8", 150.5, 23.8), ("RA=150.5 DEC=23.8", 150.5, 23.8), ("200.5, -30.2", 200.5, -30.2), ("看看这个天体 100.0 50.0", 100.0, 50.0), ("普通问题，没有坐标", None, None)]
    out = spark.createDataFrame([(t,) for t, _, _ in golden], "t string").select(text.coordinates(F.col("t")).alias("c")).collect()
    for (_, ra, dec), r in zip(golden, out):
        assert (r.c is None) == (ra is None) and (ra is None or (abs(r.c.ra - ra) < 1e-4 and abs(r.c.dec - dec) < 1e-4))


def test_hallucination_rules(spark):
    # Sentences and whether they break a rule.
    golden = [("AM CVn 是一个包含白矮星和中子星的双星系统。", True), ("AM CVn 系统的周期通常在 5-65 分钟之间，由白矮星和氦星组成。", False), ("激变变星的光变主要是由潮汐相互作用引起的。", True), ("造父变星的周期-光度关系可以用来测量星系距离。", False)]
    out = spark.createDataFrame([(t,) for t, _ in golden], "t string").select(evaluation.breaks_rule(F.col("t"), evaluation.HALLUCINATIONS).alias("b")).collect()
    assert [r.b for r in out] == [b for _, b in golden]


def test_chunk_lengths(spark):
    sizes = [0, 1, 1200, 1201, 1500, 1501]
    out = spark.createDataFrame([(k, "x" * n) for k, n in enumerate(sizes)], "doc_id long, text string")
    counts = {r.doc_id: r.n for r in corpus.chunked(out).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert [counts.get(k, 0) for k in range(6)] == [0, 1, 1, 2, 2, 2]


def test_fusion(spark):
    hits = lambda *ids: spark.createDataFrame([(1, i, s, k + 1) for k, (i, s) in enumerate(ids)], "qid long, doc_id long, score double, rank int")
    out = {r.doc_id: (r.score, r.sources) for r in retrieval.fuse(hits((1, 0.9), (2, 0.45)), hits((1, 4.0), (3, 2.0)), weights=(3, 2)).collect()}
    assert out == {1: (1.1, "vector+keyword"), 2: (0.3, "vector"), 3: (0.2, "keyword")}


def test_text_helpers(spark):
    row = spark.createDataFrame([('say ```json {"a": 1} ``` end', "Q1: one?\nA1: two.\nQ2: three?\nA2: four.", "The answer is (B).", "白矮星 ab")], "j string, q string, m string, z string")
    r = row.select(text.json_block(F.col("j")).alias("j"), text.question_pairs(F.col("q")).alias("q"), text.choice_answer(F.col("m")).alias("m"), text.cjk_bigrams(F.col("z")).alias("z"), text.language(F.col("z")).alias("l")).first()
    assert r.j == '{"a": 1}' and [tuple(x) for x in r.q] == [("one?", "two."), ("three?", "four.")] and r.m == "B" and r.z == ["白矮", "矮星"]


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], None)], "a array<double>, b array<double>, c array<double>").select(
        vectors.cosine(F.col("a"), F.col("b")).alias("cos"), vectors.weighted([F.col("a"), F.col("b"), F.col("c")], [0.4, 0.35, 0.25]).alias("w"),
        vectors.softmax_fusion([F.col("a"), F.col("b")], [F.lit(0.0), F.lit(0.0)]).alias("s"), vectors.project(F.col("a"), [[1.0, 1.0]]).alias("p"),
    ).first()
    assert abs(r.cos - 0.96) < 1e-12 and abs(r.w[0] - (1.2 + 1.4) / 0.75) < 1e-9 and r.s == [3.5, 3.5] and r.p == [7.0]


def test_calibration(spark):
    rows = spark.createDataFrame([(True, 0.95), (False, 0.95), (True, 0.0), (True, 0.15)], "correct boolean, confidence double")
    r = evaluation.calibration_error(rows).first()
    assert r.n == 4 and abs(r.ece - (2 * 0.45 + 0.85) / 4) < 1e-6


def test_files(spark, tmp_path):
    (tmp_path / "star_ztf.csv").write_text("a,b,c,d,e,f,g,h\nx,y,1.5,2,15.1,0.1,0,zg\nx,y,1.6,2,15.2,0.1,32768,zg\n")
    (tmp_path / "s_tess_spoc.csv").write_text("".join(f"{t},{f},0.1,{',' * 9},{q}\n" for t, f, q in [("time", "flux", "quality"), (1.0, 5.0, 0), (2.0, "", 0), (3.0, 5.0, 4)]))
    (tmp_path / "asas_1.csv").write_text("# name: X; ra: 1.5\n1.0,2,0.1,15.0,0.1,17.0,G,V\n1.0,2,0.1,18.0,0.1,17.0,G,V\n")
    (tmp_path / "topic.txt").write_text("short\n\n" + "long paragraph " * 6)
    assert [(r.source, r.band, r.t) for r in readers.ztf(spark, str(tmp_path / "star_ztf.csv")).collect()] == [("star_ztf", "zg", 1.5)]
    assert [r.t for r in readers.tess(spark, str(tmp_path / "s_tess_spoc.csv")).collect()] == [readers.BTJD + 1]
    assert [r.mag for r in readers.asassn(spark, str(tmp_path / "asas_1.csv")).collect()] == [15.0]
    assert readers.asassn_headers(spark, str(tmp_path / "asas_1.csv")).first().header == {"name": "X", "ra": "1.5"}
    assert [(r.id, r.topic) for r in readers.knowledge(spark, str(tmp_path / "topic.txt")).collect()] == [("topic_1", "topic")]
    assert {r.kind for r in readers.file_kinds(spark, str(tmp_path)).collect()} == {"ztf", "tess", "asassn"}
    assert readers.directory_stats(spark, str(tmp_path)).first().n == 4


def test_resume_does_only_new_work(spark, tmp_path):
    done = []
    work = lambda df: (done.append(df.count()), df)[1]
    for n in (3, 5, 5):
        out = sinks.resume(spark, spark.range(n).withColumnRenamed("id", "k"), "k", str(tmp_path / "out"), work)
    assert done == [3, 2, 0] and out.count() == 5


def test_model_surfaces(spark):
    rows = spark.createDataFrame([(1, "ab", "ab"), (2, None, "boom")], "k long, text string, prompt string")
    assert {r.k: r.embedding for r in models.encoded(rows, lambda: lambda texts: [[float(len(t))] for t in texts]).collect()} == {1: [2.0], 2: [0.0]}

    def load():
        def model(prompt):
            if prompt == "boom":
                raise ValueError("no")
            return prompt.upper()

        return model

    assert {r.k: (r.answer, r.status) for r in models.generated(rows, load, "k").collect()} == {1: ("AB", "ok"), 2: (None, "failed")}
