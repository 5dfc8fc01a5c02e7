"""Limits and odd rows of clips, levels, retries, vetoes, names, statements and question making."""

import math
import re

import pytest
from pyspark.sql import functions as F

from astroloom.functions import text as tx
from astroloom.operators import corpus as c
from astroloom.operators import timeseries as ts
from astroloom.operators import training as tr
from astroloom.sources import readers


def said(spark, column, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.v for r in rows.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def curve(spark, **sources):
    return spark.createDataFrame([(s, "g", float(i), m, 0) for s, values in sources.items() for i, m in enumerate(values)], "source string, band string, t double, mag double, flag int")


def test_clip_keeps_rows_and_hides_values(spark):
    rows = spark.createDataFrame([("a", float(i), v) for i, v in enumerate([1.0, 2.0, 3.0, 100.0, float("nan"), None])], "s string, wave double, flux double")
    got = ts.clipped_to_null(rows, "flux", ("s",), 1.0, 3.0, also=("wave",)).orderBy(F.coalesce("flux", F.lit(99.0))).collect()
    assert [(r.flux, r.wave) for r in got] == [(1.0, 0.0), (2.0, 1.0), (3.0, 2.0)] + [(None, None)] * 3


def test_scatter_over_errors(spark):
    lc = curve(spark, varied=[1.0, 3.0, 1.0, 3.0], flat=[5.0, 5.0]).withColumn("error", F.lit(0.5))
    got = {r.source: r for r in ts.error_statistics(lc, by=("source",)).collect()}
    assert (got["varied"].over_mean, got["varied"].over_median, got["varied"].n_kept) == (2.0, 2.0, 4)
    assert (got["flat"].mag_std, got["flat"].over_mean, got["flat"].n_kept) == (0.0, 0.0, 2)
    none = ts.error_statistics(lc.withColumn("error", F.lit(0.0)), by=("source",)).collect()
    assert [r.over_mean for r in none] == [None, None]


@pytest.mark.parametrize("p", [0.5, 0.1, 0.001])
def test_level_gives_its_probability_back(spark, p):
    row = spark.range(1).select(F.lit(80).alias("n"), F.lit(30.0).alias("v"))
    row = row.withColumn("z", ts.false_alarm_level(p, F.col("n"), 2.0, F.col("v")))
    assert row.select(ts.false_alarm(F.col("z"), F.col("n"), 2.0, F.col("v"))).first()[0] == pytest.approx(p, rel=1e-6)
    assert spark.range(1).select(ts.false_alarm_level(p, F.lit(4), 2.0, F.lit(1.0))).first()[0] is None


def test_vector_of_a_lone_and_of_a_constant_source(spark):
    got = {r.source: r.features for r in ts.feature_vectors(curve(spark, lone=[3.0], same=[2.0] * 12), 0.1, 0.4, 4).collect()}
    assert all(len(v) == len(ts.FEATURES) and math.isclose(sum(x * x for x in v), 1, rel_tol=1e-6) for v in got.values())
    zero = [ts.FEATURES.index(k) for k in ("std", "skew", "power_std", "diff_std", "diff_abs")]
    assert all(v[k] == 0 for v in got.values() for k in zero)


def test_retries_stop_at_the_first_that_is_few(spark):
    saw = [(s, k, h) for s, n in (("few", 2), ("many", 12)) for k in range(2 * n + 1) for h in [float(k % 2 * (10 + (k * 7) % 5))]]
    series = spark.createDataFrame(saw, "source string, k int, power double")
    got = ts.peaks_retried(series, 1.0, 1, 4).collect()
    by = {s: sorted((r.rank, r.k, r.power, r.turn) for r in got if r.source == s) for s in ("few", "many")}
    assert {r[3] for r in by["few"]} == {0} and len(by["few"]) == 2
    powers = {k: p for s, k, p in saw if s == "many"}
    for turn, reach in ((1, 5), (2, 10)):
        found = [k for k in powers if powers[k] >= 1 and all(powers[j] <= powers[k] for j in powers if abs(j - k) <= reach)]
        if len(found) <= 4:
            break
    assert [r[1] for r in by["many"]] == sorted(found, key=lambda k: (-powers[k], k)) and {r[3] for r in by["many"]} == {turn}


def test_retries_may_leave_nothing(spark):
    series = spark.createDataFrame([("a", k, float(k % 2)) for k in range(99)], "source string, k int, power double")
    assert ts.peaks_retried(series, 1.0, 1, 2).count() == 0  # 49 equal peaks until the height is raised above them


@pytest.mark.parametrize(
    ("one", "two", "want"),
    [
        ((0.3, 0.9), (0.301, 0.1), "double"),
        ((0.3, 0.9), (0.2, 0.1), "single"),
        ((0.3, 0.31), (0.2, 0.31), None),  # apart, and neither clearly above its level
        ((1.0, 0.9), (0.5, 0.9), None),  # both at a day or half a day
        ((1.0, 0.9), (0.2, 0.1), None),  # one is, and the other is weak
        ((1.0, 0.9), (0.2, 0.9), "single"),
    ],
)
def test_veto_of_bands(spark, one, two, want):
    best = spark.createDataFrame([(1, "g", *one, 0.3), (1, "r", *two, 0.3), (2, "g", *one, 0.3)], "source int, band string, period double, power double, level double")
    assert [r.identified for r in ts.identified(best, "g", "r").collect()] == ([want] if want else [])


def test_stated_confidence(spark):
    texts = ("置信度：85", "Confidence: 0.7.", "about 90% confidence", "confidence: ... then 60 % confidence", "none", None, "confidence 1")
    assert said(spark, tx.stated_confidence, *texts)[0:3] == [0.85, 0.5, 0.9]
    assert said(spark, tx.stated_confidence, *texts)[3:] == [0.6, 0.5, 0.5, 1.0]


def test_mixed_words(spark):
    assert said(spark, tx.mixed_words, "AM Her 白矮星, abc1 x_y é ab", None) == [["am", "her", "白矮星", "ab"], []]


def test_object_names_agree_with_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "EV UMa AM Her and V404\nCyg; WD 1145+017, T 2020-12; caféAB cd"), (-2, None)], "doc_id long, text string")
    forms = [rf"(?<!\w){f}(?!\w)" for f in tx.NAME_FORMS]
    for row in docs.unionByName(more).select("doc_id", "text", tx.object_names(F.col("text")).alias("names")).collect():
        want = {re.sub(r"\s+", " ", n) for f in forms for n in re.findall(f, row.text or "", re.A if (row.text or "").isascii() else 0)}
        assert row.names == sorted(want)[:10], row.doc_id


def test_typed_knowledge_of_odd_papers(spark):
    papers = spark.createDataFrame([(1, None, "White dwarf, WHITE DWARF; Periods of 3.5 hours"), (2, "t", None), (3, "mass of 2 M_sun", "distance of 9 Mpc")], "id int, title string, abstract string")
    got = sorted((r.source, r.content, r.confidence) for r in c.typed_knowledge(papers).collect())
    assert got == [(1, "Object has a period of 3.5 hour", 0.7), (1, "Object is classified as white dwarf", 0.8), (3, "Object has a distance of 9 Mpc", 0.7), (3, "Object has a mass of 2 M_sun", 0.7)]


def test_questions_of_topics(spark):
    docs = spark.createDataFrame([(1, "A star shines. It varies. Then not."), (2, "nothing"), (3, None)], "doc_id int, text string")
    rows = [(1, t, 0.9 - r / 4, r, "A star shines. It varies.") for r, t in enumerate(("x", "y", "z", "none"), 1)]
    sections = spark.createDataFrame(rows, "doc_id int, topic string, score double, rank int, context string")
    asked = {t: (f"1 {t}", f"2 {t}", f"3 {t}") for t in ("x", "y", "z")}
    got = c.topic_questions(sections, asked, {"x": ("{content}|{observation}|{conclusion}",)}).collect()
    assert sorted(r.topic for r in got) == ["x", "x", "y", "y"]
    assert {r.answer for r in got if r.topic == "x"} == {f"A star shines| It varies|{c.SURE_CONCLUSION}"}
    assert all(c.UNSURE_CONCLUSION in r.answer for r in got if r.topic == "y")
    general = c.general_questions(docs, sections).collect()
    assert [r.doc_id for r in general] == [2, 2] and {r.question for r in general} == set(c.GENERAL_QUESTIONS[:2])
    assert said(spark, lambda x: c.topic_context(x, ("varies",)), "A star shines. It varies. Then not.", "nothing") == ["It varies.", "nothing"]


def test_priors_of_topics(spark):
    samples = spark.createDataFrame([("What is a CV?", {"binary": 0.1}, 1), ("what IS a nova", {"binary": 0.9}, 5), ("is a cv", {"binary": 0.3}, 0), ("", {"binary": 0.0}, 7)], "q string, l map<string,double>, at int")
    learned = c.learned_priors(samples, "q", "l", "at")
    queries = spark.createDataFrame([(1, "So what is a thing"), (2, "This is a CV"), (3, "white dwarf or binary"), (4, None)], "k int, q string")
    got = {r.k: r.labels for r in c.predicted_topics(queries, "k", "q", learned).collect()}
    assert got[1] == {"binary": 0.9} and got[2] == {"binary": 0.3}  # the newest labels of a key; the key learned first
    assert (got[3]["white_dwarf"], got[3]["binary"]) == (0.6, 0.25) and set(got[4].values()) == {0.25}


def test_paired_epochs_drop_what_is_not_a_number(spark):
    wide = spark.createDataFrame([("a", 1.0, 7.0, 0.1, float("nan"), 0.2), ("a", 2.0, None, 0.1, 8.0, None)], "source string, mjd double, w1mpro double, w1sigmpro double, w2mpro double, w2sigmpro double")
    got = sorted((r.band, r.t, r.mag, r.err) for r in readers.paired_epochs(wide).collect())
    assert got == [("W1", 1.0, 7.0, 0.1), ("W2", 2.0, 8.0, None)]


def test_prompts_without_values(spark):
    row = spark.range(1).select(tr.question_prompt(F.lit("q"), F.create_map().cast("map<string,string>")).alias("open"), tr.target_answer(F.lit(None).cast("string"), F.lit(None).cast("map<string,string>"), F.lit(None).cast("array<string>")).alias("none"), tr.target_prompt(F.lit(None), F.lit(1.5), F.lit(None)).alias("asked")).first()
    assert row.open.endswith(tr.OPEN_TAIL) and row.none.startswith("\nUnknown\n") and "N/A deg" in row.asked and "1.5 deg" in row.asked
