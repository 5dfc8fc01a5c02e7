"""Evaluation of answers: accuracy by group, calibration, verdicts, rules, model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(results: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(grouping, value, n, accuracy): over all rows and by each group, from one pass."""
    sets = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groups])).alias("g")
    return results.select("correct", sets).groupBy("g.grouping", "g.value").agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"))


def summary(results: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(grouping, value, n, accuracy, hallucination_rate, latency): over all rows and by each group, from one pass over rows
    (correct, hallucinated, latency); missing latencies stay out of the mean."""
    sets = F.explode(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("value")), *[F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("value")) for g in groups])).alias("g")
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    rows = results.select("correct", "hallucinated", "latency", sets).groupBy("g.grouping", "g.value")
    return rows.agg(F.count("*").alias("n"), share("correct").alias("accuracy"), share("hallucinated").alias("hallucination_rate"), share("latency").alias("latency"))


def calibration_error(results: DataFrame, bins: int = 10) -> DataFrame:
    """(n, ece): confidence 0 is in no bin but counts in n."""
    slot = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per = results.withColumn("bin", F.when(F.col("confidence") > 0, slot)).groupBy("bin").agg(F.count("*").alias("n"), F.abs(F.avg(F.col("correct").cast("double")) - F.avg("confidence")).alias("gap"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.col("gap"))) / F.sum("n"), 6).alias("ece"))


def verdict(ratio: Column, similarity: Column) -> Column:
    return F.when((ratio >= 0.6) | (similarity > 0.3), "correct").when((ratio >= 0.3) | (similarity > 0.1), "partial").otherwise("incorrect")


def keyword_ratio(answer: Column, keywords: tuple[str, ...]) -> Column:
    low = F.lower(answer)
    return sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0)) / float(len(keywords))


def breaks_rule(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Whether a forbidden pattern stands in a text of the rule's context; (context, forbidden) patterns."""
    out = F.lit(False)
    for context, forbidden in rules:
        out = out | (text.rlike(context) & text.rlike(forbidden))
    return F.coalesce(out, F.lit(False))


# The golden rules of binary-star texts, as (context, forbidden) patterns.
HALLUCINATIONS = (("AM CVn", "中子星|neutron star"), ("激变变星|cataclysmic", "潮汐相互作用|tidal interaction"))


def model_table(scores: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """(model, one average per metric, overall, rank) from (model, metric, score); the best overall first."""
    from pyspark.sql import Window as W

    wide = scores.groupBy("model").pivot("metric", list(metrics)).agg(F.round(F.avg("score"), 6))
    overall = F.round(sum((F.coalesce(m, F.lit(0.0)) for m in metrics), F.lit(0.0)) / len(metrics) + 1e-9, 4)
    # A row for each model.
    return wide.withColumn("overall", overall).withColumn("rank", F.row_number().over(W.orderBy(F.desc("overall"), "model")))


def with_medals(models: DataFrame) -> DataFrame:
    """A model table with each model's medal by its overall score: gold above 0.7, silver above 0.5, else bronze."""
    return models.withColumn("medal", F.when(F.col("overall") > 0.7, "gold").when(F.col("overall") > 0.5, "silver").otherwise("bronze"))


def checklist(results: DataFrame, by: str) -> DataFrame:
    """Share of passed checks in percent, banded PASS from 70 and WARN from 50."""
    score = F.round(F.avg(F.col("passed").cast("double")) * 100, 4)
    return results.groupBy(by).agg(score.alias("score")).withColumn("band", F.when(F.col("score") >= 70, "PASS").when(F.col("score") >= 50, "WARN").otherwise("FAIL"))


# Words of the subfields, in the order in which ties go, and of the question categories.
SUBFIELDS = {
    "stellar": ("恒星", "star", "主序", "main sequence", "巨星", "giant", "白矮星", "white dwarf"),
    "exoplanet": ("系外行星", "exoplanet", "行星", "planet", "凌日", "transit", "径向速度", "radial velocity"),
    "cosmology": ("宇宙学", "cosmology", "宇宙", "universe", "大爆炸", "big bang", "暗能量", "dark energy"),
    "galactic": ("星系", "galaxy", "银河系", "milky way", "星云", "nebula"),
    "high_energy": ("高能", "high energy", "x射线", "gamma", "黑洞", "black hole", "中子星", "neutron star"),
    "instrumentation": ("仪器", "instrument", "望远镜", "telescope", "探测器", "detector", "光谱仪"),
    "solar": ("太阳", "sun", "日冕", "corona", "太阳风", "solar wind"),
    "mechanics": ("天体力学", "celestial mechanics", "轨道", "orbit", "开普勒", "kepler"),
}
CATEGORIES = (("hr_diagram", ("赫罗图", "hr", "主序", "巨星")), ("variable_star", ("光变曲线", "变星", "周期", "振幅")), ("cv", ("灾变", "cv", "吸积", "白矮星")), ("sed_spectroscopy", ("sed", "能谱", "光谱")))
DOUBTS = ("我不确定", "可能", "也许", "好像", "我不太清楚", "i'm not sure", "maybe", "perhaps", "i guess")
QUESTION_STOP = ("什么", "的", "是", "在", "和", "了", "有", "吗")
# Rules of white-dwarf texts, as (context, forbidden).
WHITE_DWARF_RULES = (
    (r"AM CVn|AM\s+CVn", "中子星|neutron star"),
    ("双白矮星|double white dwarf|并合|merger", "总是|always|一定|definitely.*超新星|supernova"),
    ("吸积|accretion|白矮星|white dwarf", "都会|all.*新星|always.*nova"),
    ("白矮星.*冷却|white dwarf.*cooling", "恒定|constant.*rate|不变"),
)


def _held(text: Column, words: tuple[str, ...]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def subfield(question: Column, words: dict[str, tuple[str, ...]] = SUBFIELDS) -> Column:
    """The subfield most of whose words stand in the question, the first of equals; ``general`` if none does."""
    low = F.lower(question)
    hits = {name: _held(low, w) for name, w in words.items()}
    top = F.greatest(*hits.values())
    out = F.when(top <= 0, "general")
    for name, n in hits.items():
        out = out.when(n == top, name)
    return F.coalesce(out, F.lit("general"))


def category(question: Column, words: tuple = CATEGORIES) -> Column:
    low, out = F.lower(question), None
    for name, w in words:
        out = (F if out is None else out).when(_held(low, w) > 0, name)
    return out.otherwise("general")


def word_set(text: Column, lower: bool = True) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.array_distinct(F.regexp_extract_all(F.lower(text) if lower else text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def _recall(of: Column, found: Column, none: float) -> Column:
    return F.when(F.size(of) > 0, F.size(F.array_intersect(of, found)) / F.size(of)).otherwise(none)


def factuality(answer: Column, reference: Column, terms: tuple[str, ...] = (), bonus: float = 0.05) -> Column:
    """Share of the reference's words that the answer has, and a bonus for each term that stands in both; 1 at most."""
    both = sum(((F.contains(reference, F.lit(t)) & F.contains(answer, F.lit(t))).cast("int") for t in terms), F.lit(0))
    return F.least(_recall(word_set(reference), word_set(answer), 0.0) + bonus * both, F.lit(1.0))


def completeness(answer: Column, reference: Column, share: float = 0.3) -> Column:
    """Share of the reference's sentences over ``share`` of whose words the answer has; 0.5 without such sentences."""
    from ..functions.text import reference_sentences

    said, sentences = word_set(answer), reference_sentences(reference)
    met = F.filter(sentences, lambda s: F.size(F.array_intersect(word_set(s), said)) > share * F.size(word_set(s)))
    return F.when(F.size(sentences) > 0, F.size(met) / F.size(sentences)).otherwise(0.5)


def relevance(question: Column, answer: Column) -> Column:
    asked = F.array_except(word_set(question), F.array(*map(F.lit, QUESTION_STOP)))
    return _recall(asked, word_set(answer), 0.5)


def answer_scores(rows: DataFrame, answer: str = "answer", reference: str = "reference", terms: tuple[str, ...] = ()) -> DataFrame:
    """Adds factuality, professionalism (of the terms, a third is full marks), completeness by length, confidence (0 with
    a word of doubt) and their mean, ``overall``."""
    a, r = F.col(answer), F.col(reference)
    fact = _recall(word_set(r, False), word_set(a, False), 0.5)
    used = F.least(_held(a, terms) / max(0.3 * len(terms), 1.0), F.lit(1.0))
    whole = F.when(F.length(a) > 50, F.least(F.length(a) / 200, F.lit(1.0))).otherwise(0.3)
    sure = F.when(_held(F.lower(a), DOUBTS) > 0, 0.0).otherwise(1.0)
    rows = rows.withColumns({"factuality": fact, "professionalism": used, "completeness": whole, "confidence": sure})
    return rows.withColumn("overall", (F.col("factuality") + F.col("professionalism") + F.col("completeness") + F.col("confidence")) / 4)


def score_statistics(scores: DataFrame, by: str, metrics: tuple[str, ...]) -> DataFrame:
    return scores.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def verdict_totals(results: DataFrame, by: str) -> DataFrame:
    """(topic, n, correct, partial, incorrect, composite) of each topic and of all (topic null): (correct + half of partial)
    over n."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    out = results.rollup(by).agg(F.grouping(by).alias("_all"), F.count("*").alias("n"), n("correct"), n("partial"), n("incorrect"))
    return out.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(by).cast("string")).alias("topic"), "n", "correct", "partial", "incorrect", ((F.col("correct") + 0.5 * F.col("partial")) / F.col("n")).alias("composite"))


def concept_checklist(answers: DataFrame, concepts: DataFrame, key: str, text: str = "answer") -> DataFrame:
    """(key, concepts, covered, missing): of each question's key concepts (key, concept), those that its answer holds."""
    rows = concepts.join(answers.select(key, F.lower(text).alias("_t")), key, "left").withColumn("_in", F.coalesce(F.contains("_t", F.lower("concept")), F.lit(False)))
    missing = F.array_sort(F.collect_list(F.when(~F.col("_in"), F.col("concept"))))
    return rows.groupBy(key).agg(F.count("*").alias("concepts"), F.count_if("_in").alias("covered"), missing.alias("missing"))


def first_errors(results: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first wrong answers of a report."""
    return results.filter(~F.col("correct")).orderBy(key).limit(n)


def benchmark_join(predictions: DataFrame, references: DataFrame, key: str = "question_id") -> DataFrame:
    """Predictions with their references; every reference has a row, ``correct`` is false without a prediction."""
    rows = references.withColumnRenamed("answer", "reference").join(predictions.withColumnRenamed("answer", "predicted"), key, "left")
    return rows.withColumn("correct", F.coalesce(F.lower(F.trim("predicted")) == F.lower(F.trim("reference")), F.lit(False)))


def agreement(teacher: DataFrame, student: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """One row (n, agreement, confidence): how often the shared words of two answers exceed ``least`` of the larger set."""
    both = teacher.select(key, word_set(F.col("answer")).alias("t")).join(student.select(key, word_set(F.col("answer")).alias("s"), "confidence"), key)
    same = F.size(F.array_intersect("t", "s")) / F.greatest(F.size("t"), F.size("s"), F.lit(1)) > least
    return both.agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("agreement"), F.avg("confidence").alias("confidence"))


def against_baseline(scores: DataFrame, baseline: float, metric: str = "overall") -> DataFrame:
    return scores.withColumn("delta", F.col(metric) - baseline)


def pipeline_confidence(steps: DataFrame, by: str) -> DataFrame:
    """Mean confidence of each pipeline's steps."""
    return steps.groupBy(by).agg(F.avg("confidence").alias("confidence"), F.count("*").alias("steps"))
