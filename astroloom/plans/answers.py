"""Queries that score answers: a conversation's assistant turn answers its user turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as c
from ..operators import evaluation as e
from .base import registrar, table

QUERIES, ORACLE_SQL, query = registrar()

PAIRS = """a AS (SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user') AS question, arg_max(text, turn) FILTER (WHERE role = 'assistant') AS answer FROM conversations WHERE text IS NOT NULL GROUP BY conv_id),
p AS (SELECT conv_id, question, answer FROM a WHERE question IS NOT NULL AND answer IS NOT NULL)"""
WORDS = lambda x: rf"list_distinct(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{N}}_]+'))"
#: Words that occur in the texts and stand for the rules' terms.
TERMS = ("the", "and", "license", "token")
SUBJECTS = {"law": ("license", "version"), "codes": ("token", "password", "secret"), "french": ("le ", "la ", "que"), "english": ("the ", "and ", "that")}


def _pairs(spark, sf):
    rows = c.alpaca(table(spark, sf, "conversations").filter("text IS NOT NULL"))
    return rows.select("conv_id", F.col("instruction").alias("question"), F.col("output").alias("answer"))


def _count(text: str, words) -> str:
    return " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words)


@query(f"""WITH {PAIRS}, h AS (SELECT conv_id, {", ".join(f"{_count('lower(question)', w)} AS {k}" for k, w in SUBJECTS.items())} FROM p)
SELECT conv_id, CASE WHEN greatest({", ".join(SUBJECTS)}) = 0 THEN 'general' {" ".join(f"WHEN {k} = greatest({', '.join(SUBJECTS)}) THEN '{k}'" for k in SUBJECTS)} END AS subfield,
  CASE WHEN french > 0 THEN 'fr' WHEN english > 0 THEN 'en' ELSE 'general' END AS category FROM h""")
def question_subfields(spark, sf):
    words = (("fr", SUBJECTS["french"]), ("en", SUBJECTS["english"]))
    return _pairs(spark, sf).select("conv_id", e.subfield(F.col("question"), SUBJECTS).alias("subfield"), e.category(F.col("question"), words).alias("category"))


_DOUBT = " OR ".join("contains(lower(answer), '" + w.replace("'", "''") + "')" for w in e.DOUBTS)
SCORES = f"""{PAIRS}, w AS (SELECT *, {WORDS("question")} AS q, {WORDS("answer")} AS a FROM p),
s AS (SELECT conv_id, CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / CAST(len(q) AS DOUBLE) ELSE 0.5 END AS factuality, least(({_count("answer", TERMS)}) / 1.2e0, 1e0) AS professionalism,
  CASE WHEN length(answer) > 50 THEN least(length(answer) / 200e0, 1e0) ELSE 0.3e0 END AS completeness, CASE WHEN {_DOUBT} THEN 0e0 ELSE 1e0 END AS confidence FROM w)"""


@query(f"""WITH {SCORES} SELECT conv_id, round(factuality, 6) AS factuality, round(professionalism, 6) AS professionalism, round(completeness, 6) AS completeness, confidence,
  round((factuality + professionalism + completeness + confidence) / 4, 6) AS overall FROM s""")
def answer_scores(spark, sf):
    out = e.answer_scores(_pairs(spark, sf), "answer", "question", TERMS)
    return out.select("conv_id", *[F.round(m, 6).alias(m) for m in ("factuality", "professionalism", "completeness")], "confidence", F.round("overall", 6).alias("overall"))


@query(f"WITH {SCORES} SELECT conv_id % 5 AS category, count(*) AS n, round(avg(factuality), 6) AS factuality, round(avg(completeness), 6) AS completeness FROM s GROUP BY ALL")
def category_scores(spark, sf):
    scored = e.answer_scores(_pairs(spark, sf), "answer", "question", TERMS).withColumn("category", F.col("conv_id") % 5)
    return e.score_statistics(scored, "category", ("factuality", "completeness")).select("category", "n", F.round("factuality", 6).alias("factuality"), F.round("completeness", 6).alias("completeness"))


_LOW = lambda x: WORDS(f"lower({x})")
_BOTH = " + ".join(f"CAST(contains(question, '{t}') AND contains(answer, '{t}') AS INT)" for t in TERMS)


@query(f"""WITH {PAIRS}, w AS (SELECT *, {_LOW("question")} AS q, {_LOW("answer")} AS a, list_filter(list_transform(string_split(question, '。'), lambda s: trim(s)), lambda s: length(s) > 5) AS r FROM p)
SELECT conv_id, round(least(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / CAST(len(q) AS DOUBLE) ELSE 0 END + 0.05e0 * ({_BOTH}), 1e0), 6) AS factuality,
  round(CASE WHEN len(r) > 0 THEN len(list_filter(r, lambda s: len(list_intersect({_LOW("s")}, a)) > 0.3 * len({_LOW("s")}))) / CAST(len(r) AS DOUBLE) ELSE 0.5 END, 6) AS completeness,
  round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, a)) / CAST(len(q) AS DOUBLE) ELSE 0.5 END, 6) AS relevance FROM w""")
def answer_overlap(spark, sf):
    q, a = F.col("question"), F.col("answer")
    return _pairs(spark, sf).select("conv_id", F.round(e.factuality(a, q, TERMS), 6).alias("factuality"), F.round(e.completeness(a, q), 6).alias("completeness"), F.round(e.relevance(q, a), 6).alias("relevance"))


_UNSURE = " - ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 0.05e0 ELSE 0e0 END" for w in tx.UNSURE)
_SOFT = {"the_that": "a", "le_que": "b", "der_die": "c"}
_RAW = {t: f"least(1e0, ({_count('lower(text)', t.split('_'))}) / 2e0 + 0.1e0)" for t in _SOFT}


@query(f"""WITH d AS (SELECT doc_id, text, {", ".join(f"{x} AS {_SOFT[t]}" for t, x in _RAW.items())} FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(greatest(0.5e0, least(0.95e0, 0.7e0 + CASE WHEN length(text) > 500 THEN 0.1e0 ELSE 0e0 END - {_UNSURE} + CASE WHEN contains(text, '[') OR contains(lower(text), 'ref') THEN 0.05e0 ELSE 0e0 END)), 6) AS confidence,
  round(a / (a + b + c), 6) AS the_that, round(c / (a + b + c), 6) AS der_die, CASE WHEN length(text) > 100 OR contains(text, '分析') THEN 'complex' ELSE 'simple' END AS complexity,
  CASE WHEN regexp_matches(lower(text), 'variable|cv|nova') THEN 'variable_star' WHEN regexp_matches(lower(text), 'spectrum|spectral') THEN 'spectral_classification' ELSE 'general_analysis' END AS route FROM d""")
def response_heuristics(spark, sf):
    text = F.col("text")
    soft = tx.soft_labels(text, tuple(_SOFT))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select(
        "doc_id", F.round(tx.response_confidence(text), 6).alias("confidence"), F.round(soft["the_that"], 6).alias("the_that"), F.round(soft["der_die"], 6).alias("der_die"),
        tx.query_complexity(text).alias("complexity"), tx.query_route(text).alias("route"),
    )


@query("""WITH v AS (SELECT doc_id % 7 AS topic, CASE WHEN quality = 1 THEN 'correct' WHEN toxic = 1 THEN 'partial' ELSE 'incorrect' END AS verdict FROM labels), t AS (SELECT CAST(topic AS VARCHAR) AS topic, verdict FROM v UNION ALL SELECT 'all', verdict FROM v)
SELECT topic, count(*) AS n, count(*) FILTER (WHERE verdict = 'correct') AS correct, count(*) FILTER (WHERE verdict = 'partial') AS partial, count(*) FILTER (WHERE verdict = 'incorrect') AS incorrect,
  round((count(*) FILTER (WHERE verdict = 'correct') + 0.5e0 * count(*) FILTER (WHERE verdict = 'partial')) / count(*), 6) AS composite FROM t GROUP BY topic""")
def verdict_totals(spark, sf):
    rows = table(spark, sf, "labels").select((F.col("doc_id") % 7).alias("topic"), F.when(F.col("quality") == 1, "correct").when(F.col("toxic") == 1, "partial").otherwise("incorrect").alias("verdict"))
    return e.verdict_totals(rows, "topic").withColumn("composite", F.round("composite", 6))


@query(f"""WITH {PAIRS}, k AS (SELECT conv_id, concept, contains(lower(answer), concept) AS hit FROM p, (VALUES ('the'), ('token'), ('que')) AS v(concept))
SELECT conv_id, count(*) AS concepts, count(*) FILTER (WHERE hit) AS covered, coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (WHERE NOT hit), '') AS missing FROM k GROUP BY conv_id""")
def concept_checklist(spark, sf):
    pairs = _pairs(spark, sf)
    concepts = pairs.select("conv_id", F.explode(F.array(F.lit("the"), F.lit("token"), F.lit("que"))).alias("concept"))
    return e.concept_checklist(pairs, concepts, "conv_id").withColumn("missing", F.array_join("missing", ","))


@query("SELECT doc_id FROM labels WHERE quality = 0 ORDER BY doc_id LIMIT 5")
def first_errors(spark, sf):
    return e.first_errors(table(spark, sf, "labels").withColumn("correct", F.col("quality") == 1), "doc_id").select("doc_id")


@query("""SELECT d.doc_id, coalesce(lower(trim(l.pred)) = lower(trim(d.lang)), false) AS correct FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN ' EN' ELSE 'fr' END AS pred FROM labels) l USING (doc_id)""")
def benchmark_join(spark, sf):
    predictions = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, " EN").otherwise("fr").alias("answer"))
    references = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("answer"))
    return e.benchmark_join(predictions, references, "doc_id").select("doc_id", "correct")


@query(f"""WITH {PAIRS}, w AS (SELECT {_LOW("question")} AS t, {_LOW("answer")} AS s, conv_id % 10 / 10e0 AS confidence FROM p)
SELECT count(*) AS n, round(avg(CASE WHEN len(list_intersect(t, s)) / CAST(greatest(len(t), len(s), 1) AS DOUBLE) > 0.3 THEN 1e0 ELSE 0e0 END), 6) AS agreement, round(avg(confidence), 6) AS confidence FROM w""")
def teacher_agreement(spark, sf):
    pairs = _pairs(spark, sf)
    teacher, student = pairs.select("conv_id", F.col("question").alias("answer")), pairs.select("conv_id", "answer", (F.col("conv_id") % 10 / 10.0).alias("confidence"))
    out = e.agreement(teacher, student, "conv_id")
    return out.select("n", F.round("agreement", 6).alias("agreement"), F.round("confidence", 6).alias("confidence"))


@query("SELECT doc_id % 4 AS pipeline, round(avg(quality / 2e0 + 0.25), 6) AS confidence, count(*) AS steps, round(avg(quality / 2e0 + 0.25) - 0.5, 6) AS delta FROM labels GROUP BY ALL")
def pipeline_confidence(spark, sf):
    steps = table(spark, sf, "labels").select((F.col("doc_id") % 4).alias("pipeline"), (F.col("quality") / 2 + 0.25).alias("confidence"))
    out = e.against_baseline(e.pipeline_confidence(steps, "pipeline"), 0.5, "confidence")
    return out.select("pipeline", F.round("confidence", 6).alias("confidence"), "steps", F.round("delta", 6).alias("delta"))
