"""Queries of training samples, prompts and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as c
from ..operators import retrieval as r
from ..operators import training as t
from .answers import PAIRS, _pairs
from .base import registrar, table
from .retrieval import IDF, INDEX, TOP, _asked, _index, _keyword

QUERIES, ORACLE_SQL, query = registrar()

QA = f"""{PAIRS}, qa AS (SELECT conv_id AS id, question, answer, 'f' || conv_id % 9 AS source_file, conv_id % 50 AS page_number, CASE WHEN conv_id % 2 = 0 THEN 'rule_based' ELSE 'api_based' END AS generation_method FROM p),
n AS (SELECT *, CASE WHEN generation_method = 'rule_based' THEN answer || chr(10) || chr(10) || '【参考来源: ' || source_file || ', 第' || page_number || '页】' ELSE answer END AS noted FROM qa)"""


def _qa(spark, sf):
    k = F.col("conv_id")
    return _pairs(spark, sf).select(
        k.alias("id"), "question", "answer", F.concat(F.lit("f"), (k % 9).cast("string")).alias("source_file"), (k % 50).alias("page_number"),
        F.when(k % 2 == 0, "rule_based").otherwise("api_based").alias("generation_method"),
    )


@query(f"""WITH {QA} SELECT id, 'sys' AS system, question, noted AS qwen, noted AS sharegpt, question AS instruction, noted AS output,
  answer || chr(10) || chr(10) || '【来源: ' || source_file || ', 第' || page_number || '页, 生成方式: ' || generation_method || '】' AS message, source_file FROM n""")
def sample_formats(spark, sf):
    qa = _qa(spark, sf)
    at = lambda column, k, name: F.col(column)[k][name]
    qwen = t.qwen_samples(qa, "sys").select("id", at("conversations", 0, "value").alias("system"), at("conversations", 1, "value").alias("question"), at("conversations", 2, "value").alias("qwen"), "metadata.source_file")
    share = t.sharegpt_samples(qa).select("id", at("conversations", 1, "value").alias("sharegpt"))
    plain = t.alpaca_samples(qa).select("id", "instruction", "output")
    noted = t.messages_to_alpaca(t.message_samples(qa, "sys")).select("id", F.col("output").alias("message"))
    return qwen.join(share, "id").join(plain, "id").join(noted, "id")


@query(f"""WITH {QA}, v AS (SELECT id, 0 AS variant, question, answer FROM qa UNION ALL SELECT id, 1, replace(question, 'La ', 'Une '), answer FROM qa WHERE contains(question, 'La ')
UNION ALL SELECT id, 2, replace(question, 'La ', 'Le '), CASE WHEN length(answer) > 200 THEN left(answer, 200) || '...' ELSE answer END FROM qa WHERE contains(question, 'La ')) SELECT * FROM v""")
def question_variants(spark, sf):
    return t.paraphrases(_qa(spark, sf).select("id", "question", "answer"), "La ", ("Une ", "Le "))


@query(f"""WITH {INDEX}, {_keyword(IDF)}, t AS ({TOP.format('h', 3)}), l AS (SELECT qid, rank, score, '[' || rank || '] ' || left(text, 300) || '... (来源: ' || coalesce(source, '未知') || ')' AS line FROM t JOIN documents USING (doc_id)),
x AS (SELECT qid, string_agg(line, chr(10) ORDER BY rank) AS context, avg(score) AS confidence FROM l GROUP BY qid)
SELECT item_id AS qid, md5('基于以下参考信息回答问题：' || chr(10) || chr(10) || '参考信息：' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || '问题：' || coalesce(b.text, '') || chr(10) || chr(10) || '请基于上述参考信息提供准确、详细的回答。') AS prompt,
  round(coalesce(confidence, 0) + 1e-9, 4) AS confidence, coalesce(confidence, 0) > 0.5 AS include FROM benchmark b LEFT JOIN x ON qid = item_id""")
def augmented_training_set(spark, sf):
    asked = r.query_terms(_asked(spark, sf))
    index, n = _index(spark, sf, asked)
    hits = r.keyword_search(index, n, asked, k=3)
    out = t.augmented_set(_asked(spark, sf).withColumnRenamed("text", "question"), hits, table(spark, sf, "documents"), "source")
    return out.select("qid", F.md5(F.col("prompt").cast("binary")).alias("prompt"), F.round(F.col("confidence") + 1e-9, 4).alias("confidence"), "include")


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN '' ELSE c_mktsegment END AS k, c_acctbal / 500 AS p FROM customer),
q AS (SELECT c_custkey, list_filter([CASE WHEN k <> '' THEN k || ' physical properties' END, CASE WHEN k <> '' THEN k || ' classification' END,
  CASE WHEN p <> 0 THEN CASE WHEN p < 0.1 THEN 'ultra-compact binary AM CVn period' WHEN p < 2 THEN 'short period cataclysmic variable' WHEN p < 12 THEN 'cataclysmic variable orbital period' END END, 'cataclysmic variable accretion physics'], lambda x: x IS NOT NULL) AS l FROM s)
SELECT c_custkey, CAST(i - 1 AS INT) AS pos, l[i] AS query FROM (SELECT c_custkey, l, unnest(range(1, len(l) + 1)) AS i FROM q)""")
def target_queries(spark, sf):
    kind = F.when(F.col("c_nationkey") % 4 == 0, "").otherwise(F.col("c_mktsegment"))
    targets = table(spark, sf, "customer").select("c_custkey", kind.alias("object_type"), (F.col("c_acctbal") / 500).alias("period_hours"))
    return t.retrieval_queries(targets, "c_custkey").withColumnRenamed("at", "pos")


@query("""WITH r AS (SELECT o_orderkey, '# r' || chr(10) || 'intro' || chr(10) || '## ' || CASE WHEN o_orderstatus = 'F' THEN '观测建议' ELSE 'other' END || chr(10) || '- ' || o_orderpriority || chr(10) || 'plain' || chr(10) || '* x' || o_custkey || chr(10) || '## end' || chr(10) || '- no' AS text FROM orders)
SELECT o_orderkey, o_orderpriority || chr(10) || 'x' || o_custkey AS bullets, '- ' || o_orderpriority || chr(10) || 'plain' || chr(10) || '* x' || o_custkey AS section FROM orders WHERE o_orderstatus = 'F'""")
def report_sections(spark, sf):
    name = F.when(F.col("o_orderstatus") == "F", "观测建议").otherwise("other")
    text = F.concat_ws("\n", F.lit("# r"), F.lit("intro"), F.concat(F.lit("## "), name), F.concat(F.lit("- "), F.col("o_orderpriority")), F.lit("plain"), F.concat(F.lit("* x"), F.col("o_custkey").cast("string")), F.lit("## end"), F.lit("- no"))
    reports = table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    words = ("观测建议", "后续")
    items = t.report_section(reports, "o_orderkey", words, True).withColumnRenamed("section", "bullets")
    return items.join(t.report_section(reports, "o_orderkey", words), "o_orderkey")


_OF = lambda k: "[" + ", ".join(f"'{x}'" for x in t.ADVICE[k][1]) + "]"


@query(f"""WITH s AS (SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'AM CVn' WHEN 1 THEN 'dwarf nova' WHEN 2 THEN 'Polar' ELSE 'star' END AS kind, c_acctbal > 2000 AS xray, CASE WHEN c_custkey % 3 = 0 THEN 0e0 ELSE 1e0 END AS period, c_acctbal / 4000 AS av FROM customer)
SELECT c_custkey, array_to_string(CASE kind WHEN 'AM CVn' THEN {_OF(0)} WHEN 'dwarf nova' THEN {_OF(1)} WHEN 'Polar' THEN {_OF(2)} ELSE CAST([] AS VARCHAR[]) END || CASE WHEN xray THEN CAST([] AS VARCHAR[]) ELSE ['{t.NO_XRAY}'] END || CASE WHEN period = 0 THEN ['{t.NO_PERIOD}'] ELSE CAST([] AS VARCHAR[]) END, '|') AS advice,
  CASE WHEN av < 0.1 THEN '< 100 pc (本地泡)' WHEN av < 0.5 THEN '~100-500 pc' WHEN av < 1 THEN '~500 pc - 1 kpc' WHEN av < 2 THEN '~1-2 kpc' ELSE '> 2 kpc 或银道面方向' END AS distance FROM s""")
def observing_advice(spark, sf):
    k = F.col("c_nationkey") % 4
    kind = F.when(k == 0, "AM CVn").when(k == 1, "dwarf nova").when(k == 2, "Polar").otherwise("star")
    period = F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(1.0)
    return table(spark, sf, "customer").select("c_custkey", F.array_join(t.observing_advice(kind, F.col("c_acctbal") > 2000, period), "|").alias("advice"), t.distance_band(F.col("c_acctbal") / 4000).alias("distance"))


def _style(style: str) -> str:
    start, turn, _ = c.CHAT[style]
    role = "CASE role WHEN 'assistant' THEN 'model' WHEN 'system' THEN 'user' ELSE role END" if style == "gemma" else "role"
    said = "'" + turn.replace("\n", "' || chr(10) || '").replace("{role}", f"' || {role} || '").replace("{text}", "' || coalesce(text, '') || '") + "'"
    return f"md5('{start}' || string_agg({said}, '' ORDER BY turn)) AS {style}"


@query(f"SELECT conv_id, {_style('llama3')}, {_style('qwen2')}, {_style('yi')}, {_style('gemma')} FROM conversations GROUP BY conv_id")
def chat_styles(spark, sf):
    chats, out = c.conversations(table(spark, sf, "conversations")), None
    for style in ("llama3", "qwen2", "yi", "gemma"):
        one = c.rendered(chats, style).select("conv_id", F.md5(F.col("prompt").cast("binary")).alias(style))
        out = one if out is None else out.join(one, "conv_id")
    return out


_TARGET = t.TARGET_PROMPT.replace("'", "''")


@query(f"""SELECT o_orderkey AS id, md5(replace(replace(replace('{_TARGET}', '{{ra}}', CAST(o_custkey AS VARCHAR)), '{{dec}}', CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE 'N/A' END), '{{query}}', o_orderpriority)) AS asked,
  md5(chr(10) || o_orderstatus || chr(10) || chr(10) || '[物理参数]' || chr(10) || '- a: ' || o_custkey || chr(10) || '- b: ' || o_orderkey || chr(10) || chr(10) || '[推理过程]' || chr(10) || '1. ' || o_orderpriority || chr(10) || '2. end' || chr(10)) AS answered,
  md5(replace(replace(CASE WHEN o_orderkey % 3 = 0 THEN '{t.BILINGUAL_PROMPTS["zh"]}' ELSE '{t.BILINGUAL_PROMPTS["en"]}' END, '{{question}}', o_orderpriority), '{{context}}', o_orderstatus)) AS bilingual,
  md5(replace('{t.QUESTION_HEAD}', '{{question}}', o_orderpriority) || CASE WHEN o_orderkey % 2 = 0 THEN '选项：' || chr(10) || 'A. ' || o_orderstatus || chr(10) || 'B. no' || chr(10) || '{t.CHOICE_TAIL}' ELSE '{t.OPEN_TAIL}' END) AS chosen FROM orders""")
def prompt_texts(spark, sf):
    """Orders stand for targets, with a declination and options for the even ones."""
    key, cust, said, even = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderkey") % 2 == 0
    digest = lambda c: F.md5(c.cast("binary"))
    options = F.when(even, F.create_map(F.lit("B"), F.lit("no"), F.lit("A"), F.col("o_orderstatus")))
    return table(spark, sf, "orders").select(
        key.alias("id"), digest(t.target_prompt(cust, F.when(even, cust), said)).alias("asked"), digest(t.target_answer(F.col("o_orderstatus"), F.create_map(F.lit("b"), key, F.lit("a"), cust.cast("long")), F.array(said, F.lit("end")))).alias("answered"),
        digest(t.bilingual_prompt(said, F.col("o_orderstatus"), F.when(key % 3 == 0, "zh").otherwise("en"))).alias("bilingual"), digest(t.question_prompt(said, options)).alias("chosen"),
    )
