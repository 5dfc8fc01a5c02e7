"""Training samples: formats, prompts, paraphrases, retrieval-augmented sets, reports and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Wording of notes and prompts.
SOURCE_NOTE = "\n\n【参考来源: {source}, 第{page}页】"
AUGMENTED = "基于以下参考信息回答问题：\n\n参考信息：\n{context}\n\n问题：{question}\n\n请基于上述参考信息提供准确、详细的回答。"
TARGET_PROMPT = """你是一位专业天文学家。请分析以下天体目标。

坐标信息:
- 赤经 (RA): {ra} deg
- 赤纬 (DEC): {dec} deg

查询: {query}

请提供详细的科学分析，包括：
1. 天体分类
2. 物理参数估计
3. 观测建议

分析："""
BILINGUAL_PROMPTS = {
    "zh": "你是一位资深天体物理学家。请基于以下知识回答问题。\n\n问题: {question}\n\n相关知识 (中英双语):\n{context}\n\n请用中文回答，可以引用上述知识。",
    "en": "You are a senior astrophysicist. Please answer the question based on the following knowledge.\n\nQuestion: {question}\n\nRelevant Knowledge (Bilingual):\n{context}\n\nPlease answer in English, you may reference the knowledge above.",
}
QUESTION_HEAD = "请回答以下天文学问题：\n\n问题：{question}\n\n"
CHOICE_TAIL, OPEN_TAIL = "\n请只回答选项字母（如 A、B、C、D），并简要说明理由。", "\n请给出详细答案和推理过程。"
SNIPPET = "[{rank}] {text}... (来源: {source})"


def filled(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its column; nulls become empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{%s}" % name), F.coalesce(value.cast("string"), F.lit("")))
    return out


def noted_answer(rule_based: Column, note: str = SOURCE_NOTE) -> Column:
    """The answer, with its source where it was made by rule."""
    source = filled(note, source=F.col("source_file"), page=F.col("page_number"))
    return F.concat("answer", F.when(F.coalesce(rule_based, F.lit(False)), source).otherwise(""))


def target_prompt(ra: Column, dec: Column, query: Column) -> Column:
    """What a student model is asked about a target; coordinates that are missing are named so."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("N/A"))
    return filled(TARGET_PROMPT, ra=known(ra), dec=known(dec), query=F.coalesce(query, F.lit("Analyze this astronomical target")))


def target_answer(classification: Column, parameters: Column, steps: Column) -> Column:
    """What it should answer: the class, the parameters of a map in order of name, and the numbered steps of an array."""
    line = lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("")), F.lit("\n"))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(parameters)), line), "")
    numbered = F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.lit("\n"))), "")
    none = F.lit("")
    return F.concat(F.lit("\n"), F.coalesce(classification, F.lit("Unknown")), F.lit("\n\n[物理参数]\n"), F.coalesce(listed, none), F.lit("\n[推理过程]\n"), F.coalesce(numbered, none))


def bilingual_prompt(question: Column, context: Column, language: Column) -> Column:
    """The prompt in Chinese where that is the language, else in English."""
    said = {k: filled(p, question=question, context=context) for k, p in BILINGUAL_PROMPTS.items()}
    return F.when(language == "zh", said["zh"]).otherwise(said["en"])


def question_prompt(question: Column, options: Column) -> Column:
    """A question with the options of a map in order of their letters; without any, an open one."""
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(". "), e["value"], F.lit("\n"))), "")
    tail = F.when(F.size(options) > 0, F.concat(F.lit("选项：\n"), listed, F.lit(CHOICE_TAIL))).otherwise(OPEN_TAIL)
    return F.concat(filled(QUESTION_HEAD, question=question), tail)


def _said(role: str, text: Column, keys: tuple[str, str] = ("from", "value")) -> Column:
    return F.struct(F.lit(role).alias(keys[0]), text.alias(keys[1]))


def qwen_samples(pairs: DataFrame, system: str) -> DataFrame:
    """(id, conversations, metadata) from (id, question, answer, source_file, page_number, generation_method)."""
    answer = noted_answer(F.col("generation_method") == "rule_based")
    turns = F.array(_said("system", F.lit(system)), _said("user", F.col("question")), _said("assistant", answer))
    return pairs.select("id", turns.alias("conversations"), F.struct("source_file", "page_number", "generation_method").alias("metadata"))


def sharegpt_samples(pairs: DataFrame) -> DataFrame:
    answer = noted_answer(F.col("generation_method") == "rule_based")
    return pairs.select("id", F.array(_said("human", F.col("question")), _said("gpt", answer)).alias("conversations"))


def alpaca_samples(pairs: DataFrame) -> DataFrame:
    answer = noted_answer(F.col("generation_method") == "rule_based")
    return pairs.select("id", F.col("question").alias("instruction"), F.lit("").alias("input"), answer.alias("output"), F.array().cast("array<string>").alias("history"))


def message_samples(pairs: DataFrame, system: str) -> DataFrame:
    """(id, messages) whose answers name their source and how they were made."""
    note = filled("\n\n【来源: {source}, 第{page}页, 生成方式: {how}】", source=F.col("source_file"), page=F.col("page_number"), how=F.col("generation_method"))
    keys = ("role", "content")
    return pairs.select("id", F.array(_said("system", F.lit(system), keys), _said("user", F.col("question"), keys), _said("assistant", F.concat("answer", note), keys)).alias("messages"))


def messages_to_alpaca(samples: DataFrame) -> DataFrame:
    """(id, instruction, input, output): the last user and assistant messages; system messages go."""
    last = lambda role: F.coalesce(F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))
    return samples.select("id", last("user").alias("instruction"), F.lit("").alias("input"), last("assistant").alias("output"))


def paraphrases(pairs: DataFrame, lead: str = "什么是", others: tuple[str, str] = ("请解释", "简述"), length: int = 200) -> DataFrame:
    """The pairs, and for questions with the lead two more: another lead, and a short form with the answer cut."""
    cut = F.when(F.length("answer") > length, F.concat(F.left("answer", F.lit(length)), F.lit("..."))).otherwise(F.col("answer"))
    form = lambda n, q, a: F.struct(F.lit(n).alias("variant"), q.alias("question"), a.alias("answer"))
    said = lambda by: F.replace(F.col("question"), F.lit(lead), F.lit(by))
    more = F.array(form(1, said(others[0]), F.col("answer")), form(2, said(others[1]), cut))
    forms = F.concat(F.array(form(0, F.col("question"), F.col("answer"))), F.when(F.contains("question", F.lit(lead)), more).otherwise(F.array().cast("array<struct<variant:int,question:string,answer:string>>")))
    rest = [c for c in pairs.columns if c not in ("question", "answer")]
    return pairs.select(*rest, F.explode(forms).alias("f")).select(*rest, "f.*")


def augmented_set(samples: DataFrame, hits: DataFrame, docs: DataFrame, source: str, n: int = 3, snippet: int = 300, least: float = 0.5) -> DataFrame:
    """Samples (qid, question) with the prompt over their first n hits (qid, doc_id, score, rank), the mean score as
    confidence and whether to include them. All questions are retrieved as one set; samples without hits keep an empty
    context."""
    found = hits.filter(F.col("rank") <= n).join(docs.select("doc_id", F.left("text", F.lit(snippet)).alias("text"), F.col(source).alias("source")), "doc_id")
    line = F.struct("rank", filled(SNIPPET, rank=F.col("rank"), text=F.col("text"), source=F.coalesce("source", F.lit("未知"))).alias("line"))
    context = found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("context"), F.avg("score").alias("confidence"))
    rows = samples.join(context, "qid", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    prompt = filled(AUGMENTED, context=F.col("context"), question=F.col("question"))
    return rows.withColumns({"prompt": prompt, "include": F.col("confidence") > least}).drop("context")


def retrieval_queries(targets: DataFrame, key: str) -> DataFrame:
    """(key, at, query) from (object_type, period_hours): two of the type, one of the period's band, one for all."""
    kind, period = F.nullif(F.col("object_type"), F.lit("")), F.nullif(F.col("period_hours"), F.lit(0.0))
    band = F.when(period < 0.1, "ultra-compact binary AM CVn period").when(period < 2, "short period cataclysmic variable").when(period < 12, "cataclysmic variable orbital period")
    queries = F.array_compact(F.array(F.concat(kind, F.lit(" physical properties")), F.concat(kind, F.lit(" classification")), band, F.lit("cataclysmic variable accretion physics")))
    return targets.select(key, F.posexplode(queries).alias("at", "query"))


def report_section(reports: DataFrame, key: str, headings: tuple[str, ...], bullets: bool = False) -> DataFrame:
    """(key, section): the lines after one that holds a heading word, up to the next that starts with ##; with ``bullets``
    the items of its lists. Only a report's own lines are ordered."""
    lines = reports.select(key, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    opens = F.exists(F.array(*map(F.lit, headings)), lambda h: F.contains("line", h))
    mark = F.when(opens, 1).when(F.col("line").startswith("##"), 0)
    lines = lines.withColumn("mark", mark)
    lines = lines.withColumn("inside", F.last("mark", ignorenulls=True).over(W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    kept = lines.filter("inside = 1 AND mark IS NULL")
    line = F.col("line")
    if bullets:
        kept = kept.filter(F.ltrim("line").rlike(r"^[-*]"))
        line = F.trim(F.regexp_replace(F.ltrim("line"), r"^[-*]", ""))
    rows = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("section"))


# Observing advice by class, the first that fits, and for what is missing.
ADVICE = (
    (("AM CVn",), ("建议进行光谱观测，确认氦线存在且无氢线", "测光观测验证短周期（< 1 小时）光变", "X射线观测（XMM-Newton/Chandra）检测吸积活动", "时序测光寻找超爆发（superoutburst）")),
    (("CV", "dwarf nova"), ("长期测光监测寻找爆发周期", "多波段测光（ugriz）确定颜色变化", "低分辨率光谱确认发射线特征", "X射线观测确定吸积状态")),
    (("Polar", "AM Her"), ("偏振测光检测圆偏振（强磁场特征）", "X射线观测（吸积柱辐射）", "时序测光确认轨道周期", "光谱观测检测强磁场塞曼分裂")),
)
NO_XRAY, NO_PERIOD = "建议进行 X射线观测确认吸积活动", "建议进行时序测光确定周期"


def observing_advice(kind: Column, has_xray: Column, period: Column, advice: tuple = ADVICE) -> Column:
    """Array of advice for a class and for what is not known of it."""
    none = F.array().cast("array<string>")
    of = F.when(F.lit(False), none)
    for names, texts in advice:
        fits = F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(kind, n))
        of = of.when(fits, F.array(*map(F.lit, texts)))
    more = F.array_compact(F.array(F.when(~F.coalesce(has_xray, F.lit(False)), F.lit(NO_XRAY)), F.when(F.coalesce(period, F.lit(0.0)) == 0, F.lit(NO_PERIOD))))
    return F.concat(F.coalesce(of, none), more)


def distance_band(extinction: Column) -> Column:
    return (
        F.when(extinction < 0.1, "< 100 pc (本地泡)").when(extinction < 0.5, "~100-500 pc").when(extinction < 1.0, "~500 pc - 1 kpc").when(extinction < 2.0, "~1-2 kpc")
        .when(extinction.isNotNull(), "> 2 kpc 或银道面方向")
    )
