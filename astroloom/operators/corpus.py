"""From a corpus to training samples: copies, chunks, topics, questions, conversations, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import stored
from . import patterns


def exact_duplicates(docs: DataFrame, prefix: int | None = None) -> DataFrame:
    """(doc_id, hash, first_id, copy): the first id of each normalised content. The hash and ids alone are shuffled."""
    content = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\n\r\x0b\f]+", " "))
    rows = docs.select("doc_id", F.md5((F.substring(content, 1, prefix) if prefix else content).cast("binary")).alias("hash"))
    first = rows.groupBy("hash").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "hash").select("doc_id", "hash", "first_id", (F.col("doc_id") != F.col("first_id")).alias("copy"))


def keep_best(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")


def paragraphs(docs: DataFrame, separator: str = "\n", least: int = 50) -> DataFrame:
    """(doc_id, part, content) of the parts longer than ``least`` characters, numbered as they stand in the text."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("part", "content"))
    return parts.withColumn("content", F.trim("content")).filter(F.length("content") > least)


def chunked(docs: DataFrame, size: int = 1500, step: int = 1200) -> DataFrame:
    return docs.select("doc_id", F.posexplode(tx.chunks(F.col("text"), size, step)).alias("chunk", "content"))


def topics(docs: DataFrame, terms: dict[str, list[str]], top: int = 5) -> DataFrame:
    """(doc_id, topic, score, rank): occurrences of a topic's terms over ten times their number, 1 at most, best first.
    The topics are parameters, so each is an expression and no join is needed."""
    low = F.lower("text")
    scored = []
    for topic, words in sorted(terms.items()):
        count = sum((tx.occurrences(low, F.lit(w)) for w in words), F.lit(0))
        scored.append(F.struct(F.lit(topic).alias("topic"), F.least(F.round(count / (10.0 * len(words)), 6), F.lit(1.0)).alias("score")))
    ordered = F.array_sort(F.filter(F.array(*scored), lambda s: s["score"] > 0), lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["topic"] < b["topic"], -1).otherwise(1)))
    rows = docs.select("doc_id", low.alias("text")).filter("text IS NOT NULL").select("doc_id", F.posexplode(F.slice(ordered, 1, top)).alias("rank", "s"))
    return rows.select("doc_id", "s.topic", "s.score", (F.col("rank") + 1).alias("rank"))


def rule_questions(sections: DataFrame, templates: tuple[str, ...]) -> DataFrame:
    """(doc_id, topic, question, answer, confidence): one templated question for each topic of a document; which
    template is decided by the md5 of document and topic, so it never changes. Answers are the first two sentences."""
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "topic").cast("binary")), 1, 6), 16, 10).cast("long")
    pick = F.element_at(F.array(*map(F.lit, templates)), (code % len(templates) + 1).cast("int"))
    # Anchored, so that a long text without a stop is read once.
    first_two = r"^[.!?]*([^.!?]++[.!?])?[.!?]*([^.!?]++[.!?])?"
    answer = F.concat(F.regexp_extract("text", first_two, 1), F.regexp_extract("text", first_two, 2))
    return sections.select("doc_id", "topic", F.replace(pick, F.lit("{topic}"), F.col("topic")).alias("question"), F.trim(answer).alias("answer"), F.round(F.col("score") * 0.8, 4).alias("confidence"))


# What stands in for a missing observation, and the two conclusions.
NO_CONTENT, NO_OBSERVATION = "该天体", "观测到特定特征"
UNSURE_CONCLUSION, SURE_CONCLUSION = "需要进一步研究", "与该类型天体的理论模型相符"
# Answers and questions of texts without a topic.
GENERAL_ANSWERS = ("论文研究了{content}。主要发现包括{observation}，这些结果{conclusion}。", "该研究聚焦于{content}。分析表明{observation}，这对于理解{conclusion}具有重要意义。")
GENERAL_QUESTIONS = ("这部分内容的主要发现是什么？", "论文中讨论了什么观测结果？", "该研究使用了什么分析方法？", "这部分内容对于理解研究对象有什么帮助？", "论文中提到的关键参数有哪些？")
GENERAL_ANSWER = "根据论文内容，{context}... 这些观测为理解该天体的物理性质提供了重要信息。"


def topic_context(text: Column, terms: tuple[str, ...], most: int = 3, chars: int = 500) -> Column:
    """The first sentences that hold a term, else the text's start, ``chars`` at most."""
    found = F.array_join(tx.topic_sentences(text, terms, most), " ")
    return F.left(F.coalesce(F.nullif(found, F.lit("")), text), F.lit(chars))


def topic_questions(sections: DataFrame, questions: dict[str, tuple[str, ...]], answers: dict[str, tuple[str, ...]] | None = None, most_topics: int = 3, per_topic: int = 2, cap: int = 4) -> DataFrame:
    """(doc_id, topic, question, answer, context, confidence) from (doc_id, topic, score, rank, context): for each of a
    text's best topics ``per_topic`` of its questions, ``cap`` a text, the better topics' first.

    Questions and answer forms are chosen by md5 of text, topic and form, so they never change. An answer is filled with
    the context's first and second sentence and with a conclusion by the score; topics without questions give none."""
    answers = answers or {}
    listed = lambda forms: F.array(*map(F.lit, forms))
    by_topic = F.create_map(*[x for t in sorted(questions) for x in (F.lit(t), listed(questions[t]))])
    forms = F.lit(None).cast("array<string>")
    for topic, given in sorted(answers.items()):
        forms = F.when(F.col("topic") == topic, listed(given)).otherwise(forms)
    key = lambda form: F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "topic", form).cast("binary"))
    chosen = lambda forms: F.array_sort(F.transform(forms, lambda q: F.named_struct(F.lit("key"), key(q), F.lit("form"), q)))
    rows = sections.filter(F.col("rank") <= most_topics).withColumn("_q", F.slice(chosen(F.try_element_at(by_topic, "topic")), 1, per_topic))
    rows = rows.select("doc_id", "topic", "score", "rank", "context", chosen(F.coalesce(forms, listed(GENERAL_ANSWERS)))[0]["form"].alias("form"), F.posexplode("_q").alias("_i", "_q"))
    # A text has most_topics * per_topic rows at most.
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("doc_id").orderBy("rank", "topic", "_i"))).filter(F.col("_n") <= cap)
    parts = F.split("context", r"\.")
    values = {
        "content": F.left(F.coalesce(F.get(parts, 0), F.lit(NO_CONTENT)), F.lit(150)),
        "observation": F.coalesce(F.left(F.get(parts, 1), F.lit(100)), F.lit(NO_OBSERVATION)),
        "conclusion": F.when(F.col("score") < 0.5, UNSURE_CONCLUSION).otherwise(SURE_CONCLUSION),
    }
    answer = F.col("form")
    for name, value in values.items():
        answer = F.replace(answer, F.lit("{%s}" % name), value)
    return rows.select("doc_id", "topic", F.col("_q.form").alias("question"), F.left(answer, F.lit(400)).alias("answer"), F.left("context", F.lit(300)).alias("context"), F.round(F.col("score") * 0.8, 6).alias("confidence"))


def general_questions(docs: DataFrame, sections: DataFrame, n: int = 2, questions: tuple[str, ...] = GENERAL_QUESTIONS) -> DataFrame:
    """The same columns for the texts without any topic: the first ``n`` general questions, with confidence 0.6."""
    rest = docs.filter("text IS NOT NULL").join(sections.select("doc_id").distinct(), "doc_id", "left_anti")
    context = F.left("text", F.lit(300))
    rows = rest.select("doc_id", context.alias("context"), F.explode(F.array(*map(F.lit, questions[:n]))).alias("question"))
    return rows.select("doc_id", F.lit("general").alias("topic"), "question", F.replace(F.lit(GENERAL_ANSWER), F.lit("{context}"), F.col("context")).alias("answer"), "context", F.lit(0.6).alias("confidence"))


def bibliographic(text: Column) -> tuple[Column, Column]:
    """(arXiv id, DOI), null where there is none."""
    find = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return find(r"(?i)arxiv:\s*(\d{4}\.\d{4,5})"), find(r"(10\.\d{4,9}/[^ \t\n]+)")


# Kinds of statements, their patterns (value and unit) and confidence.
FACTS = (("period", r"(?i)period of (\d+(?:\.\d+)?) (min|hours?|days?)", 0.8), ("mass", r"(?i)(\d+(?:\.\d+)?) (solar masses)", 0.7), ("distance", r"(?i)(\d+(?:\.\d+)?) (pc|kpc|light-years)", 0.7))


def facts(docs: DataFrame, rules: tuple[tuple[str, str, float], ...] = FACTS) -> DataFrame:
    """(doc_id, kind, value, unit, confidence): period, mass and distance statements of a text; also of a stream."""
    group = lambda p, k: F.regexp_extract_all("text", F.lit(p), F.lit(k))
    found = [F.transform(F.arrays_zip(group(p, 1).alias("v"), group(p, 2).alias("u")), _fact(k, c)) for k, p, c in rules]
    return docs.select("doc_id", F.explode(F.concat(*found)).alias("f")).select("doc_id", "f.*")


# Statements of a parameter as (kind, pattern of value and unit); the kinds of object; their confidence.
PARAMETERS = (("period", r"(?i)periods?\s+of\s+([\d.]+)\s*(hour|hr|min|day)"), ("mass", r"(?i)mass\s+of\s+([\d.]+)\s*(M_?\s*sun)"), ("distance", r"(?i)distance\s+of\s+([\d.]+)\s*(pc|kpc|Mpc)"))
OBJECT_TYPES = r"(?i)(cataclysmic variable|white dwarf|neutron star|black hole|AM CVn)"
SURE_OF = {"parameter": 0.7, "fact": 0.8}


def typed_knowledge(papers: DataFrame) -> DataFrame:
    """(source, source_title, knowledge_type, content, confidence, entities) from papers (id, title, abstract): one row for
    each stated period, mass and distance, and for each kind of object that a paper names, whatever its case."""
    said = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    rows = papers.select("id", "title", said.alias("said"))
    group = lambda p, k: F.regexp_extract_all("said", F.lit(p), F.lit(k))
    row = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    content = lambda name: lambda x: row("parameter", F.concat(F.lit(f"Object has a {name} of "), x["v"], F.lit(" "), x["u"]))
    stated = [F.transform(F.arrays_zip(group(p, 1).alias("v"), group(p, 2).alias("u")), content(name)) for name, p in PARAMETERS]
    kinds = F.array_distinct(F.transform(group(OBJECT_TYPES, 1), F.lower))
    every = F.concat(*stated, F.transform(kinds, lambda k: row("fact", F.concat(F.lit("Object is classified as "), k))))
    found = rows.withColumn("k", F.explode(every))
    sure = F.when(F.col("k.kind") == "fact", SURE_OF["fact"]).otherwise(SURE_OF["parameter"])
    return found.select(F.col("id").alias("source"), F.col("title").alias("source_title"), F.col("k.kind").alias("knowledge_type"), "k.content", sure.alias("confidence"), tx.object_names(F.col("said")).alias("entities"))


def learned_priors(samples: DataFrame, query: str, labels: str, at: str) -> DataFrame:
    """(key, labels, first): the newest labels of each key (a query's first words), and when the key was first learned."""
    rows = samples.select(tx.learned_key(F.col(query)).alias("key"), F.col(labels).alias("labels"), F.col(at).alias("at")).filter("key != ''")
    return rows.groupBy("key").agg(F.max_by("labels", "at").alias("labels"), F.min("at").alias("first"))


def predicted_topics(queries: DataFrame, key: str, query: str, learned: DataFrame) -> DataFrame:
    """(key, labels): the labels of the key learned first among those that stand in a query, else the prior by its words.
    Keys meet queries in one pass over the queries, not pair by pair."""
    found = patterns.occurring(queries.select(key, F.lower(query).alias("_low")), key, "_low", learned.select(F.col("key").alias("pattern")))
    oldest = found.join(learned.withColumnRenamed("key", "pattern"), "pattern").groupBy(key).agg(F.min_by("labels", F.struct("first", "pattern")).alias("_learned"))
    return queries.join(oldest, key, "left").select(key, F.coalesce("_learned", tx.query_prior(F.col(query))).alias("labels"))


def _fact(kind: str, confidence: float):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["v"].cast("double").alias("value"), x["u"].alias("unit"), F.lit(confidence).alias("confidence"))


# Chat templates as (start of all, turn, suffix that asks for an answer).
CHAT = {
    "chatml": ("", "<|im_start|>{role}\n{text}<|im_end|>\n", "<|im_start|>assistant\n"),
    "llama3": ("<|begin_of_text|>", "<|start_header_id|>{role}<|end_header_id|>\n\n{text}<|eot_id|>", "<|start_header_id|>assistant<|end_header_id|>\n\n"),
    "qwen2": ("", "<|im_start|>{role}\n{text}<|im_end|>\n", "<|im_start|>assistant\n"),
    "yi": ("", "<|im_start|>{role}\n{text}<|im_end|>\n", "<|im_start|>assistant\n"),
    "gemma": ("<bos>", "<start_of_turn>{role}\n{text}<end_of_turn>\n", "<start_of_turn>model\n"),
}


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): array of (turn, role, text) in order; a conversation's turns meet in one row."""
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def rendered(chats: DataFrame, style: str = "chatml", generate: bool = False) -> DataFrame:
    start, turn, suffix = CHAT[style]
    before, rest = turn.split("{role}")
    between, after = rest.split("{text}")
    # This style has no turns of the system's own.
    name = (lambda r: F.when(r == "assistant", "model").when(r == "system", "user").otherwise(r)) if style == "gemma" else (lambda r: r)
    said = F.transform("messages", lambda m: F.concat(F.lit(before), name(m["role"]), F.lit(between), F.coalesce(m["text"], F.lit("")), F.lit(after)))
    return chats.select("conv_id", F.concat(F.lit(start), F.array_join(said, ""), F.lit(suffix if generate else "")).alias("prompt"))


def alpaca(turns: DataFrame) -> DataFrame:
    """(conv_id, instruction, input, output): the last user and assistant turns, the system turn as input."""
    last = lambda role: F.max_by("text", F.when(F.col("role") == role, F.col("turn")))
    rows = turns.groupBy("conv_id").agg(last("user").alias("instruction"), F.coalesce(last("system"), F.lit("")).alias("input"), last("assistant").alias("output"))
    return rows.filter("instruction IS NOT NULL AND output IS NOT NULL")


def turn_statistics(turns: DataFrame) -> DataFrame:
    """(role, n_turns, n_convs, mean_turns)."""
    rows = turns.groupBy("role").agg(F.count("*").alias("n_turns"), F.countDistinct("conv_id").alias("n_convs"))
    return rows.withColumn("mean_turns", F.round(F.col("n_turns") / F.col("n_convs"), 4))


def stable_order(key: str | Column, seed: int = 42) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"))


def stable_split(rows: DataFrame, key: str, train: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``split`` by the md5 of the key: no shuffle, and a row's side never changes as the table grows."""
    part = F.conv(F.substring(stable_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("split", F.when(part < train, "train").otherwise("test"))


def sample_per(rows: DataFrame, by: str, key: str, n: int = 1, seed: int = 42) -> DataFrame:
    w = W.partitionBy(by).orderBy(stable_order(key, seed), key)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def oversample(rows: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` over, numbered from 1; none for 0 or null."""
    return rows.withColumn("_n", times).filter("_n > 0").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")


def numbered(rows: DataFrame, key: str, prefix: str, width: int = 5) -> DataFrame:
    """Sequential names in key order without one sorting task: ranges are written once, counted, and each adds those
    before it. Equal keys are numbered in any order."""
    ranged = stored(rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_p": F.shiftrightunsigned("_at", 33), "_i": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    # A row for each range.
    before = counts.withColumn("_b", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))).select("_p", F.coalesce("_b", F.lit(0)).alias("_b"))
    named = ranged.join(F.broadcast(before), "_p").withColumn("_k", F.col("_b") + F.col("_i"))
    return named.withColumn("name", F.concat(F.lit(prefix), F.lpad(F.col("_k").cast("string"), width, "0"))).drop("_p", "_i", "_at", "_b", "_k")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge: a new field that is neither null nor empty overrides the old one."""
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}").eqNullSafe(F.col(f"n.{key}")), "full")
    fields = [c for c in old.columns if c != key]
    merged = [F.coalesce(F.when(F.col(f"n.{c}").cast("string") != "", F.col(f"n.{c}")), F.col(f"o.{c}")).alias(c) for c in fields]
    return joined.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *merged)


#: Entities up to which a fact meets others by three of them at once.
WIDE = 16


def conflicts(new: DataFrame, old: DataFrame, least: float = 0.85, spread: float = 0.2) -> DataFrame:
    """Pairs of facts (id, kind, value, entities, terms) that are alike (0.6 of the entities' overlap over the larger set
    and 0.4 of the terms' Jaccard) and contradict: values apart by over ``spread`` of the larger, at least of 1.

    Likeness above 0.85 needs an overlap above 0.75, so alike facts of n entities share r = floor(0.75 n) + 1 of them, and
    in any common order l of these stand among the first n - r + l: pairs meet on l entities of these prefixes. l is 3, or
    1 for sets beyond ``WIDE``, where the triples of a prefix would be many; sets under three meet only their equals. The
    order is by how many facts of either side name an entity, so pairs meet on rare ones. A pair is kept where it meets on
    the first entities its prefixes share, and only pairs that pass are shuffled again."""
    named = lambda df: df.select("id", F.explode(F.array_compact(F.array_distinct("entities"))).alias("entity"))
    df = named(new).unionByName(named(old)).groupBy("entity").agg(F.count("*").alias("_df"))
    key = lambda *e: F.xxhash64(F.lit(len(e)), *e)
    places = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def prefix(sorted_: Column, length: int) -> Column:
        n = F.size(sorted_)
        return F.slice(sorted_, 1, n - (F.floor(0.75 * n).cast("int") + 1) + length)

    def triples(p: Column) -> Column:
        n, at = F.size(p), lambda i: F.get(p, i - 1)
        third = lambda i, j: F.transform(places(j + 1, n), lambda k: key(at(i), at(j), at(k)))
        all_ = F.flatten(F.transform(places(F.lit(1), n - 2), lambda i: F.flatten(F.transform(places(i + 1, n - 1), lambda j: third(i, j)))))
        return F.when(n < 3, F.array(key(*[F.get(p, F.lit(i)) for i in range(3)]))).otherwise(all_)

    def side(facts: DataFrame, s: str) -> DataFrame:
        order = named(facts).join(df, "entity").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("_df", "entity"))).alias("_o")).select("id", F.transform("_o", lambda x: x["entity"]).alias(f"{s}_e"))
        rows = facts.select("id", "kind", F.col("value").alias(f"{s}_value"), F.col("terms").alias(f"{s}_t")).join(order, "id").withColumn("_n", F.size(f"{s}_e"))
        e = F.col(f"{s}_e")
        narrow = F.when(F.col("_n") <= WIDE, triples(prefix(e, 3))).otherwise(F.array().cast("array<bigint>"))
        wide = F.when(F.col("_n") > 0.75 * WIDE, F.transform(prefix(e, 1), lambda x: key(x))).otherwise(F.array().cast("array<bigint>"))
        return rows.withColumn("_key", F.explode(F.concat(narrow, wide))).drop("_n").withColumnRenamed("id", f"{s}_id")

    pairs = side(new, "n").join(side(old, "o"), ["_key", "kind"])
    larger = F.greatest(F.size("n_e"), F.size("o_e"))
    shared = lambda length: F.array_intersect(prefix(F.col("n_e"), length), prefix(F.col("o_e"), length))
    first = F.when(larger > WIDE, key(F.get(shared(1), F.lit(0)))).otherwise(key(*[F.get(shared(3), F.lit(i)) for i in range(3)]))
    sized = (F.size("n_e") > 0.75 * F.size("o_e")) & (F.size("o_e") > 0.75 * F.size("n_e"))
    apart = F.abs(F.col("n_value") - F.col("o_value")) > spread * F.greatest("n_value", "o_value", F.lit(1.0))
    overlap = F.size(F.array_intersect("n_e", "o_e")) / larger
    likeness = F.round(0.6 * overlap + 0.4 * F.coalesce(tx.jaccard(F.col("n_t"), F.col("o_t")), F.lit(0.0)), 6)
    pairs = pairs.filter((F.col("n_id") != F.col("o_id")) & sized & apart & (F.col("_key") == first)).withColumn("likeness", likeness)
    # What is left to drop are ids that stand in several rows.
    return pairs.filter(F.col("likeness") > least).select("n_id", "o_id", "kind", "n_value", "o_value", "likeness").dropDuplicates(["n_id", "o_id"])
