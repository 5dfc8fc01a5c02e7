"""Knowledge-base operators: sections, class rules, topic mapping, profiles, steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .blocks import beside, placed


def sections(docs: DataFrame, header: str) -> DataFrame:
    """(doc_id, section, heading, n_lines, n_chars): lines between a line that matches ``header`` and the next; section 0
    stands before the first heading. Only a document's own lines are ordered."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("is_head", F.col("line").rlike(header))
    w = W.partitionBy("doc_id").orderBy("at")
    lines = lines.withColumn("section", F.sum(F.col("is_head").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return lines.groupBy("doc_id", "section").agg(F.max(F.when(F.col("is_head"), F.left("line", F.lit(40)))).alias("heading"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def best_class(rows: DataFrame, key: str, value: str, rules: DataFrame) -> DataFrame:
    """(key, class, score, classes): of the rules (class, lo, hi, score) whose range holds the value the best one, and
    all of them from the best down. The rules are a parameter-sized table; rows without a rule get nulls."""
    joined = rows.select(key, value).join(rules, (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi")), "left")
    found = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("class").isNotNull(), F.struct((-F.col("score")).alias("minus"), "class")))).alias("h"))
    return found.select(key, F.get("h", F.lit(0))["class"].alias("class"), (-F.get("h", F.lit(0))["minus"]).alias("score"), F.array_join(F.transform("h", lambda x: x["class"]), ",").alias("classes"))


def mapped_topics(text: Column, mapping: dict[str, tuple[str, ...]], score: float = 20.0) -> Column:
    """Array of (topic, score) of every mapping key that stands in the text."""
    low = F.lower(text)
    hits = [F.when(F.contains(low, F.lit(k)), F.array(*[F.struct(F.lit(t).alias("topic"), F.lit(score).alias("score")) for t in topics])) for k, topics in sorted(mapping.items())]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*hits))))


def profiles(entries: DataFrame, key: str, kind: str, snippets: DataFrame, n: int = 3, length: int = 100, same: int = 5) -> DataFrame:
    """(key, kind, snippets, similar): the first n snippets of an entry and up to ``same`` other entries of its kind.

    The others come from the kind's first same + 1 keys, so no pair of entries is formed."""
    w = W.partitionBy(key).orderBy("at")
    first = snippets.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    said = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.left("text", F.lit(length)).alias("t")))), lambda x: x["t"]), " | ").alias("snippets"))
    head = entries.select(kind, key).withColumn("_r", F.row_number().over(W.partitionBy(kind).orderBy(key))).filter(F.col("_r") <= same + 1)
    heads = head.groupBy(kind).agg(F.array_sort(F.collect_list(key)).alias("_k"))
    rows = entries.select(key, kind).join(said, key, "left").join(heads, kind, "left")
    similar = F.slice(F.filter("_k", lambda k: k != F.col(key)), 1, same)
    return rows.select(key, kind, "snippets", F.array_join(F.transform(similar, lambda k: k.cast("string")), ",").alias("similar"))


def steps(events: DataFrame, target: str, order: list[str]) -> DataFrame:
    """Adds ``step``, the running number within a target, and ``first_use``, the step where a reference first occurs."""
    rows = placed(events, [target], order, "_at").withColumn("step", (F.col("_at") + 1).cast("int")).drop("_at")
    return beside(rows, rows.groupBy(target, "ref").agg(F.min("step").alias("first_use")), [target, "ref"])


def merged_retrieval(sources: list[tuple[DataFrame, float, float]], k: int) -> DataFrame:
    """One ranking of several hit lists (qid, doc_id, rank): a hit scores top - step * (rank - 1), not below 0; of a
    document found by several lists the best score stays."""
    every = None
    for n, (hits, top, step) in enumerate(sources):
        scored = hits.select("qid", "doc_id", F.greatest(F.lit(top) - step * (F.col("rank") - 1), F.lit(0.0)).alias("score"), F.lit(n).alias("list"))
        every = scored if every is None else every.unionByName(scored)
    best = every.groupBy("qid", "doc_id").agg(F.max("score").alias("score"), F.count("*").alias("lists"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "doc_id"))).filter(F.col("rank") <= k)
