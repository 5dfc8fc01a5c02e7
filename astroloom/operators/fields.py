"""Keyword search that knows where a word stands: in an entry's key or in its content, and in which paragraph."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.shared import stored
from .retrieval import counted, ranked

# What a match of the name, a query word in the key and one in the content score.
NAME, IN_KEY, IN_CONTENT = 10, 3, 1


def field_postings(entries: DataFrame, only: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """(term, doc_id, in_key, in_content) from entries (doc_id, key, content), of the terms in ``only`` if given; a row for
    each side that has the term where the number of entries is given and no id repeats, else one for both."""
    terms = lambda c: counted(entries.select("doc_id", tx.terms(F.col(c)).alias("terms")), only)
    side = lambda c, flag: terms(c).select("term", "doc_id", F.lit(flag).alias("in_key"), F.lit(1 - flag).alias("in_content"))
    rows = side("key", 1).unionByName(side("content", 0))
    if n is not None and entries.select("doc_id").distinct().count() == n:
        return rows
    return rows.groupBy("term", "doc_id").agg(F.max("in_key").alias("in_key"), F.max("in_content").alias("in_content"))


def same_names(cell: np.ndarray, value: np.ndarray, names: list[list[str]], said: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a key and a query of which one stands in the other. All words of the shorter are shared then, so only
    pairs that share as many key words as one of them has are compared."""
    keyed = np.bincount(cell[value >= IN_KEY])
    at = np.flatnonzero(keyed)
    words = lambda texts: np.array([len(set(x.split())) for x in texts], dtype=np.int64)
    doc, query = np.divmod(at, len(said))
    shared, asked = keyed[at], words(said)
    found = np.zeros(len(at), dtype=bool)
    for turn in range(max(map(len, names), default=0)):  # repeated ids have several names
        each = [x[turn] if len(x) > turn else "" for x in names]
        near = np.flatnonzero((shared == words(each)[doc]) | (shared == asked[query]))
        stands = (each[d] in said[q] or said[q] in each[d] for d, q in zip(doc[near], query[near], strict=True))
        found[near] |= np.fromiter(stands, dtype=bool, count=len(near))
    return at[found], np.full(found.sum(), float(NAME))


def field_search(entries: DataFrame, queries: DataFrame, k: int = 5, separator: str = "\n\n") -> DataFrame:
    """(qid, doc_id, score, rank, paragraph, best) for queries (qid, text): 3 for each distinct query word in the key, 1 for
    each in the content, and 10 if the words of the key stand together in the query or the other way round; of the k best
    the paragraph with most distinct query words, the first of equals.

    A name can match only where a word is shared, so names are compared for entries that met the query by a key word.
    Paragraphs are cut for the k best alone."""
    asked = queries.select("qid", F.array_distinct(tx.terms(F.col("text"))).alias("words"), F.concat(F.lit(" "), F.array_join(tx.terms(F.col("text")), " "), F.lit(" ")).alias("note"))
    # A query without an id has no rows, and no note to compare names with.
    terms, n = asked.filter("qid IS NOT NULL").select("qid", F.explode("words").alias("term")), entries.count()
    named = entries.select("doc_id", F.concat(F.lit(" "), F.array_join(tx.terms(F.col("key")), " "), F.lit(" ")).alias("note"))
    index = stored(field_postings(entries, terms, n)).select("term", "doc_id", (IN_KEY * F.col("in_key") + IN_CONTENT * F.col("in_content")).cast("double").alias("x"))
    index = index.unionByName(named.withColumn("x", F.lit(0.0)), allowMissingColumns=True)
    best = ranked(index, terms.withColumn("w", F.lit(1.0)), n, k, extra=same_names, notes=asked.select("qid", "note"))
    best = best.select("qid", "doc_id", F.col("score").cast("long").alias("score"), "rank")
    parts = best.join(entries.select("doc_id", "content"), "doc_id").join(asked.select("qid", "words"), "qid")
    parts = parts.select("qid", "doc_id", "score", "rank", "words", F.posexplode(F.split(F.coalesce("content", F.lit("")), separator)).alias("at", "text"))
    shared = F.size(F.array_intersect(tx.terms(F.col("text")), "words"))
    first = W.partitionBy("qid", "doc_id").orderBy(F.desc("n"), "at")  # of one entry's paragraphs
    parts = parts.withColumn("n", shared).withColumn("_r", F.row_number().over(first)).filter("_r = 1")
    return parts.select("qid", "doc_id", "score", "rank", F.col("at").alias("paragraph"), F.trim("text").alias("best"))
