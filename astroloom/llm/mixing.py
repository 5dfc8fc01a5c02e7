"""Mixing sources to target weights by Pareto order sampling.

Words are shared out among the sources by weight; no source gives more than a stated multiple of what it holds, and what
it can't take is shared among the others. Every document of a source is then expected as often as its target over its
size: the whole copies of that are certain, and the fraction left is the document's inclusion probability p for one copy
more. With u uniform, documents are ranked by the random odds over the inclusion odds, u / (1 - u) / (p / (1 - p)), and
the first are taken: a sample of fixed size, whose probabilities differ from source to source. Sizes count in words, so
the sample of a source ends at the word at which its target is met, and the document there gives what is left of it.

Only ids, sizes and ranks move; texts are read once, where they lie. Ranks are summed in ranges, so one source may hold
any share of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import placed, scanned
from .common import durable, table, written

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in the order of their names, repeating; what is shared out, as a multiple of all words;
    how often a source may give its words at most."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.0
    most: int = 3


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text, 0 for null) and u, uniform in (0, 1) by a hash of id and text."""
    text = F.coalesce("text", F.lit(""))
    digits = F.substring(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text), 256), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), u.alias("u"))


def targets(totals: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``totals`` (source, source_size) with weight and target: sources whose share at the common level of words per
    weight is above their limit stop there, and the level rises by what they leave until none is above."""
    order = placed(totals.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.pmod("place", F.lit(len(mix.weights))) + 1).cast("int"))
    order = durable(order.select("source", "source_size", weight.alias("weight"), (mix.most * F.col("source_size")).alias("_most")))
    all_words = mix.share * (order.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:  # each turn stops one source more at least; a turn is one aggregate over the table of sources
        stopped = (F.col("_most") / F.col("weight") < level) if full >= 0 else F.lit(False)
        n, held, weights = order.agg(F.count_if(stopped), F.sum(F.when(stopped, F.col("_most"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if n == full:
            break
        full, level = n, (all_words - (held or 0)) / weights if weights else float("inf")
    target = F.when(F.col("_most") / F.col("weight") < level, F.col("_most").cast("double")).otherwise(F.col("weight") * level)
    return order.select("source", "source_size", "weight", target.alias("target"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies (certain whole ones) and inclusion (the probability of
    one more); one row per row.

    ``taken`` of a source sum to its target, rounded; no row gives more than ``most`` times its size. Null texts and
    texts without words have size 0 and give nothing; rows without a source are a source of their own, the last. Rows
    without an id, and rows that repeat an id with another text, have ranks of their own; rows equal in all of source, id
    and text share a rank and are told apart by where they stand, which no result shows. Only doc_id, text and source are
    read; an empty table gives no rows, and a table without words takes none."""
    rows = written(sized(docs))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), mix).withColumnRenamed("source", "_source")
    quota = F.floor(F.col("target") + 0.5).cast("long")
    copies = F.coalesce(F.expr("try_divide(_quota - pmod(_quota, nullif(source_size, 0)), source_size)").cast("long"), F.lit(0).cast("long"))
    wanted = durable(wanted.withColumn("_quota", quota).withColumn("copies", copies).withColumn("_left", F.col("_quota") - F.col("copies") * F.col("source_size")))
    p = F.coalesce(F.col("_left") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    rows = rows.join(wanted, F.col("source").eqNullSafe(F.col("_source"))).withColumn("inclusion", p)
    some = rows.filter("_left > 0")
    rank = F.col("u") / (1 - F.col("u")) / (F.col("inclusion") / (1 - F.col("inclusion")))
    ranked = scanned(some.withColumn("_rank", rank), ["source"], ["_rank", "doc_id", "size"], {"_upto": F.col("size")})
    more = F.least("size", F.greatest(F.lit(0).cast("long"), F.col("_left") - (F.col("_upto") - F.col("size"))))
    both = ranked.withColumn("_more", more).drop("_rank", "_upto").unionByName(rows.filter("_left = 0").withColumn("_more", F.lit(0).cast("long")))
    return both.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("_more")).alias("taken"), "source", "copies", "inclusion")


def drawn(docs: DataFrame, mixture: DataFrame) -> DataFrame:
    """The mix itself: the rows of ``docs``, whose ids are unique, once for each copy, with ``repeat`` from 1; a copy that
    is cut holds its first words, joined by single spaces. Other columns stay as they are."""
    taken = mixture.filter("taken > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    rows = docs.join(taken, F.col("doc_id") == F.col("_id")).withColumn("repeat", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    left = F.col("_taken") - (F.col("repeat") - 1) * F.col("_size")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)), 1, F.greatest(left, F.lit(1)).cast("int")), " ")
    return rows.withColumn("text", F.when(left < F.col("_size"), cut).otherwise(F.col("text"))).drop("_id", "_size", "_taken")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


QUERIES = {"op13_mixing": op13_mixing}
ORACLE_SQL = {
    "op13_mixing": r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, [5e0, 2e0, 1e0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
r AS (SELECT *, 3 * source_size / weight AS ratio FROM o),
c AS (SELECT *, coalesce(sum(3 * source_size) OVER w, 0) AS held, coalesce(sum(weight) OVER w, 0) AS gone FROM r
  WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, ratio < (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - held) / ((SELECT sum(weight) FROM o) - gone) AS stopped FROM c),
l AS (SELECT (CAST(sum(source_size) AS DOUBLE) - coalesce(sum(3 * source_size) FILTER (WHERE stopped), 0)) / sum(weight) FILTER (WHERE NOT stopped) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN stopped THEN CAST(3 * source_size AS DOUBLE) ELSE weight * level END AS target FROM f, l),
q AS (SELECT *, coalesce(CAST(floor(target + 0.5e0) AS BIGINT) // nullif(source_size, 0), 0) AS copies, CAST(floor(target + 0.5e0) AS BIGINT) AS quota FROM t),
p AS (SELECT d.doc_id, d.source, d.size, d.u, q.source_size, q.target, q.copies, q.quota - q.copies * q.source_size AS spare,
  coalesce(CAST(q.quota - q.copies * q.source_size AS DOUBLE) / nullif(q.source_size, 0), 0) AS inclusion FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u) / (nullif(inclusion, 0) / (1 - inclusion)), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM p)
SELECT doc_id, size, source_size, target, CAST(copies * size + least(size, greatest(0, spare - (upto - size))) AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies, inclusion FROM k""",
}
