"""Knowledge-base queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge as k
from ..operators import retrieval as r
from .base import registrar, table
from .retrieval import IDF, INDEX, TFIDF, TOP, _asked, _index, _keyword

QUERIES, ORACLE_SQL, query = registrar()


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
h AS (SELECT *, regexp_matches(line, '^[A-ZÉ]{2,}') AS is_head FROM l), s AS (SELECT *, sum(CAST(is_head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN is_head THEN left(line, 40) END) AS heading, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM s GROUP BY ALL""")
def section_split(spark, sf):
    return k.sections(table(spark, sf, "documents"), "^[A-ZÉ]{2,}")


# Ranges of the class query, as (class, from, to, score).
CLASSES = (("tiny", 0.0, 10.0, 0.9), ("small", 0.0, 100.0, 0.7), ("mid", 50.0, 300.0, 0.6), ("wide", 100.0, 2000.0, 0.4))


@query(f"""WITH v AS (SELECT user_id AS id, max(value) AS top FROM events GROUP BY user_id), r AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a}e0, {b}e0, {s}e0)" for n, a, b, s in CLASSES)}) AS x(class, lo, hi, score)),
j AS (SELECT id, class, score FROM v LEFT JOIN r ON top >= lo AND top < hi) SELECT id, first(class ORDER BY score DESC, class) AS class, max(score) AS score, coalesce(string_agg(class, ',' ORDER BY score DESC, class), '') AS classes FROM j GROUP BY id""")
def class_rules(spark, sf):
    top = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("top"))
    return k.best_class(top, "id", "top", spark.createDataFrame(list(CLASSES), "class string, lo double, hi double, score double"))


# Words of the mapping query and their topics.
MAPPING = {"password": ("secrets",), "license": ("law", "notices"), "token": ("secrets",)}


@query("""WITH m AS (SELECT * FROM (VALUES ('password', 'secrets'), ('license', 'law'), ('license', 'notices'), ('token', 'secrets')) AS x(k, topic))
SELECT DISTINCT doc_id, topic, 20.0e0 AS score FROM documents JOIN m ON contains(lower(text), k)""")
def priority_topics(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.explode(k.mapped_topics(F.col("text"), MAPPING)).alias("t")).select("doc_id", "t.topic", "t.score")


@query("""WITH s AS (SELECT o_custkey, string_agg(left(o_orderpriority, 100), ' | ' ORDER BY o_orderkey) AS snippets FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY o_custkey),
h AS (SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 6),
n AS (SELECT c.c_custkey AS id, h.c_custkey AS o, row_number() OVER (PARTITION BY c.c_custkey ORDER BY h.c_custkey) AS r FROM customer c JOIN h USING (c_nationkey) WHERE h.c_custkey <> c.c_custkey),
m AS (SELECT id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS others FROM n WHERE r <= 5 GROUP BY id)
SELECT c_custkey AS id, c_nationkey AS kind, snippets, coalesce(others, '') AS similar FROM customer LEFT JOIN s ON o_custkey = c_custkey LEFT JOIN m ON id = c_custkey""")
def source_profiles(spark, sf):
    entries = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("kind"))
    snippets = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("text"))
    return k.profiles(entries, "id", "kind", snippets)


@query("""WITH s AS (SELECT user_id AS target, event_type AS ref, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT target, ref, event_id, CAST(step AS INT) AS step, CAST(min(step) OVER (PARTITION BY target, ref) AS INT) AS first_use FROM s""")
def running_steps(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("target"), F.col("event_type").alias("ref"), "event_id", "ts")
    return k.steps(rows, "target", ["ts", "event_id"]).drop("ts")


@query(f"""WITH {INDEX}, {_keyword(IDF)}, a AS ({TOP.format("h", 5)}), h2 AS (SELECT qid, doc_id, round(sum({TFIDF}), 6) AS score FROM asked JOIN post USING (term) JOIN df USING (term), n GROUP BY qid, doc_id), b AS ({TOP.format("h2", 5)}),
u AS (SELECT qid, doc_id, greatest(5e0 - (rank - 1), 0) AS s FROM a UNION ALL SELECT qid, doc_id, greatest(3e0 - 0.5e0 * (rank - 1), 0) FROM b), g AS (SELECT qid, doc_id, max(s) AS score, count(*) AS lists FROM u GROUP BY ALL) {TOP.format("g", 5)}""")
def merged_retrieval(spark, sf):
    asked = r.query_terms(_asked(spark, sf))
    index, n = _index(spark, sf, asked)
    return k.merged_retrieval([(r.keyword_search(index, n, asked), 5.0, 1.0), (r.keyword_search(index, n, asked, "tfidf"), 3.0, 0.5)], 5)
