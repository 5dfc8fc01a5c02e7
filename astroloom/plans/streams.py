"""Streams over the event table, each run once over all that is there and compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import corpus as c
from ..operators import models
from ..operators import retrieval as r
from ..sources.shared import shared_dir
from ..streaming import incremental as inc
from ..streaming import knowledge
from .base import registrar, table
from .retrieval import IDF, INDEX, TOP, _keyword

QUERIES, ORACLE_SQL, query = registrar()


def _work(spark) -> str:
    """A folder of its own in the cluster's shared one."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    path = f"{sf}/events.parquet"
    schema = table(spark, sf, "events").schema
    rows = inc.event_stream(spark, path.rpartition("/")[0] + "/events.parquet*", schema)
    return rows.select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id", "event_type")


def _stored_events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query("SELECT user_id AS source, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean FROM events GROUP BY ALL")
def stream_downsample(spark, sf):
    """The stream's closed days and, as of now, the open ones."""
    work = _work(spark)
    inc.to_parquet(inc.downsampled(_events(spark, sf), "1 day"), f"{work}/out", f"{work}/state")
    rows = inc.with_open(spark.read.parquet(f"{work}/out"), _stored_events(spark, sf), lambda e: inc.windowed(e, "1 day"))
    return rows.select("source", F.unix_timestamp("start").alias("start"), "n", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query("""SELECT user_id AS source, CAST(epoch(time_bucket(INTERVAL 12 HOUR, ts)) AS BIGINT) - 43200 * b AS start, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean FROM events, (SELECT unnest([0, 1]) AS b) GROUP BY ALL""")
def stream_sliding(spark, sf):
    """Days that begin every 12 hours; of the open ones, those that began before the last closed one ended are whole."""
    work = _work(spark)
    inc.to_parquet(inc.downsampled(_events(spark, sf), "1 day", "12 hours"), f"{work}/out", f"{work}/state")
    rows = inc.with_open(spark.read.parquet(f"{work}/out"), _stored_events(spark, sf), lambda e: inc.windowed(e, "1 day", "12 hours"), "1 day")
    return rows.select("source", F.unix_timestamp("start").alias("start"), "n", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id AS source, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n, max(value) AS top FROM r GROUP BY user_id, run""")
def stream_sessions(spark, sf):
    work = _work(spark)
    inc.to_parquet(inc.observing_runs(_events(spark, sf), "12 hours"), f"{work}/out", f"{work}/state")
    rows = inc.with_open(spark.read.parquet(f"{work}/out"), _stored_events(spark, sf), lambda e: inc.runs(e, "12 hours"))
    return rows.select("source", F.unix_timestamp("start").alias("start"), "n", "top")


@query("SELECT event_id FROM events")
def stream_dedup(spark, sf):
    work = _work(spark)
    inc.to_parquet(inc.first_seen(_events(spark, sf), "event_id").select("event_id"), f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out")


@query("SELECT user_id AS source, count(*) AS n, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS sigma, stddev_pop(value) > 0.1 * abs(avg(value)) AS variable FROM events GROUP BY user_id")
def stream_variability(spark, sf):
    work = _work(spark)
    inc.by_batch(inc.variability(_events(spark, sf)), f"{work}/out", f"{work}/state", mode="update")
    rows = inc.latest_of_batches(spark, f"{work}/out", "source")
    return rows.select("source", "n", F.round("mean", 3).alias("mean"), F.round("sigma", 3).alias("sigma"), "variable")


@query("""WITH a AS (SELECT o_custkey AS id, o_orderpriority AS content, o_totalprice / 600000 AS confidence, o_orderdate AS ts, o_orderkey % 2 AS new FROM orders),
s AS (SELECT *, confidence + 0.1e0 * epoch(ts) / 1e9 AS s FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, ts DESC, content DESC, confidence DESC, new DESC) AS i, max(new) OVER (PARTITION BY id) AS anynew FROM s)
SELECT id, content, confidence, CASE WHEN new = 0 AND anynew = 1 THEN 'kept over a newer statement' END AS note FROM r WHERE i = 1""")
def knowledge_resolve(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("content"), (F.col("o_totalprice") / 600000).alias("confidence"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey")
    half = lambda k: rows.filter(F.col("o_orderkey") % 2 == k).drop("o_orderkey")
    return inc.resolved(half(0), half(1), ["id"]).select("id", "content", "confidence", "note")


@query("SELECT user_id AS source, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_new_keys(spark, sf):
    """A source that repeats itself: every pair of user and type is new once, however often all events come again."""
    work = _work(spark)
    for run in (1, 2):  # the second run finds every event again, in new files
        table(spark, sf, "events").write.mode("append").parquet(f"{work}/in")
        stream = inc.event_stream(spark, f"{work}/in", table(spark, sf, "events").schema)
        keyed = stream.select(F.col("user_id").alias("source"), "event_type", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"))
        inc.new_rows(keyed, "key", f"{work}/out", f"{work}/state")
    rows = spark.read.option("basePath", f"{work}/out/rows").parquet(f"{work}/out/rows/batch=*")
    return rows.groupBy("source", "event_type").agg(F.count("*").alias("n"))


_FACTS = """f AS (SELECT l_orderkey AS id, max(l_extendedprice) AS value, list_distinct(list(l_suppkey)) AS e, list_distinct(list(l_returnflag)) AS t, max(l_discount) * 10 AS confidence, epoch(max(l_shipdate)) AS at FROM lineitem GROUP BY l_orderkey),
x AS (SELECT id, unnest(e) AS entity FROM f), p AS (SELECT DISTINCT a.id AS n_id, b.id AS o_id FROM x a JOIN x b USING (entity) WHERE a.id % 2 = 1 AND b.id % 2 = 0),
s AS (SELECT n_id, o_id, b.confidence + 0.1e0 * b.at / 1e9 AS trust, round(0.6e0 * len(list_intersect(a.e, b.e)) / greatest(len(a.e), len(b.e)) + 0.4e0 * len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS likeness,
  abs(a.value - b.value) > 0.2 * greatest(a.value, b.value, 1) AS apart FROM p JOIN f a ON a.id = n_id JOIN f b ON b.id = o_id),
best AS (SELECT * FROM (SELECT n_id, o_id, trust, row_number() OVER (PARTITION BY n_id ORDER BY trust DESC, o_id) AS i FROM s WHERE likeness > 0.85 AND apart) WHERE i = 1)"""


@query(f"""WITH {_FACTS} SELECT f.id, CASE WHEN trust > f.confidence + 0.1e0 * f.at / 1e9 THEN o_id ELSE f.id END AS kept, CASE WHEN trust > f.confidence + 0.1e0 * f.at / 1e9 THEN w.value ELSE f.value END AS value,
CASE WHEN trust > f.confidence + 0.1e0 * f.at / 1e9 THEN 'kept over order ' || f.id END AS note FROM f LEFT JOIN best ON n_id = f.id LEFT JOIN f w ON w.id = o_id""")
def knowledge_stream(spark, sf):
    """Facts of even orders arrive first, those of odd orders are then set against them."""
    work = _work(spark)
    facts = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.max("l_extendedprice").alias("value"), F.array_sort(F.collect_set("l_suppkey")).alias("entities"), F.array_sort(F.collect_set("l_returnflag")).alias("terms"),
        (F.max("l_discount") * 10).alias("confidence"), F.max("l_shipdate").cast("timestamp").alias("ts"),
    )
    facts = facts.withColumns({"kind": F.lit("price"), "source": F.concat(F.lit("order "), F.col("id").cast("string"))})
    kept = knowledge.KnowledgeTable(f"{work}/table")
    for half in (0, 1):
        facts.filter(F.col("id") % 2 == half).write.mode("append").parquet(f"{work}/in")
        kept.keep(inc.event_stream(spark, f"{work}/in", facts.schema, 10_000), f"{work}/state")
    return kept.version(spark, 2, facts.schema).select("id", "kept", "value", "note")


def _documents(spark, sf):
    schema = table(spark, sf, "documents").schema
    return inc.event_stream(spark, f"{sf}/documents.parquet*", schema).select("doc_id", "text")


@query(r"""SELECT doc_id, 'version' AS kind, CAST(unnest(regexp_extract_all(text, 'ersion (\d+)', 1)) AS DOUBLE) AS value FROM documents""")
def stream_facts(spark, sf):
    """Statements extracted from each new document as it arrives."""
    work = _work(spark)
    found = c.facts(_documents(spark, sf), (("version", r"ersion (\d+)()", 0.8),)).select("doc_id", "kind", "value")
    inc.to_parquet(found, f"{work}/out", f"{work}/state")
    return spark.read.parquet(f"{work}/out")


@query(r"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{2,}')) AS term FROM documents), post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY term""")
def stream_index(spark, sf):
    """Postings appended batch by batch; document frequencies are an aggregate of them."""
    work = _work(spark)
    index = models.TextIndex(f"{work}/index")
    index.keep(_documents(spark, sf), f"{work}/state")
    return r.term_statistics(models.TextIndex.load(f"{work}/index").postings(spark))


@query(rf"""WITH {INDEX}, {_keyword(IDF)} {TOP.format('h', 5)}""")
def stream_index_search(spark, sf):
    """Keyword search of an index that a stream keeps."""
    work = _work(spark)
    index = models.TextIndex(f"{work}/index")
    index.keep(_documents(spark, sf), f"{work}/state")
    return index.search(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"))
