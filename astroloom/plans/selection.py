"""Queries of tokenisers, predicates and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as nx
from ..functions import text as tx
from ..operators import selection as s
from .base import registrar, table

QUERIES, ORACLE_SQL, query = registrar()


def _stop(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _kept(source: str, stop, least: int) -> str:
    return f"list_filter({source}, lambda w: NOT list_contains({_stop(stop)}, w) AND length(w) >= {least})"


_SPLIT = lambda x: rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"
_A = _kept(_SPLIT(r"regexp_replace(lower(x), '[^\p{L}\p{N}_\s\-.]', ' ', 'g')"), tx.STOP_A, 2)
_B = _kept("regexp_extract_all(lower(x), '[a-z]+')", tx.STOP_B, 2)
_D = _kept(_SPLIT(r"regexp_replace(x, '[^\p{L}\p{N}_\s]', ' ', 'g')"), tx.STOP_D, 2)
_L = _kept(_SPLIT(r"regexp_replace(lower(x), '[^\p{L}\p{N}_\s]', ' ', 'g')"), tx.STOP_LITERATURE, 4)


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents)
SELECT doc_id, len({_A}) AS n_a, md5(array_to_string({_A}, ' ')) AS a, len({_B}) AS n_b, md5(array_to_string({_B}, ' ')) AS b, len({_D}) AS n_d, len({_L}) AS n_literature,
  len(list_distinct(list_filter({_SPLIT("x")}, lambda w: length(w) >= 3))) AS n_e FROM t""")
def tokens(spark, sf):
    text = F.col("text")
    n = lambda c: F.size(c).cast("long")
    joined = lambda c: F.md5(F.array_join(c, " ").cast("binary"))
    a, b = tx.specialist_tokens(text), tx.bilingual_tokens(text)
    return table(spark, sf, "documents").select(
        "doc_id", n(a).alias("n_a"), joined(a).alias("a"), n(b).alias("n_b"), joined(b).alias("b"), n(tx.keywords(text)).alias("n_d"),
        n(tx.keywords(F.lower("text"), tx.STOP_LITERATURE, 4)).alias("n_literature"), n(tx.spaced_words(text)).alias("n_e"),
    )


# Fixed values of the filter query.
FILTER = {"lang": "en", "n_chars": {"$gte": 500, "$lt": 5000}, "source": {"$nin": ["src1", "src2"]}, "$or": [{"doc_id": {"$ne": 3}}, {"source": {"$in": ["src3"]}}]}


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500 AND n_chars < 5000 AND source NOT IN ('src1', 'src2') AND (doc_id <> 3 OR source IN ('src3'))")
def metadata_filter(spark, sf):
    return table(spark, sf, "documents").filter(s.matches(FILTER)).select("doc_id")


@query("""SELECT 'content' AS lookup, count(*) AS n FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT 'type', count(*) FROM customer WHERE contains(lower(c_mktsegment), 'build')
UNION ALL SELECT 'entity', count(*) FROM conversations WHERE list_contains(regexp_extract_all(text, '[A-Z][a-z]+'), 'The')""")
def knowledge_lookups(spark, sf):
    said = table(spark, sf, "conversations").withColumn("entities", F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)))
    found = {"content": s.by_content(table(spark, sf, "documents"), "text", "License"), "type": s.by_type(table(spark, sf, "customer"), "c_mktsegment", "BUILD"), "entity": s.by_entity(said, "entities", "The")}
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(k).alias("lookup"), "n") for k, rows in found.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""WITH k AS (SELECT DISTINCT p_name AS key FROM part), a AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS q FROM part UNION SELECT DISTINCT p_type FROM part),
h AS (SELECT q, key, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN lower(q) = lower(key) THEN 0 ELSE 1 END, key) AS r FROM a LEFT JOIN k ON contains(lower(key), lower(q)) OR contains(lower(q), lower(key)))
SELECT q, key FROM h WHERE r = 1""")
def fuzzy_topics(spark, sf):
    part = table(spark, sf, "part")
    asked = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("q")).union(part.select("p_type"))
    return s.fuzzy_get(asked, part.select(F.col("p_name").alias("key")))


_SURVEYS = ("II/335/galex_ais", "II/336/apass9", "I/355/gaiadr3", "II/328/allwise", "II/349/ps1", "X/unknown")
_BANDS = ("Johnson:B", "Johnson:I", "GALEX:FUV", "Gaia:G", "WISE:W1", "PS1:g")
_TABNAME = f"list_extract({_stop(_SURVEYS)}, CAST(p_partkey % 6 + 1 AS INT))"
_FILTER = f"list_extract({_stop(_BANDS)}, CAST(p_size % 6 + 1 AS INT))"


@query(f"""WITH r AS (SELECT p_partkey, {_TABNAME} AS tab, {_FILTER} AS band, p_size * 100e0 AS ghz, p_retailprice AS jy FROM part),
f AS (SELECT *, upper(band) AS b, upper(tab) AS t FROM r WHERE tab IN ({", ".join(f"'{t}'" for t in s.SED_TABLES)}) OR (tab = 'II/336/apass9' AND band IN ('Johnson:B', 'Johnson:V')))
SELECT p_partkey, CASE WHEN contains(b, 'XMM') OR contains(t, 'XMM') THEN 'XMM' WHEN contains(b, 'GALEX') OR contains(t, 'GALEX') THEN 'GALEX' WHEN contains(b, 'GAIA') OR contains(t, 'GAIA') OR contains(t, 'DR3') THEN 'GAIA'
  WHEN contains(t, '2MASS') THEN '2MASS' WHEN contains(t, 'SPITZER') THEN 'Spitzer' WHEN contains(t, 'WISE') THEN 'WISE' WHEN contains(t, 'PAN-STARRS') OR contains(t, 'PS1') THEN 'Pan-STARRS'
  WHEN contains(t, 'APASS') OR contains(b, 'JOHNSON') THEN 'APASS' ELSE 'default' END AS survey,
  round(2.998e9 / ghz, 4) AS wave, round(jy * ghz * 1e-14 * 1e6, 4) AS nu_f_nu_micro, round(jy * ghz * 1e-14 / (2.998e9 / ghz) * 1e9, 4) AS f_lambda_nano FROM f""")
def sed_points(spark, sf):
    from ..functions import astro

    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.col(k) % 6 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", pick(_SURVEYS, "p_partkey").alias("tab"), pick(_BANDS, "p_size").alias("band"), (F.col("p_size") * 100.0).alias("ghz"), F.col("p_retailprice").alias("jy"))
    rows = rows.filter(s.sed_listed(F.col("tab"), F.col("band")))
    wave, power = astro.wave_of_ghz(F.col("ghz")), astro.energy_flux(F.col("jy"), F.col("ghz"))
    return rows.select("p_partkey", s.survey_of(F.col("band"), F.col("tab")).alias("survey"), F.round(wave, 4).alias("wave"), F.round(power * 1e6, 4).alias("nu_f_nu_micro"), F.round(power / wave * 1e9, 4).alias("f_lambda_nano"))


@query("""WITH r AS (SELECT c_custkey, c_acctbal / 100 AS plx, c_nationkey * 0.5e0 AS over, c_acctbal / 500 AS mg, c_custkey % 80 / 10e0 - 2 AS colour FROM customer)
SELECT c_custkey, plx > 0 AND over > 3 AS target, plx > 0 AND over > 5 AS field, mg > -5 AND mg < 16 AND colour > -1 AND colour < 5 AS valid, colour > -1 AND colour < 4 AND plx > 0 AND plx < 100 AS background FROM r""")
def catalogue_gates(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("plx"), (F.col("c_nationkey") * 0.5).alias("over"), (F.col("c_acctbal") / 500).alias("mg"), (F.col("c_custkey") % 80 / 10.0 - 2).alias("colour"))
    plx, over, mg, colour = map(F.col, ("plx", "over", "mg", "colour"))
    return rows.select("c_custkey", s.good_parallax(plx, over).alias("target"), s.good_parallax(plx, over, 5.0).alias("field"), s.on_hr_diagram(mg, colour).alias("valid"), s.field_star(plx, colour).alias("background"))


@query("""SELECT doc_id, quality / 2e0 + 0.4 AS confidence FROM labels WHERE quality / 2e0 + 0.4 >= 0.6 AND toxic = 0""")
def augmented_filter(spark, sf):
    rows = table(spark, sf, "labels").withColumn("confidence", F.col("quality") / 2 + 0.4)
    return rows.filter(s.augmented_sample(F.col("confidence"), F.col("toxic") == 1)).select("doc_id", "confidence")


@query(r"""WITH r AS (SELECT conv_id, turn, least(length(text) / 500e0, 1e0) AS confidence, len(regexp_extract_all(text, '\d+')) AS n FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, concat_ws('+', CASE WHEN confidence < 0.7 THEN 'low confidence' END, CASE WHEN n = 0 THEN 'no evidence' END) AS why FROM r) SELECT * FROM w WHERE why <> ''""")
def uncertain_turns(spark, sf):
    rows = table(spark, sf, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.least(F.length("text") / 500.0, F.lit(1.0)).alias("confidence"), F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)).alias("evidence"))
    return s.uncertain_steps(rows, "confidence", "evidence").select("conv_id", "turn", "why")


@query("""WITH r AS (SELECT l_suppkey AS target, CASE l_returnflag WHEN 'A' THEN 'EVEREST' ELSE 'SPOC' END AS author, CASE l_linenumber WHEN 1 THEN 'TESS' WHEN 2 THEN 'K2 Campaign 4' WHEN 3 THEN 'Kepler Quarter 2' ELSE 'other' END AS mission, l_quantity AS sector FROM lineitem)
SELECT target, count(*) AS n, count(DISTINCT CASE WHEN contains(upper(mission), 'TESS') THEN sector END) AS sectors, coalesce(bool_or(contains(upper(mission), 'K2 CAMPAIGN')), false) AS has_k2, coalesce(bool_or(contains(upper(mission), 'KEPLER QUARTER')), false) AS has_kepler
FROM r WHERE author NOT IN ('EVEREST', 'K2VARCAT') GROUP BY target""")
def observation_report(spark, sf):
    n = F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("target"), F.when(F.col("l_returnflag") == "A", "EVEREST").otherwise("SPOC").alias("author"),
        F.when(n == 1, "TESS").when(n == 2, "K2 Campaign 4").when(n == 3, "Kepler Quarter 2").otherwise("other").alias("mission"), F.col("l_quantity").alias("sector"),
    )
    return s.observation_report(rows, "target", "author", "mission", "sector")


@query("""WITH r AS (SELECT c_custkey, c_mktsegment || CASE WHEN c_nationkey < 5 THEN '|LAMOST J1' WHEN c_nationkey < 9 THEN '|SDSS J2' ELSE '' END AS ids, c_acctbal / 100 AS b, c_nationkey * 2e0 AS v FROM customer),
m AS (SELECT *, CASE WHEN b > 0 AND b < 30 THEN b END AS mb, CASE WHEN v > 0 AND v < 30 THEN v END AS mv FROM r)
SELECT c_custkey, contains(ids, 'LAMOST') AS has_lamost, contains(ids, 'SDSS') AS has_sdss, mb AS "B", mv AS "V", round(mb - mv, 6) AS b_v FROM m""")
def object_records(spark, sf):
    tail = F.when(F.col("c_nationkey") < 5, "|LAMOST J1").when(F.col("c_nationkey") < 9, "|SDSS J2").otherwise("")
    rows = table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", tail).alias("ids"), (F.col("c_acctbal") / 100).alias("B"), (F.col("c_nationkey") * 2.0).alias("V"))
    return s.normalised_objects(rows, "ids", ("B", "V")).select("c_custkey", "has_lamost", "has_sdss", "B", "V", F.round("b_v", 6).alias("b_v"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_size % 3 = 1 AND p_retailprice >= 950 AND p_retailprice <= 1500")
def line_selection(spark, sf):
    lines = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("element"), (F.col("p_size") % 3).alias("ion"), F.col("p_retailprice").alias("wave"))
    return s.line_list(lines, "Brand#2", 1, 950.0, 1500.0).select("p_partkey")


@query("SELECT topic, topic IN (SELECT lang FROM documents) AS covered FROM (SELECT DISTINCT lang AS topic FROM documents UNION SELECT n_name FROM nation) WHERE topic IS NOT NULL")
def topic_coverage(spark, sf):
    present = table(spark, sf, "documents").select(F.col("lang").alias("topic")).filter("topic IS NOT NULL")
    return s.covered_topics(present.union(table(spark, sf, "nation").select("n_name")), present)


@query("SELECT o_custkey AS paper, list_sort(list(DISTINCT o_orderpriority)) AS topics, min(o_orderdate) AS published FROM orders GROUP BY o_custkey")
def paper_topics(spark, sf):
    found = table(spark, sf, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderpriority").alias("topic"), F.col("o_orderdate").alias("published"))
    return s.merged_topics(found, "paper", "topic")


_S = "count(*) AS n, count(CASE WHEN source <> '' THEN 1 END) AS with_source, count(text) FILTER (WHERE text <> '') AS with_text FROM documents"


@query(f"SELECT 'all' AS grouping, 'all' AS value, {_S} UNION ALL SELECT 'lang', lang, {_S} GROUP BY lang UNION ALL SELECT 'source', source, {_S} GROUP BY source")
def source_counts(spark, sf):
    return s.source_statistics(table(spark, sf, "documents"), "lang", "source", ("source", "text"))


@query("SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def typed_targets(spark, sf):
    types = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return s.with_types(table(spark, sf, "customer"), types, "c_nationkey").select("c_custkey", "type.n_name", "type.n_regionkey")


@query("""WITH p AS (SELECT user_id AS img, event_id % 3 AS channel, CAST(floor(value) AS BIGINT) % 256 AS v FROM events WHERE value >= 0), h AS (SELECT img, channel, floor(v / 8) AS slot, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT img, n / CAST(sum(n) OVER (PARTITION BY img, channel) AS DOUBLE) AS x FROM h), l AS (SELECT img, avg(v) AS m, stddev_pop(v) AS d FROM p GROUP BY img), t AS (SELECT img, sum(x * x) AS q FROM s GROUP BY img)
SELECT img, round(m / sqrt(q + m * m + d * d), 6) AS mean, round(d / sqrt(q + m * m + d * d), 6) AS std FROM l JOIN t USING (img)""")
def pixel_features(spark, sf):
    pixels = table(spark, sf, "events").filter("value >= 0").select(F.col("user_id").alias("img"), (F.col("event_id") % 3).alias("channel"), (F.floor("value") % 256).alias("v"))
    return s.image_features(pixels).select("img", F.round(F.get("features", F.lit(96)), 6).alias("mean"), F.round(F.get("features", F.lit(97)), 6).alias("std"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'none' AS level FROM events""")
def event_fields(spark, sf):
    """Nested values by path, with a default for what is absent."""
    rows = table(spark, sf, "events").withColumn("v", nx.parsed(F.col("props")))
    return rows.select("event_id", *nx.flattened(F.col("v"), {"k": ("$.k", "int", None), "level": ("$.level", "string", "none")}))


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k % 3 = 0 THEN k * 1.5e0 WHEN k % 2 = 0 THEN k * 2e0 END AS period, CASE WHEN k % 3 = 0 THEN 'gaia' WHEN k % 2 = 0 THEN 'ztf' END AS source FROM e""")
def survey_periods(spark, sf):
    """A model's answer with a fenced block: the period of the first survey that has one."""
    k = nx.at(nx.parsed(F.col("props")), "$.k", "int")
    period = lambda n, x: F.struct(F.when(F.col("k") % n == 0, F.col("k") * x).alias("period"))
    rows = table(spark, sf, "events").select("event_id", k.alias("k"))
    record = F.to_json(F.struct(F.struct(period(3, 1.5).alias("gaia"), period(2, 2.0).alias("ztf")).alias("periods")))
    rows = rows.select("event_id", nx.parsed(F.concat(F.lit("Found:\n```json\n"), record, F.lit("\n```\nDone."))).alias("v"))
    return rows.select("event_id", nx.first_present(F.col("v"), ("gaia", "ztf"), "$.periods", "period").alias("p")).select("event_id", F.col("p.value").alias("period"), F.col("p.source").alias("source"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, concat_ws(',', CASE WHEN l_discount <> 0 THEN 'd' END, CASE WHEN l_quantity IS NOT NULL THEN 'q' END, CASE WHEN l_tax <> 0 THEN 'x' END) AS bands, round(l_quantity + l_discount + l_tax, 6) AS total FROM lineitem""")
def band_maps(spark, sf):
    """Wide photometry as a map of the bands that have a value, through its JSON and back."""
    bands = nx.band_map({"q": F.col("l_quantity"), "d": F.nullif("l_discount", F.lit(0.0)), "x": F.nullif("l_tax", F.lit(0.0))})
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), nx.restored(F.to_json(bands), "map<string,double>").alias("m"))
    total = F.round(F.aggregate(F.map_values("m"), F.lit(0.0), lambda a, v: a + v), 6)
    return rows.select("id", "line", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("bands"), total.alias("total"))
