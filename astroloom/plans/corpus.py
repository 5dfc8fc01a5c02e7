"""Corpus preparation and evaluation queries over documents, conversations and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import corpus as c
from ..operators import evaluation as e
from ..operators import patterns
from ..operators import selection as s
from ..sources import readers
from ..sources.shared import spread
from .base import registrar, table

QUERIES, ORACLE_SQL, query = registrar()

# Topic terms that occur in the driver's documents.
TOPICS = {"alpha": ["the", "and"], "beta": ["que", "los"], "gamma": ["und", "der"], "delta": ["les", "une"]}
TEMPLATES = ("What is {topic}?", "Explain {topic}.", "How does {topic} work?")


def _docs(spark, sf):
    return spread(table(spark, sf, "documents"))


_HASH = r"md5(trim(regexp_replace(lower(coalesce(text, '')), '[ \t\n\r\x0b\f]+', ' ', 'g')))"


@query(f"WITH h AS (SELECT doc_id, {_HASH} AS hash FROM documents) SELECT doc_id, hash, min(doc_id) OVER (PARTITION BY hash) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY hash) AS copy FROM h")
def exact_dedup(spark, sf):
    return c.exact_duplicates(_docs(spark, sf))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, md5(left(text, 100)) ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""")
def keep_best_dedup(spark, sf):
    rows = _docs(spark, sf).select("doc_id", "source", "n_chars", F.md5(F.left("text", F.lit(100)).cast("binary")).alias("h"))
    return c.keep_best(rows, ["source", "h"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source")


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS part FROM documents)
SELECT doc_id, CAST(part AS INT) AS part, md5(trim(content)) AS content FROM p WHERE length(trim(content)) > 50""")
def paragraph_docs(spark, sf):
    return c.paragraphs(_docs(spark, sf)).withColumn("content", F.md5(F.col("content").cast("binary")))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 1200)) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i // 1200 AS INT) AS chunk, md5(substr(text, i + 1, 1500)) AS content FROM s""")
def chunks(spark, sf):
    return c.chunked(_docs(spark, sf)).withColumn("content", F.md5(F.col("content").cast("binary")))


@query()
def sentence_counts(spark, sf):
    """Look-behind is beyond the other engine's patterns."""
    return _docs(spark, sf).select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n"))


_LANG = "length(regexp_replace(text, '[^{}]', '', 'g')) / greatest(length(text), 1)"


@query(f"""WITH s AS (SELECT doc_id, {_LANG.format('一-鿿')} AS zh, {_LANG.format('a-zA-Z')} AS en FROM documents)
SELECT doc_id, CASE WHEN zh > 0.3 AND en > 0.3 THEN 'mixed' WHEN zh > 0.3 THEN 'zh' WHEN en > 0.3 THEN 'en' ELSE 'unknown' END AS language FROM s""")
def lang_detect(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.language(F.col("text")).alias("language"))


def _occ(words):
    return " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words)


TOPIC_SQL = "low AS (SELECT doc_id, lower(text) AS low, text FROM documents WHERE text IS NOT NULL), ts AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS topic, least(round(({_occ(w)}) / {10.0 * len(w)}e0, 6), 1e0) AS score FROM low" for t, w in TOPICS.items()
) + "), top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic) AS INT) AS rank FROM ts WHERE score > 0) WHERE rank <= 3)"


@query(f"WITH {TOPIC_SQL} SELECT * FROM top")
def topic_detect(spark, sf):
    return c.topics(_docs(spark, sf), TOPICS, 3)


@query(f"""WITH {TOPIC_SQL} SELECT source, topic, count(*) AS n, round(sum(score), 4) AS total FROM top JOIN documents USING (doc_id) GROUP BY ALL""")
def topic_totals(spark, sf):
    docs = _docs(spark, sf)
    return c.topics(docs, TOPICS, 3).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "topic").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


_PICK = "CASE CAST('0x' || substr(md5(doc_id || '|' || topic), 1, 6) AS BIGINT) % 3 " + " ".join(f"WHEN {k} THEN replace('{t}', '{{topic}}', topic)" for k, t in enumerate(TEMPLATES)) + " END"


@query(rf"""WITH {TOPIC_SQL} SELECT doc_id, topic, {_PICK} AS question, md5(trim(array_to_string(list_slice(regexp_extract_all(text, '[^.!?]+[.!?]'), 1, 2), ''))) AS answer, round(score * 0.8e0, 4) AS confidence
FROM top JOIN documents USING (doc_id)""")
def rule_questions(spark, sf):
    docs = _docs(spark, sf)
    rows = c.rule_questions(c.topics(docs, TOPICS, 3).join(docs.select("doc_id", "text"), "doc_id"), TEMPLATES)
    return rows.withColumn("answer", F.md5(F.col("answer").cast("binary")))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{3,}'))) AS n, CAST(length(regexp_extract(text, '([0-9]{3,})', 1)) AS INT) AS first_number FROM documents WHERE text IS NOT NULL""")
def entities(spark, sf):
    names = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{3,}"), F.lit(0)))).cast("long")
    return _docs(spark, sf).filter("text IS NOT NULL").select("doc_id", names.alias("n"), F.length(F.regexp_extract("text", "([0-9]{3,})", 1)).alias("first_number"))


_CHAT = "string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text)"


@query(f"SELECT conv_id, md5({_CHAT} || '<|im_start|>assistant' || chr(10)) AS prompt FROM conversations GROUP BY conv_id")
def chat_render(spark, sf):
    return c.rendered(c.conversations(table(spark, sf, "conversations")), generate=True).withColumn("prompt", F.md5(F.col("prompt").cast("binary")))


@query("""SELECT conv_id, md5(instruction) AS instruction, md5(input) AS input, md5(output) AS output FROM (SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS instruction,
  coalesce(arg_max(text, turn) FILTER (role = 'system'), '') AS input, arg_max(text, turn) FILTER (role = 'assistant') AS output FROM conversations GROUP BY conv_id) WHERE instruction IS NOT NULL AND output IS NOT NULL""")
def to_alpaca(spark, sf):
    return c.alpaca(table(spark, sf, "conversations")).withColumns({k: F.md5(F.col(k).cast("binary")) for k in ("instruction", "input", "output")})


@query("SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_convs, round(CAST(count(*) AS DOUBLE) / count(DISTINCT conv_id), 4) AS mean_turns FROM conversations GROUP BY role")
def turn_stats(spark, sf):
    return c.turn_statistics(table(spark, sf, "conversations"))


@query("SELECT d.doc_id, lang, quality FROM documents d JOIN labels l USING (doc_id) WHERE quality >= 1 AND toxic = 0 AND n_chars >= 200")
def quality_filter(spark, sf):
    return s.quality(_docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")).select("doc_id", "lang", "quality")


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) / 4294967296e0 < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents")
def split_stable(spark, sf):
    return c.stable_split(_docs(spark, sf).select("doc_id"), "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 3")
def sample_per_type(spark, sf):
    return c.sample_per(_docs(spark, sf).select("doc_id", "source"), "source", "doc_id", 3)


@query("SELECT doc_id, CAST(unnest(range(1, CASE WHEN toxic = 1 THEN 11 ELSE 2 END)) AS INT) AS repeat FROM labels")
def oversample(spark, sf):
    return c.oversample(table(spark, sf, "labels").select("doc_id", "toxic"), F.when(F.col("toxic") == 1, 10).otherwise(1)).select("doc_id", "repeat")


@query("SELECT doc_id, 'qa_' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 7, '0') AS name FROM documents")
def sequential_names(spark, sf):
    return c.numbered(_docs(spark, sf).select("doc_id"), "doc_id", "qa_", 7)


@query("SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS grouping, coalesce(lang, source, 'all') AS value, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def dataset_counts(spark, sf):
    lang, source = F.col("lang"), F.col("source")
    counted = _docs(spark, sf).groupingSets([[lang], [source], []], lang, source).agg(F.grouping("lang").alias("l"), F.grouping("source").alias("s"), F.count("*").alias("n"))
    return counted.select(F.when(F.col("l") == 0, "lang").when(F.col("s") == 0, "source").otherwise("all").alias("grouping"), F.coalesce("lang", "source", F.lit("all")).alias("value"), "n")


@query("""SELECT o_custkey AS key, coalesce(max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END), max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END)) AS priority,
  coalesce(max(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END), max(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END)) AS price FROM orders GROUP BY o_custkey""")
def upsert_merge(spark, sf):
    o = table(spark, sf, "orders")
    half = lambda k: o.filter(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("priority"), F.max("o_totalprice").alias("price"))
    return c.upsert(half(0), half(1), "key")


def _facts(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("value"), F.array_sort(F.collect_set("l_suppkey")).alias("entities"), F.array_sort(F.collect_set("l_returnflag")).alias("terms")).select(
        F.col("l_orderkey").alias("id"), F.lit("price").alias("kind"), "value", "entities", "terms"
    )


@query("""WITH f AS (SELECT l_orderkey AS id, max(l_extendedprice) AS value, list_distinct(list(l_suppkey)) AS e, list_distinct(list(l_returnflag)) AS t FROM lineitem GROUP BY l_orderkey),
x AS (SELECT id, unnest(e) AS entity FROM f), p AS (SELECT DISTINCT a.id AS n_id, b.id AS o_id FROM x a JOIN x b USING (entity) WHERE a.id % 2 = 1 AND b.id % 2 = 0),
s AS (SELECT n_id, o_id, 'price' AS kind, a.value AS n_value, b.value AS o_value, round(0.6e0 * len(list_intersect(a.e, b.e)) / greatest(len(a.e), len(b.e)) + 0.4e0 * len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS likeness
FROM p JOIN f a ON a.id = n_id JOIN f b ON b.id = o_id) SELECT * FROM s WHERE likeness > 0.85 AND abs(n_value - o_value) > 0.2 * greatest(n_value, o_value, 1)""")
def conflicts(spark, sf):
    facts = _facts(spark, sf)
    return c.conflicts(facts.filter("id % 2 = 1"), facts.filter("id % 2 = 0"))


_RES = "r AS (SELECT d.doc_id, lang, source, (quality = 1) AS correct, least(CAST(n_chars AS DOUBLE) / 5000, 1) AS confidence FROM documents d JOIN labels USING (doc_id))"


def _results(spark, sf):
    """Predictions stand in as quality labels, confidence as a text's length."""
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "source", (F.col("quality") == 1).alias("correct"), F.least(F.col("n_chars") / 5000, F.lit(1.0)).alias("confidence"))


@query(f"""WITH {_RES} SELECT 'all' AS grouping, 'all' AS value, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM r
UNION ALL SELECT 'lang', lang, count(*), round(avg(CAST(correct AS DOUBLE)), 6) FROM r GROUP BY lang UNION ALL SELECT 'source', source, count(*), round(avg(CAST(correct AS DOUBLE)), 6) FROM r GROUP BY source""")
def acc_by_group(spark, sf):
    return e.accuracy(_results(spark, sf), ("lang", "source"))


@query(f"""WITH {_RES}, b AS (SELECT CASE WHEN confidence > 0 THEN least(floor(confidence * 10), 9) END AS bin, count(*) AS n, abs(avg(CAST(correct AS DOUBLE)) - avg(confidence)) AS gap FROM r GROUP BY bin)
SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(CASE WHEN bin IS NOT NULL THEN n * gap END) / sum(n), 6) AS ece FROM b""")
def ece(spark, sf):
    return e.calibration_error(_results(spark, sf))


@query("""WITH m AS (SELECT source AS model, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source), o AS (SELECT *, round((quality + toxic) / 2 + 1e-9, 4) AS overall FROM m)
SELECT *, CAST(row_number() OVER (ORDER BY overall DESC, model) AS INT) AS rank FROM o""")
def model_pivot(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(F.col("source").alias("model"), F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double"))).alias("metric", "score"))
    return e.model_table(rows, ("quality", "toxic"))


_WORDS = ("the", "que", "und", "les", "and")


@query(f"""WITH k AS (SELECT doc_id, ({" + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in _WORDS)}) / 5e0 AS ratio FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(ratio, 4) AS ratio, CASE WHEN ratio >= 0.6 THEN 'correct' WHEN ratio >= 0.3 THEN 'partial' ELSE 'incorrect' END AS verdict FROM k""")
def verdicts(spark, sf):
    rows = _docs(spark, sf).filter("text IS NOT NULL").select("doc_id", e.keyword_ratio(F.col("text"), _WORDS).alias("ratio"))
    return rows.select("doc_id", F.round("ratio", 4).alias("ratio"), e.verdict(F.col("ratio"), F.lit(0.0)).alias("verdict"))


_RULES = (("(?i)token", "[0-9a-f]{20,}"), ("(?i)license", "(?i)apache"))


@query("SELECT doc_id, coalesce((regexp_matches(text, '(?i)token') AND regexp_matches(text, '[0-9a-f]{20,}')) OR (regexp_matches(text, '(?i)license') AND regexp_matches(text, '(?i)apache')), false) AS broken FROM documents")
def halluc_rules(spark, sf):
    return _docs(spark, sf).select("doc_id", e.breaks_rule(F.col("text"), _RULES).alias("broken"))


_MCQ = r"coalesce(nullif(regexp_extract(text, '(?i)answer(?: is)?:?\s*\(?([A-D])\b', 1), ''), nullif(regexp_extract(text, '\(([A-D])\)', 1), ''), nullif(regexp_extract(text, '\b([A-D])[.)]', 1), ''), nullif(regexp_extract(text, '^\s*([A-D])', 1), ''))"


@query(f"SELECT upper({_MCQ}) AS choice, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1")
def mcq_parse(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'assistant'").groupBy(tx.choice_answer(F.col("text")).alias("choice")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT source, round(avg(quality) * 100, 4) AS score FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT *, CASE WHEN score >= 70 THEN 'PASS' WHEN score >= 50 THEN 'WARN' ELSE 'FAIL' END AS band FROM s")
def checklist(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("passed"))
    return e.checklist(rows, "source")


@query("SELECT b.item_id, count(*) AS n, min(d.doc_id) AS sample FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def containment(spark, sf):
    """Corpus texts that hold a stated query set's items whole."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("pattern"))
    found = patterns.occurring(_docs(spark, sf), "doc_id", "text", items)
    return items.join(found, "pattern").groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("sample"))


@query(f"""WITH {_RES}, h AS (SELECT *, NOT correct AS hallucinated, nullif(confidence, 1) AS latency FROM r), a AS (SELECT 'all' AS grouping, 'all' AS value, * FROM h UNION ALL SELECT 'lang', lang, * FROM h)
SELECT grouping, value, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(CAST(hallucinated AS DOUBLE)), 6) AS hallucination_rate, round(avg(latency), 6) AS latency FROM a GROUP BY ALL""")
def result_summary(spark, sf):
    """With wrong answers standing for hallucinated ones, and confidence below 1 for latency."""
    rows = _results(spark, sf).withColumns({"hallucinated": ~F.col("correct"), "latency": F.nullif("confidence", F.lit(1.0))})
    return e.summary(rows, ("lang",))


@query("""WITH n AS (SELECT count(*) AS n FROM documents), a AS (SELECT 'generator' AS section, lang AS value, count(*) AS c FROM documents GROUP BY lang
UNION ALL SELECT 'source', source, c FROM (SELECT source, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents GROUP BY source) WHERE i <= 10
UNION ALL SELECT 'category', lang, count(*) FROM documents GROUP BY ROLLUP (lang)) SELECT section, value, c AS n, round(CAST(c AS DOUBLE) / n.n, 6) AS share FROM a, n""")
def base_report(spark, sf):
    return s.base_report(_docs(spark, sf), "lang", "source", "lang")


@query("""WITH p AS (SELECT conv_id AS doc, turn AS page_no, text, coalesce(length(text), 0) AS n_chars FROM conversations) SELECT doc, page_no, n_chars FROM p WHERE n_chars > 100 AND doc IN (SELECT doc FROM p GROUP BY doc HAVING sum(n_chars) >= 200)""")
def page_corpus(spark, sf):
    """Turns stand for a document's pages."""
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text")
    return readers.page_corpus(pages).select("doc", "page_no", "n_chars")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1996-06-30'")
def submitted_range(spark, sf):
    return s.submitted_between(table(spark, sf, "orders"), "o_orderdate", "1994-01-01", "1996-06-30").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z一-鿿]{2,}$')) AS w FROM documents".join(("SELECT doc_id, CAST(len(w) AS INT) AS n, md5(array_to_string(w, ' ')) AS words FROM (", ")")))
def mixed_words(spark, sf):
    rows = _docs(spark, sf).select("doc_id", tx.mixed_words(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


_ABSTRACTS = """a AS (SELECT o_orderkey AS id, o_orderpriority AS title, 'A ' || CASE o_orderkey % 3 WHEN 0 THEN 'White Dwarf and a neutron star near another white dwarf' WHEN 1 THEN 'binary' ELSE 'cataclysmic variable' END
  || ' with a period of ' || o_custkey || ' hr, a mass of 0.' || (o_orderkey % 9) || ' Msun at a distance of ' || o_custkey || ' kpc. Confidence: ' || (o_custkey % 90) || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '.5' END AS abstract FROM orders)"""


def _abstracts(spark, sf):
    """Statements made of orders."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    kind = F.when(key % 3 == 0, "White Dwarf and a neutron star near another white dwarf").when(key % 3 == 1, "binary").otherwise("cataclysmic variable")
    said = F.concat(F.lit("A "), kind, F.lit(" with a period of "), cust, F.lit(" hr, a mass of 0."), (key % 9).cast("string"), F.lit(" Msun at a distance of "), cust, F.lit(" kpc. Confidence: "), (F.col("o_custkey") % 90).cast("string"), F.when(key % 4 == 0, "").otherwise(".5"))
    return table(spark, sf, "orders").select(key.alias("id"), F.col("o_orderpriority").alias("title"), said.alias("abstract"))


@query(rf"""WITH {_ABSTRACTS}, k AS (SELECT id AS source, 'parameter' AS knowledge_type, 'Object has a period of ' || regexp_extract(abstract, 'period of (\d+)', 1) || ' hr' AS content FROM a
UNION ALL SELECT id, 'parameter', 'Object has a mass of ' || regexp_extract(abstract, 'mass of ([0-9.]+)', 1) || ' Msun' FROM a UNION ALL SELECT id, 'parameter', 'Object has a distance of ' || regexp_extract(abstract, 'distance of (\d+)', 1) || ' kpc' FROM a
UNION ALL SELECT id, 'fact', 'Object is classified as ' || t FROM a, (VALUES ('white dwarf'), ('neutron star'), ('cataclysmic variable')) AS v(t) WHERE contains(lower(abstract), t))
SELECT source, knowledge_type, content, CASE knowledge_type WHEN 'fact' THEN 0.8e0 ELSE 0.7e0 END AS confidence FROM k""")
def typed_knowledge(spark, sf):
    return c.typed_knowledge(_abstracts(spark, sf)).select("source", "knowledge_type", "content", "confidence")


@query(rf"""WITH {_ABSTRACTS}, v AS (SELECT id, CAST(regexp_extract(abstract, 'Confidence: ([0-9.]+)', 1) AS DOUBLE) AS v FROM a) SELECT id, CASE WHEN v > 1 THEN v / 100 ELSE v END AS confidence FROM v""")
def stated_confidence(spark, sf):
    return _abstracts(spark, sf).select("id", tx.stated_confidence(F.col("abstract")).alias("confidence"))


@query()
def object_names(spark, sf):
    """Edges of words in other scripts are beyond the other engine's patterns; tested against plain Python."""
    return _docs(spark, sf).select("doc_id", tx.object_names(F.col("text")).alias("names"))


_LEARNED = """k AS (SELECT lower(text) AS low, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')[1:3], ' ') AS key, conv_id FROM conversations WHERE role = 'user' AND text IS NOT NULL),
l AS (SELECT key, max(conv_id) AS top, min(conv_id) AS first FROM k WHERE conv_id % 4 = 0 AND key <> '' GROUP BY key)"""


@query(f"""WITH {_LEARNED}, q AS (SELECT conv_id, low FROM k), m AS (SELECT conv_id, arg_min(top, (first, key)) AS top FROM q JOIN l ON contains(low, key) GROUP BY conv_id)
SELECT conv_id, round(CASE WHEN top IS NOT NULL THEN CAST(top % 10 AS DOUBLE) / 10 WHEN contains(low, 'cataclysmic') OR contains(low, 'cv') THEN 0.25 WHEN contains(low, 'white dwarf') THEN 0.25 WHEN contains(low, 'binary') THEN 0.6 ELSE 0.25 END, 4) AS binary
FROM q LEFT JOIN m USING (conv_id)""")
def predicted_topics(spark, sf):
    """First questions of conversations; a fourth of them, with labels by their number, have been learned."""
    asked = table(spark, sf, "conversations").filter("role = 'user' AND text IS NOT NULL").select("conv_id", "text")
    label = F.create_map(F.lit("binary"), (F.col("conv_id") % 10) / 10.0)
    learned = c.learned_priors(asked.filter("conv_id % 4 = 0").withColumn("labels", label), "text", "labels", "conv_id")
    return c.predicted_topics(asked, "conv_id", "text", learned).select("conv_id", F.round(F.col("labels")["binary"], 4).alias("binary"))


# Stand-ins for a topic's questions and answers.
_ASK = {t: tuple(f"{w} {t}?" for w in ("What is", "Why is", "How is")) for t in ("alpha", "beta", "gamma")}
_SAY = {"alpha": ("It is {content}: {observation}; {conclusion}", "See {content}. {conclusion}")}


@query(f"""WITH {TOPIC_SQL}, q(topic, question) AS (VALUES {", ".join(f"('{t}', '{x}')" for t, qs in _ASK.items() for x in qs)}),
f(topic, form) AS (VALUES {", ".join(f"('alpha', '{x}')" for x in _SAY["alpha"])}), g(form) AS (VALUES {", ".join(f"('{x}')" for x in c.GENERAL_ANSWERS)}),
x AS (SELECT doc_id, topic, score, rank, left(text, 500) AS context FROM top JOIN documents USING (doc_id)),
p AS (SELECT x.*, question, row_number() OVER (PARTITION BY doc_id, topic ORDER BY md5(doc_id || '|' || topic || '|' || question)) AS i FROM x JOIN q USING (topic)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) AS n FROM p WHERE i <= 2),
w AS (SELECT c.*, (SELECT arg_min(form, md5(c.doc_id || '|' || c.topic || '|' || form)) FROM (SELECT form FROM f WHERE f.topic = c.topic UNION ALL SELECT form FROM g WHERE c.topic <> 'alpha')) AS form, string_split(context, '.') AS parts FROM c WHERE n <= 4)
SELECT doc_id, topic, question, md5(left(replace(replace(replace(form, '{{content}}', left(parts[1], 150)), '{{observation}}', coalesce(left(parts[2], 100), '{c.NO_OBSERVATION}')), '{{conclusion}}', CASE WHEN score < 0.5 THEN '{c.UNSURE_CONCLUSION}' ELSE '{c.SURE_CONCLUSION}' END), 400)) AS answer,
  round(score * 0.8e0, 6) AS confidence FROM w
UNION ALL SELECT doc_id, 'general', question, md5(replace('{c.GENERAL_ANSWER}', '{{context}}', left(text, 300))), 0.6e0 FROM documents, (VALUES {", ".join(f"('{x}')" for x in c.GENERAL_QUESTIONS[:2])}) AS u(question) WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM top)""")
def topic_questions(spark, sf):
    """Whose context is the text's start, since sentences are beyond the other engine's patterns."""
    docs = _docs(spark, sf)
    sections = c.topics(docs, TOPICS, 3)
    asked = c.topic_questions(sections.join(docs.select("doc_id", F.left("text", F.lit(500)).alias("context")), "doc_id"), _ASK, _SAY)
    rows = asked.unionByName(c.general_questions(docs, sections))
    return rows.select("doc_id", "topic", "question", F.md5(F.col("answer").cast("binary")).alias("answer"), "confidence")


@query("""WITH m AS (SELECT source AS model, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source), o AS (SELECT model, round((quality + toxic) / 2 + 1e-9, 4) AS overall FROM m)
SELECT *, CASE WHEN overall > 0.7 THEN 'gold' WHEN overall > 0.5 THEN 'silver' ELSE 'bronze' END AS medal FROM o""")
def model_medals(spark, sf):
    return e.with_medals(model_pivot(spark, sf)).select("model", "overall", "medal")
