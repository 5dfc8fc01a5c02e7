"""Retrieval queries: the benchmark items asked of the documents, and vectors of vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import fields, nearest, pruned
from ..operators import retrieval as r
from ..sources.shared import spread, stored
from .base import registrar, table

QUERIES, ORACLE_SQL, query = registrar()

INDEX = r"""tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\p{L}{2,}') AS terms FROM documents),
post AS (SELECT term, doc_id, length, count(*) AS tf FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM tok) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
asked AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}{2,}')) AS term FROM benchmark)"""
TOP = "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INT) AS rank FROM {0}) WHERE rank <= {1}"


def _index(spark, sf, only=None):
    """The index, written once however often a query reads it, and the number of documents."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = docs.count()
    return stored(r.postings(spread(docs), only, n)), n


def _search(spark, sf, method="idf", k=5, least=1):
    """The benchmark items' keyword search over an index of their terms."""
    asked = r.query_terms(_asked(spark, sf))
    index, n = _index(spark, sf, asked)
    return r.keyword_search(index, n, asked, method, k, least)


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def _keyword(weight: str) -> str:
    return f"""h AS (SELECT qid, doc_id, round(sum({weight}), 6) AS score, count(*) AS matched FROM asked JOIN post USING (term) JOIN df USING (term), n GROUP BY qid, doc_id)"""


IDF = "ln(CAST(n AS DOUBLE) / (df + 1)) + 1"
TFIDF = "CAST(tf AS DOUBLE) / length * (ln((n + 1.0) / (df + 1)) + 1)"


@query(f"WITH {INDEX}, {_keyword(IDF)} {TOP.format('h', 5)}")
def kw_topk(spark, sf):
    return _search(spark, sf)


@query(f"WITH {INDEX}, {_keyword(TFIDF)} {TOP.format('h', 5)}")
def tfidf_topk(spark, sf):
    return _search(spark, sf, "tfidf")


@query(f"WITH {INDEX}, {_keyword('1.0e0')} {TOP.format('(SELECT * FROM h WHERE matched >= 2)', 5)}")
def match_count_topk(spark, sf):
    return _search(spark, sf, "count", least=2)


def _pruned(spark, sf, method="idf", k=5, least=1):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    asked = r.query_terms(_asked(spark, sf))
    return pruned.keyword_search(pruned.ImpactIndex.of(spread(docs), docs.count(), asked), asked, method, k, least)


@query(f"WITH {INDEX}, {_keyword(IDF)} {TOP.format('h', 5)}")
def kw_topk_pruned(spark, sf):
    return _pruned(spark, sf)


@query(f"WITH {INDEX}, {_keyword(TFIDF)} {TOP.format('h', 5)}")
def tfidf_topk_pruned(spark, sf):
    return _pruned(spark, sf, "tfidf")


@query(f"WITH {INDEX}, {_keyword('1.0e0')} {TOP.format('(SELECT * FROM h WHERE matched >= 2)', 5)}")
def match_count_pruned(spark, sf):
    return _pruned(spark, sf, "count", least=2)


@query(f"WITH {INDEX} SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY term")
def corpus_stats(spark, sf):
    return r.term_statistics(_index(spark, sf)[0])


_BYTES = ", ".join(f"CAST(CAST('0x' || substr(md5(term), {2 * i + 1}, 2) AS INT) AS DOUBLE)" for i in range(16))
EMBED = f"""code AS (SELECT DISTINCT term, [{_BYTES}] AS b FROM post),
parts AS (SELECT doc_id, i, sum(tf * b[i]) AS x FROM post JOIN code USING (term), (SELECT unnest(range(1, 17)) AS i) GROUP BY ALL),
emb AS (SELECT doc_id, list(x ORDER BY i) AS e FROM parts GROUP BY doc_id)"""


@query(f"WITH {INDEX}, {EMBED} SELECT doc_id, round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS first, round(e[16] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS last FROM emb")
def hash_embed(spark, sf):
    return r.hash_embedding(spread(table(spark, sf, "documents").select("doc_id", "text"))).select("doc_id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[15], 6).alias("last"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
p AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, round(list_dot_product(q.e, v.e) / sqrt(list_dot_product(q.e, q.e) * list_dot_product(v.e, v.e)), 6) AS score FROM v q, v WHERE q.vec_id % 20 = 0)
""" + TOP.format("(SELECT * FROM p WHERE score >= 0.1)", 5))
def vec_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return r.vector_search(vectors, vectors.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("q")))


ITEMS = EMBED.replace("post", "bpost").replace("code", "bcode").replace("parts", "bparts").replace("emb AS", "bemb AS").replace("doc_id", "qid")
BOTH = rf"""{INDEX}, {EMBED}, bpost AS (SELECT term, qid, count(*) AS tf FROM (SELECT item_id AS qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}{{2,}}')) AS term FROM benchmark) GROUP BY ALL), {ITEMS},
vp AS (SELECT qid, doc_id, round(list_dot_product(bemb.e, emb.e) / sqrt(list_dot_product(bemb.e, bemb.e) * list_dot_product(emb.e, emb.e)), 6) AS score FROM bemb, emb),
vh AS ({TOP.format("(SELECT * FROM vp WHERE score >= 0.1)", 10)}), {_keyword(IDF)}, kh AS ({TOP.format("h", 10)})"""
WEIGHTED = """f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id,
  round((coalesce(a.s, 0) + coalesce(b.s, 0)) * CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN 1.1e0 ELSE 1.0e0 END, 4) AS score,
  concat_ws('+', CASE WHEN a.s IS NOT NULL THEN 'vector' END, CASE WHEN b.s IS NOT NULL THEN 'keyword' END) AS sources
FROM (SELECT qid, doc_id, 0.6e0 * score / max(score) OVER (PARTITION BY qid) AS s FROM vh) a FULL JOIN (SELECT qid, doc_id, 0.4e0 * score / max(score) OVER (PARTITION BY qid) AS s FROM kh) b ON a.qid = b.qid AND a.doc_id = b.doc_id)"""
RRF = """f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id, round(coalesce(1e0 / (60 + a.rank), 0) + coalesce(1e0 / (60 + b.rank), 0), 4) AS score,
  concat_ws('+', CASE WHEN a.rank IS NOT NULL THEN 'vector' END, CASE WHEN b.rank IS NOT NULL THEN 'keyword' END) AS sources FROM vh a FULL JOIN kh b ON a.qid = b.qid AND a.doc_id = b.doc_id)"""


def _channels(spark, sf):
    index, n = _index(spark, sf)
    asked = r.hash_embedding(_asked(spark, sf).withColumnRenamed("qid", "doc_id")).select(F.col("doc_id").alias("qid"), F.col("embedding").alias("q"))
    return r.vector_search(r.embedded(index), asked, 10), r.keyword_search(index, n, r.query_terms(_asked(spark, sf)), k=10)


@query(f"WITH {BOTH}, {WEIGHTED} {TOP.format('f', 5)}")
def hybrid_fusion(spark, sf):
    return r.fuse(*_channels(spark, sf))


@query(f"WITH {BOTH}, {RRF} {TOP.format('f', 5)}")
def rrf_fusion(spark, sf):
    return r.fuse(*_channels(spark, sf), method="rrf")


@query(f"""WITH {INDEX}, {_keyword(IDF)}, t AS ({TOP.format('h', 3)}) SELECT qid, string_agg(substr(text, 1, 200), chr(10) || chr(10) ORDER BY rank) AS context,
  string_agg('[' || rank || '] ' || doc_id, '; ' ORDER BY rank) AS citations FROM t JOIN documents USING (doc_id) GROUP BY qid""")
def citations(spark, sf):
    return r.context(_search(spark, sf, k=3), table(spark, sf, "documents"))


@query(f"WITH {INDEX}, {_keyword(TFIDF)}, t AS ({TOP.format('h', 5)}), c AS (SELECT qid, round(greatest(avg(score) * (1 - 0.2e0), 0), 4) AS confidence FROM t GROUP BY qid) SELECT *, confidence < 0.5 AS review FROM c")
def answer_confidence(spark, sf):
    return r.answer_confidence(_search(spark, sf, "tfidf"), 0.2)


_NUM = r"list_slice(regexp_extract_all(answer, '\d+(?:\.\d+)?'), 1, 5)"
_HEDGED = " + ".join(f"CASE WHEN contains(lower(answer), '{h}') THEN 0.2e0 ELSE 0e0 END" for h in r.HEDGES)


@query(rf"""WITH c AS (SELECT u.conv_id, nullif(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS answer, nullif(string_agg(text, chr(10) ORDER BY turn) FILTER (WHERE role <> 'assistant'), '') AS evidence FROM conversations u GROUP BY conv_id),
s AS (SELECT conv_id, round(least({_HEDGED} + least(0.3e0 * len(list_filter({_NUM}, lambda x: NOT contains(evidence, x))), 0.5e0), 1e0), 4) AS score FROM c WHERE answer IS NOT NULL AND evidence IS NOT NULL)
SELECT conv_id, score, score > 0.3 AS flagged FROM s""")
def grounding_check(spark, sf):
    """All of a conversation's assistant turns against all of its other turns, in order."""
    turns = lambda test: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test & F.col("text").isNotNull(), F.struct("turn", "text")))), lambda x: x["text"]), "\n"), F.lit(""))
    mine = F.col("role") == "assistant"
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(turns(mine).alias("answer"), turns(~mine).alias("evidence")).filter("answer IS NOT NULL AND evidence IS NOT NULL")
    score, flagged = r.grounding(F.col("answer"), F.col("evidence"))
    return rows.select("conv_id", score.alias("score"), flagged.alias("flagged"))


@query("""SELECT vec_id, round(m[1] / sqrt(list_dot_product(m, m)), 6) AS first, round(m[64] / sqrt(list_dot_product(m, m)), 6) AS last FROM (
  SELECT vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: (CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) / 2) AS m FROM embeddings)""")
def aligned_vectors(spark, sf):
    """Bilingual alignment: a vector averaged with its counterpart; here the vector turned round stands for it."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf, "embeddings").select("vec_id", e.alias("e")).withColumn("a", vx.aligned(F.col("e"), F.reverse("e")))
    return rows.select("vec_id", F.round(F.get("a", F.lit(0)), 6).alias("first"), F.round(F.get("a", F.lit(63)), 6).alias("last"))


@query()
def vec_topk_lsh(spark, sf):
    """``vec_topk`` by random hyperplanes: approximate, so its recall is tested instead."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return nearest.VectorIndex.of(vectors).search(vectors.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("q")))


def _vector_queries(spark, sf):
    return table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def _entries(spark, sf):
    """Neighbouring vectors stand for an entry's two languages; every eleventh entry lacks the second."""
    rows = table(spark, sf, "embeddings").withColumn("doc_id", F.floor(F.col("vec_id") / 2))
    side = lambda n: F.max_by("embedding", F.when(F.col("vec_id") % 2 == n, F.col("vec_id")))
    rows = rows.groupBy("doc_id").agg(side(0).alias("one"), F.when(F.col("doc_id") % 11 != 0, side(1)).alias("two"))
    return rows.select("doc_id", "one", "two", F.concat(F.lit("one "), F.col("doc_id").cast("string")).alias("text_one"), F.concat(F.lit("two "), F.col("doc_id").cast("string")).alias("text_two"))


_V = """v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id % 20 = 0)"""
_COSINE = "round(list_dot_product(q, m) / sqrt(list_dot_product(q, q) * list_dot_product(m, m)), 6) AS score"
_ALIGNED = f"""{_V}, al AS (SELECT a.vec_id // 2 AS doc_id, list_transform(list_zip(a.e, b.e), lambda p: (p[1] + p[2]) / 2) AS m FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0 WHERE (a.vec_id // 2) % 11 <> 0),
bh AS (SELECT qid, doc_id, {_COSINE} FROM q, al), bt AS ({TOP.format('bh', 3)})"""


@query(f"WITH {_ALIGNED} SELECT * FROM bt")
def bilingual_topk(spark, sf):
    return nearest.bilingual_search(_entries(spark, sf), _vector_queries(spark, sf))


@query(f"WITH {_ALIGNED} SELECT qid, language, language || ' ' || doc_id AS translation, score, rank FROM bt, (VALUES ('one'), ('two')) AS l(language) WHERE qid % 40 = 0 OR language = 'two'")
def concept_translations(spark, sf):
    """Every other query asks for both languages, the rest for the second."""
    asked, entries = _vector_queries(spark, sf), _entries(spark, sf)
    both = nearest.translate_concept(entries, asked.filter("qid % 40 = 0"))
    return both.unionByName(nearest.translate_concept(entries, asked.filter("qid % 40 <> 0"), "two"))


# Items by the modalities that they have.
_FUSED = """f AS (SELECT vec_id AS doc_id, 'spectrum+lightcurve' AS modalities, {both} AS m FROM v WHERE vec_id % 3 <> 1 AND vec_id % 5 <> 2
UNION ALL SELECT vec_id, 'spectrum', {one} FROM v WHERE vec_id % 3 <> 1 AND vec_id % 5 = 2 UNION ALL SELECT vec_id, 'lightcurve', {two} FROM v WHERE vec_id % 3 = 1 AND vec_id % 5 <> 2)"""


def _items(spark, sf):
    """Three modalities made from one vector, each of them absent in some items, the third in all."""
    rows = table(spark, sf, "embeddings")
    e = F.transform("embedding", lambda x: x.cast("double"))
    return rows.select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 3 != 1, e).alias("spectrum"), F.when(F.col("vec_id") % 5 != 2, F.reverse(e)).alias("lightcurve"), F.lit(None).cast("array<double>").alias("text"))


_MEANS = _FUSED.format(both="list_transform(list_zip(e, list_reverse(e)), lambda p: (0.4e0 * p[1] + 0.35e0 * p[2]) / 0.75e0)", one="e", two="list_reverse(e)")


@query(f"WITH {_V}, {_MEANS}, h AS (SELECT qid, doc_id, {_COSINE}, modalities FROM q, f) {TOP.format('h', 5)}")
def cross_modal_topk(spark, sf):
    return nearest.cross_modal_search(_items(spark, sf), _vector_queries(spark, sf))


_PADDED = _FUSED.format(both="list_concat(e, list_reverse(e))[1:96]", one="list_concat(e, list_transform(range(32), lambda x: 0e0))", two="list_concat(list_reverse(e), list_transform(range(32), lambda x: 0e0))")


@query(f"""WITH {_V}, {_PADDED}, q2 AS (SELECT qid, list_concat(q, list_reverse(q))[1:96] AS q FROM q),
h AS (SELECT qid, doc_id, {_COSINE}, modalities FROM q2, f) {TOP.format('h', 5)}""")
def cross_modal_concat(spark, sf):
    """Modalities one after the other, cut or padded to 96 numbers; queries have the first two."""
    asked = _vector_queries(spark, sf).select("qid", F.slice(F.concat("q", F.reverse("q")), 1, 96).alias("q"))
    return nearest.cross_modal_search(_items(spark, sf), asked, method="concat", dim=96)


@query(rf"""WITH e AS (SELECT doc_id, regexp_extract(coalesce(text, ''), '^(\S+\s+\S+)', 1) AS key, coalesce(text, '') AS content FROM documents),
k AS (SELECT doc_id, content, regexp_extract_all(lower(key), '\p{{L}}{{2,}}') AS kt FROM e), kt AS (SELECT DISTINCT doc_id, unnest(kt) AS term FROM k), ct AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(content), '\p{{L}}{{2,}}')) AS term FROM e),
b AS (SELECT item_id AS qid, regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}{{2,}}') AS words FROM benchmark), asked AS (SELECT DISTINCT qid, unnest(words) AS term FROM b),
s AS (SELECT qid, doc_id, sum(a) AS keyed, sum(c) AS held FROM (SELECT qid, doc_id, 1 AS a, 0 AS c FROM asked JOIN kt USING (term) UNION ALL SELECT qid, doc_id, 0, 1 FROM asked JOIN ct USING (term)) GROUP BY ALL),
h AS (SELECT qid, doc_id, CAST(3 * keyed + held + CASE WHEN keyed > 0 AND (contains(' ' || array_to_string(words, ' ') || ' ', ' ' || array_to_string(kt, ' ') || ' ') OR contains(' ' || array_to_string(kt, ' ') || ' ', ' ' || array_to_string(words, ' ') || ' ')) THEN 10 ELSE 0 END AS BIGINT) AS score
FROM s JOIN k USING (doc_id) JOIN b USING (qid)), t AS ({TOP.format('h', 5)}),
p AS (SELECT t.*, string_split(content, chr(10)) AS parts, words FROM t JOIN e USING (doc_id) JOIN b USING (qid)),
u AS (SELECT qid, doc_id, score, rank, words, parts, unnest(range(len(parts))) AS pos FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY len(list_intersect(list_distinct(regexp_extract_all(lower(parts[pos + 1]), '\p{{L}}{{2,}}')), words)) DESC, pos) AS i FROM u)
SELECT qid, doc_id, score, rank, CAST(pos AS INT) AS paragraph, trim(parts[pos + 1]) AS best FROM n WHERE i = 1""")
def field_topk(spark, sf):
    """A document's first two words stand for its key, its lines for paragraphs."""
    docs = spread(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content")))
    entries = stored(docs.select("doc_id", F.regexp_extract("content", r"^(\S+\s+\S+)", 1).alias("key"), "content"))
    return fields.field_search(entries, _asked(spark, sf), separator="\n")
