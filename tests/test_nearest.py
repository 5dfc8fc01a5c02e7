"""Search by random hyperplanes against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from astroloom.operators import nearest, retrieval


def recall(got, want):
    a, b = ({(r.qid, r.doc_id) for r in df.collect()} for df in (got, want))
    return len(a & b) / len(b)


@pytest.fixture(scope="module")
def clustered(spark):
    """2,000 vectors in 100 groups, some equal."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((100, 32))
    rows = [(k, (centres[k % 100] + 0.4 * rng.standard_normal(32)).tolist()) for k in range(1980)]
    rows += [(k, rows[5][1]) for k in range(1980, 1999)] + [(1999, None)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>").cache()


def asked(vectors):
    return vectors.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("embedding").alias("q"))


def test_recall_on_groups(clustered):
    index = nearest.VectorIndex.of(clustered)
    queries = asked(clustered)
    want = retrieval.vector_search(clustered.filter("embedding IS NOT NULL"), queries)
    got = index.search(queries)
    assert recall(got, want) >= 0.95
    exact = {(r.qid, r.doc_id): r.score for r in retrieval.vector_search(clustered.filter("embedding IS NOT NULL"), queries, 2000, -1.0).collect()}
    assert all(exact[r.qid, r.doc_id] == r.score for r in got.collect())
    few = nearest.VectorIndex.of(clustered, nearest.Planes(bands=8, bits=10, probes=4))
    assert few.candidates(queries).count() < 0.1 * 2000 * 100 and recall(few.search(queries), want) >= 0.9


def test_recall_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    assert recall(nearest.VectorIndex.of(vectors).search(asked(vectors)), retrieval.vector_search(vectors, asked(vectors))) >= 0.9


def test_stored_tables_are_not_shuffled(spark, clustered):
    index = nearest.VectorIndex.of(clustered).save("plane_index", 4)
    queries = asked(clustered)
    assert recall(index.search(queries), nearest.VectorIndex.of(clustered).search(queries)) == 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = index.candidates(queries)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("plane_index_bands") - 400 :]
    assert "Bucketed: true" in scan
    assert plan.count("hashpartitioning(band") == 1, "queries alone are dealt out by bucket"


def test_bilingual_and_translation_by_planes(spark, clustered):
    entries = clustered.select("doc_id", F.col("embedding").alias("one"), F.transform("embedding", lambda x: x * 0.9).alias("two"), F.concat(F.lit("a"), "doc_id").alias("text_one"), F.concat(F.lit("b"), "doc_id").alias("text_two"))
    queries = asked(clustered)
    assert recall(nearest.bilingual_search(entries, queries, search=nearest.by_planes()), nearest.bilingual_search(entries, queries)) >= 0.9
    rows = nearest.translate_concept(entries, queries, "two", search=nearest.by_planes()).collect()
    assert {r.language for r in rows} == {"two"} and all(r.translation.startswith("b") and r.rank <= 3 for r in rows)
    found = {(r.qid, r.translation) for r in rows if r.rank == 1}
    assert sum(f"b{q}" == t for q, t in found) >= 0.9 * len(found)


def test_fusion_of_what_is_present(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0]), (2, [1.0, 0.0], None), (3, None, None)], "doc_id int, spectrum array<double>, text array<double>")
    weights = {"spectrum": 0.4, "text": 0.25}
    got = {r.doc_id: r.embedding for r in nearest.fused(items, weights).collect()}
    assert got == {1: pytest.approx([0.4 / 0.65, 0.25 / 0.65]), 2: [1.0, 0.0]}
    got = {r.doc_id: r.embedding for r in nearest.fused(items, weights, "concat", 3).collect()}
    assert got == {1: [1.0, 0.0, 0.0], 2: [1.0, 0.0, 0.0]}
