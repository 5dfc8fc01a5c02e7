import corpus_pipeline as pipeline
from test_near_copies import brute
from test_packing import check

from astroloom.llm import decontaminate, secrets, toxicity


def test_stages_against_plain_python(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: r[0])
    net = toxicity.learn(docs, labels)
    rows = [r for r, s in zip(rows, net.scores([t or "" for _, t in rows])) if s < toxicity.THRESHOLD]
    stay = set(brute(rows))
    rows = [r for r in rows if r[0] in stay]
    windows = {w for i in items.collect() if i.item_id is not None for w in decontaminate.windows_of(decontaminate.alnum_words((i.text or "").encode()))}
    lengths = {len(w) for w in windows}
    kept = {}
    for i, text in rows:
        words = decontaminate.alnum_words((text or "").encode())
        spans = decontaminate.merged((k, k + n) for n in lengths for k in range(len(words) - n + 1) if tuple(words[k : k + n]) in windows)
        hit = sum(b - a for a, b in spans)
        if hit <= 0.5 * len(words):
            text = decontaminate._without(text, spans) if hit else text
            kept[i] = None if text is None else secrets._masked(text, secrets.scan_text(text), "[secret]")
    assert 0 < len(kept) < docs.count()
    check(pipeline.run(spark, small).collect(), kept)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6, None, "en", "s", 0), (None, "", None, None, None), (10**6 + 1, "", "en", "s", 0)], docs.schema)
    rows = docs.limit(30).unionByName(odd)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, rows, small)
        assert out.columns == docs.columns, name
        assert stage(spark, rows.limit(0), small).count() == 0, name
        assert out.filter("doc_id IS NULL").count() == 1, name
