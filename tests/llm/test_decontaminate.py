import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from astroloom.llm import decontaminate as d

DOC, ITEM = "doc_id long, text string, n_words long, items string", "item_id long, text string, doc_id long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for k in range(max(len(v) - 9, 1) if v else 0):
            window = v[k : k + 10]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def same(spark, docs, items):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = d.digest(d.contamination(frame([(i, t, 5, "z") for i, t in docs], DOC), frame([(i, t, 7) for i, t in items], ITEM))).collect()
    want = [(i, *brute(t, [x for x in items if x[0] is not None and x[1] is not None])) for i, t in docs]
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, want))


@pytest.mark.parametrize("log", [d.FILTER_LOG, 6])
def test_random_small_alphabet(spark, log, monkeypatch):
    monkeypatch.setattr(d, "FILTER_LOG", log)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["a", "B", "é", "a-b", "c."]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 9, 10, 11, 14]))) for k in range(12)] + [(50, None), (None, "a b"), (51, "--"), (10, "B a")]
    docs = [(k, text(rng.randint(0, 60))) for k in range(40)] + [(90, None), (91, ""), (None, "a a"), (90, None), (92, items[6][1] + " tail")]
    same(spark, docs, items)


@pytest.mark.parametrize("log", [d.FILTER_LOG, 6])
def test_long_text_and_passages(spark, log, monkeypatch):
    monkeypatch.setattr(d, "FILTER_LOG", log)
    passage = "one two three four five six seven eight nine ten eleven twelve"
    same(spark, [(1, "pad " * 50_000 + passage.upper() + " pad"), (2, passage[:-7]), (3, "one two three")], [(7, passage), (8, passage), (9, "pad pad tail")])


@pytest.mark.parametrize("log", [d.FILTER_LOG, 6])
def test_empty_tables(spark, log, monkeypatch):
    monkeypatch.setattr(d, "FILTER_LOG", log)
    same(spark, [], [(1, "a")])
    same(spark, [(1, "a"), (2, None)], [])


def test_a_filter_that_nearly_all_pass(spark, small, monkeypatch):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = d.digest(d.contamination(docs, items)).collect()
    monkeypatch.setattr(d, "FILTER_LOG", 6)
    assert sorted(whole) == sorted(d.digest(d.contamination(docs, items)).collect())
    assert {tuple(r) for r in whole} == {(r.doc_id, *brute(r.text, [(i.item_id, i.text) for i in items.collect()])) for r in docs.collect()}


def test_drop_hit_words(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"É kept; {passage}! end", 1, "a"), (2, passage, 1, "b"), (3, None, 1, "c"), (4, "clean.", 1, "d")], DOC)
    items = spark.createDataFrame([(1, passage, 1)], ITEM)
    assert {r.doc_id: r.text for r in d.drop_hit_words(docs, items, share=0.8).collect()} == {1: "É kept; ! end", 3: None, 4: "clean."}


def test_cuts_do_not_depend_on_the_filter(spark, monkeypatch):
    w = [f"w{k}" for k in range(80)]
    items = [(k, " ".join(w[k : k + 10])) for k in range(0, 30, 3)] + [(40, " ".join(w[60:70])), (41, " ".join(w[70:80]))]
    # Overlapping windows; 12 of 20 words hit by two items; a window that only a cut makes.
    docs = [(1, "a; " + ", ".join(w[:40]) + " z " * 60), (2, " ".join(w[60:80]) + " x" * 13), (3, " ".join(w[:3] + w[60:70] + w[3:10]) + " y" * 30), (None, " ".join(w[:10]) + " q" * 20), (None, "none"), (None, None), (2, "clean")]
    frame, of = spark.createDataFrame([(i, t, 5, "z") for i, t in docs], DOC), spark.createDataFrame([(i, t, 7) for i, t in items], ITEM)
    whole, found = d.drop_hit_words(frame, of).collect(), d.contamination(frame, of).collect()
    monkeypatch.setattr(d, "FILTER_LOG", 6)
    assert sorted(map(repr, d.drop_hit_words(frame, of).collect())) == sorted(map(repr, whole))
    assert sorted(map(repr, d.contamination(frame, of).collect())) == sorted(map(repr, found))
    assert len(found) == len(docs) and 1 < len(whole) < len(docs)


@pytest.mark.parametrize("log", [d.FILTER_LOG, 6])
def test_cuts_keep_clashing_columns(spark, monkeypatch, log):
    monkeypatch.setattr(d, "FILTER_LOG", log)
    passage = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"kept {passage} end", 1, "a"), (2, "clean.", 1, "b")], DOC)
    docs = docs.withColumns({c: F.col("doc_id") for c in ("ROW", "rowspans", "spans", "items", "windows", "item_id")})
    out = d.drop_hit_words(docs, spark.createDataFrame([(1, passage, 1)], ITEM), share=0.9)
    assert out.columns == docs.columns
    assert sorted((r.text, *list(r)[-6:]) for r in out.collect()) == [("clean.", *[2] * 6), ("kept  end", *[1] * 6)]


def test_shingles_of_several_texts():
    texts = [[], [b"a"], [b"b", b"c"], [], [b"a", b"b", b"c"], []]
    everything = d.ShingleFilter.__new__(d.ShingleFilter)
    everything.log, everything.bits = 6, d.np.full(1, 2**64 - 1, dtype=d.np.uint64)
    for single in (False, True):
        text, at, hashes = d.Shingles().passing(texts, single, everything)
        want = sorted((k, p, h) for k, w in enumerate(texts) for h, p in zip(*(x.tolist() for x in d.Shingles().of(w, single)), strict=True))
        assert sorted(zip(text.tolist(), at.tolist(), hashes.tolist(), strict=True)) == want
        assert len(want) == 3 + 6 * single
    assert d.Shingles().passing([[]], True, everything)[0].size == 0


def test_no_text_is_shuffled(spark, small):
    docs, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "benchmark"))
    of, prefix, single = d._prefixes(docs, items, d.WINDOW)
    seen = d._places(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "row", prefix, single, d.WINDOW)
    assert seen.filter("shingle IS NULL").count() == docs.count()
    total = sum(len(words(r.text)) for r in docs.collect())
    assert seen.filter("shingle IS NOT NULL").count() < total / 10
    assert single == any(len(r.window) == 1 for r in of.collect())
