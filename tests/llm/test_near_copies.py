import random

import numpy as np

from astroloom.llm import simhash as s

SCHEMA = "doc_id long, text string, fingerprint string, node long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(docs):
    """What stays: the smallest id of each group, by all pairs."""
    sets, group = [shingles(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if group[i] != group[j] and (not union or len(sets[i] & sets[j]) / union >= 0.8):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return sorted({min(d for (d, _), h in zip(docs, group) if h == g) for g in group})


def kept(spark, docs):
    return sorted(r.doc_id for r in s.one_of_each(spark.createDataFrame([(i, t, "x", 9) for i, t in docs], SCHEMA)).collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_edited_words_and_chains(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = [(0, ""), (1, None), (2, "one two"), (3, "ONE  two"), (4, "one two three")]
    for k in range(30):  # near copies, some on either side of the bound, and copies of copies
        words = [word() for _ in range(rng.choice([30, 120, 400]))]
        docs.append((len(docs), " ".join(words)))
        for n in (1, len(words) // 90, len(words) // 40, len(words) // 15):
            docs.append((len(docs), edited(rng, docs[-1][1].split(), n)))
    assert kept(spark, docs) == brute(docs)
    assert len(kept(spark, docs)) < 0.8 * len(docs)


def test_large_group_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(300)]
    docs = [(k, edited(rng, words, rng.randrange(6))) for k in range(150)]
    monkeypatch.setattr(s, "SETS", 20)
    frame = spark.createDataFrame([(i, t, "x", 9) for i, t in docs], SCHEMA)
    near = s.shingled(frame.select("doc_id", "text"), 5, sets=True).selectExpr("0L AS component", "node", "shingles").dropDuplicates(["node"])
    for block in (20, 10**6):
        assert len({r.component for r in s.components(s.alike(near, 0.8, block)).collect()}) == 1
    assert kept(spark, docs) == brute(docs) == [0]


def test_recall_of_the_ring():
    """Of pairs at Jaccard 0.8 itself, the least that is asked for."""
    rng = np.random.default_rng(6)
    apart = []
    for _ in range(1000):
        x = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
        apart.append((s.slots(x[:162]) != s.slots(x[18:])).sum())
    assert np.mean(np.array(apart) <= s.SLOTS_APART) > 0.98


def test_corpus(spark):
    """All pairs of sf0.1 that share a tenth of their shingles or more, by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows, by = docs.collect(), {}
    for r in rows:
        for g in (x := shingles(r.text)):
            by.setdefault(g, []).append(r.doc_id)
    sets, shared = {r.doc_id: shingles(r.text) for r in rows}, {}
    for ids in by.values():
        if 1 < len(ids) < 200:
            for a in range(len(ids)):
                for b in range(a):
                    p = (min(ids[a], ids[b]), max(ids[a], ids[b]))
                    shared[p] = shared.get(p, 0) + 1
    pairs = [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    group = {r.doc_id: r.group for r in s.near_copies(docs).collect()}
    found, near = sum(group[a] == group[b] for a, b in pairs), sum(sets[a] != sets[b] for a, b in pairs)
    prints = {r.doc_id: s.simhash(r.text.encode().lower().split(), 5) for r in rows if r.text and any(r.doc_id in p for p in pairs)}
    bits = sorted((prints[a] ^ prints[b]).bit_count() for a, b in pairs if sets[a] != sets[b])
    print(f"\npairs {len(pairs)}, of unequal sets {near}, found {found}; five-word SimHash bits apart {bits}")
    assert found >= 0.98 * len(pairs) and len(pairs) > 100


def test_repeated_ids_with_other_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = [(1, a), (2, a), (2, b), (3, b), (5, "five"), (5, "five"), (5, "other five"), (2, b)]
    frame = spark.createDataFrame([(i, t, "x", 9) for i, t in docs], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in s.one_of_each(frame).collect()) == [(1, a), (2, b), (5, "five"), (5, "other five")]
