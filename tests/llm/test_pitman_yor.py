import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from astroloom.llm import pitman_yor as p

SCHEMA = "doc_id long, text string, score double, block int"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def check(out, docs):
    """All but the model's own score straight from the wording."""
    train = Counter(t for i, x in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(x))
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), len(tokens(x)), sum(train[t] > 0 for t in tokens(x)), n, round(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for i, x in docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.spelled_score <= r.score < 0 for r in out)


def score(spark, docs):
    frame = spark.createDataFrame([(i, x, 0.0, 1) for i, x in docs], SCHEMA)
    return p.score_texts(frame, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (4, "é b\x0bc"), (None, "only here"), (5, "long " * 50_000)] + [(k, f"w{k} common words here") for k in range(10, 40)]
    check(score(spark, docs).collect(), docs)


def test_empty(spark):
    assert score(spark, []).count() == 0


def test_corpus_beats_the_base(spark, small):
    out = p.op9_pitman_yor(spark, small).collect()
    check(out, [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()])
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_predictions_sum_to_one(spark):
    """Known words' probabilities in the shared restaurant and the spelling model's rest."""
    frame = spark.createDataFrame([(k, "aa ab ba aa", 0.0, 1) for k in range(30)] + [(50, "zz", 0.0, 1), (51, "not learned", 0.0, 1)], SCHEMA)
    model = p.PitmanYor(p.Corpus(frame, F.col("doc_id") <= 50, ("doc_id",)))
    words = model.scored_vocabulary().collect()
    assert abs(sum(r.p for r in words if r.c) + model.unknown - 1) < 1e-6
    assert {bytes(r.word) for r in words if not r.c} == {b"not", b"learned"} and all(0 < r.p < 1 for r in words)
    for spelling, _ in model.states:
        assert np.allclose(np.exp(spelling.logs.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_contexts_follow_the_restaurant(spark, small):
    """Scores against plain Python over all pairs, given the shared restaurant's probabilities; and with one block or many."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    frame = spark.createDataFrame([(i, x, 0.0, 1) for i, x in docs], SCHEMA)
    learned = F.col("doc_id") % 3 != 0
    corpus = p.Corpus(frame, learned, ("doc_id",))
    model = p.PitmanYor(corpus)
    parent = {bytes(r.word).decode(): r.p if r.c else model.unknown for r in model.scored_vocabulary().collect()}
    pairs, seen = Counter(), Counter()
    for i, x in docs:
        t = tokens(x)
        if i % 3:
            pairs.update(zip(["\n", *t[:-1]], t, strict=True))
            seen.update(t)
    followed = Counter(u for u, _ in pairs)
    assert (corpus.once, corpus.twice) == tuple(sum(c == k for c in pairs.values()) for k in (1, 2))
    assert {bytes(r.word).decode(): r.followed for r in model.all_words.collect() if r.followed} == followed
    d, want = model.context_discount, {}
    for i, x in docs:
        t = tokens(x)
        ps = [(max(pairs[u, w] - d, 0) + (1 + d * followed[u]) * parent[w]) / (1 + seen[u]) for u, w in zip(["\n", *t[:-1]], t, strict=True)]
        want[i] = sum(map(math.log10, ps))
    got = {r.doc_id: r.score for r in p.score_texts(frame, learned).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)
    context = "the" if followed["the"] else max(followed, key=followed.get)
    inside = sum((max(pairs[context, w] - d, 0) + (1 + d * followed[context]) * q) / (1 + seen[context]) for w, q in parent.items() if seen[w])
    rest = (1 + d * followed[context]) * model.unknown / (1 + seen[context])
    assert abs(inside + rest - 1) < 1e-6


def test_word_order_counts(spark):
    docs = [(k, "red fox runs over green hills") for k in range(1, 30)] + [(100, "red fox runs over green hills"), (101, "hills over red green runs fox")]
    frame = spark.createDataFrame([(i, x, 0.0, 1) for i, x in docs], SCHEMA)
    got = {r.doc_id: r.score for r in p.score_texts(frame, F.col("doc_id") < 100).collect()}
    assert got[100] > got[101] + 2


def test_many_blocks(spark, monkeypatch):
    docs = [(k, f"w{k % 7} common words here w{k % 5}") for k in range(60)]
    frame = spark.createDataFrame([(i, x, 0.0, 1) for i, x in docs], SCHEMA)
    one = sorted((r.doc_id, round(r.score, 6), round(r.base_score, 6)) for r in p.score_texts(frame, F.col("doc_id") % 2 == 0).collect())
    monkeypatch.setattr(p, "BLOCK_BYTES", 40)
    assert sorted((r.doc_id, round(r.score, 6), round(r.base_score, 6)) for r in p.score_texts(frame, F.col("doc_id") % 2 == 0).collect()) == one


def test_seating_follows_the_restaurant():
    """Mean tables against the exact recursion."""
    dish, c, new, d = np.random.default_rng(0).integers(0, 1 << 63, 20_000, dtype=np.uint64), 20, 1.5, 0.4
    exact = np.zeros(c + 1)
    exact[1] = 1.0
    for j in range(1, c):
        nxt = np.zeros(c + 1)
        for t in range(1, j + 1):
            open_ = new / (j - d * t + new)
            nxt[t + 1] += exact[t] * open_
            nxt[t] += exact[t] * (1 - open_)
        exact = nxt
    drawn = p.seat(np.full(20_000, c), np.full(20_000, new), d, dish, 1)
    assert abs(drawn.mean() - (exact * np.arange(c + 1)).sum()) < 0.05
    big = p.seat(np.array([10**6, 1, 0]), np.array([5.0, 5.0, 5.0]), d, dish[:3], 1)
    assert 1 < big[0] < 10**6 and big[1] == 1 and big[2] == 0


def test_draws_follow_the_binomial():
    u = (np.arange(100_000) + 0.5) / 100_000
    for n, q in ((7, 0.3), (40, 0.9), (500, 0.01), (3000, 0.4), (9, 1.0), (5, 0.0)):
        x = p.binomials(np.full(len(u), float(n)), np.full(len(u), q), u)
        assert abs(x.mean() - n * q) < 0.02 * max(1, n * q) ** 0.5 + 1e-9 and abs(x.var() - n * q * (1 - q)) < 0.03 * max(1, n * q * (1 - q))
        assert x.min() >= 0 and x.max() <= n


def test_scores_do_not_depend_on_partitions(spark, small):
    out = []
    for n in ("3", "7"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            out.append({(r.doc_id, r.n_tokens): r.score for r in p.op9_pitman_yor(spark, small).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0].keys() == out[1].keys() and all(abs(out[0][k] - out[1][k]) < 1e-6 for k in out[0])


def drawn(docs, learned, s):
    """The whole sampler in plain Python over dictionaries of all pairs: each text's score, and the tables of each repeated
    pair in every kept sweep."""
    bits = min(64, max(40, 20 + sum(len((x or "").encode()) for _, x in docs).bit_length()))
    pairs, seen = Counter(), Counter()
    for i, x in docs:
        if learned(i):
            t = tokens(x)
            pairs.update(zip(["\n", *t[:-1]], t, strict=True))
            seen.update(t)
    words, repeated = sorted(seen), [k for k, c in pairs.items() if c > 1]
    spelled, short = [w.encode() for w in words], {w: p.dishes([w.encode()]) >> np.uint64(64 - bits) for w in words}
    pair_dish = np.array([p.pair_dishes(short[w], short[u])[0] for u, w in repeated], dtype=np.uint64)

    def discount(counts):
        once, twice = (sum(c == k for c in counts) for k in (1, 2))
        return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))

    first = Counter(w for _, w in pairs)
    inner, outer = discount(pairs.values()), discount(first.values())
    seated, kept = dict.fromkeys(pairs, 1), []
    at, ends = p.cells_of(spelled)
    lengths = np.diff(ends, prepend=0)
    for sweep in range(1 + s.burn_in + s.kept):
        if sweep:
            new = np.array([(s.context_strength + inner * of_context[u]) * shared[w] for u, w in repeated])
            t = p.seat(np.array([pairs[k] for k in repeated]), new, inner, pair_dish, s.seed + sweep)
            seated |= dict(zip(repeated, t.tolist(), strict=True))
        of_context, of_word = Counter(), Counter()
        for (u, w), t in seated.items():
            of_context[u] += t
            of_word[w] += t
        n = np.array([of_word[w] for w in words], dtype=np.int64)
        tables = np.ones(len(words))
        if sweep:
            new = (s.word_strength + outer * all_tables) * np.exp(spelling.log_probability(spelled))
            tables = p.seat(n, new, outer, p.dishes(spelled), s.seed + sweep)
        cells = np.bincount(at, np.repeat(tables, lengths))
        spelling = p.Spelling.sample(np.flatnonzero(cells), cells[cells > 0].astype(np.int64), s, sweep)
        all_tables = tables.sum()
        mass = (s.word_strength + outer * all_tables) / (s.word_strength + n.sum())
        spelling_p = np.exp(spelling.log_probability(spelled))
        shared = dict(zip(words, ((n - outer * tables) / (s.word_strength + n.sum()) + mass * spelling_p).tolist(), strict=True))
        if sweep > s.burn_in:
            kept.append((dict(seated), of_context, shared, mass * (1 - spelling_p.sum())))

    def one(u, w):
        each = [(pairs[u, w] - inner * t.get((u, w), 0) + (s.context_strength + inner * c[u]) * q.get(w, rest)) / (s.context_strength + seen[u]) for t, c, q, rest in kept]
        return math.log10(sum(each) / len(each))

    scores = {i: sum(one(u, w) for u, w in zip(["\n", *tokens(x)[:-1]], tokens(x), strict=True)) for i, x in docs}
    return scores, [{k: t[k] for k in repeated} for t, *_ in kept], pairs


def test_op9_draws_the_tables_of_contexts(spark, small):
    """The query against the sampler in plain Python, in which repeated pairs have between one table and one each."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want, tables, pairs = drawn(docs, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, p.Sampling())
    for t in tables:
        assert all(1 <= n <= pairs[k] for k, n in t.items()) and any(1 < n for n in t.values())
    assert tables[0] != tables[1]
    got = {r.doc_id: r.score for r in p.op9_pitman_yor(spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)


def test_drawn_tables_are_the_shared_customers(spark):
    """Frequent words' pairs are dealt to several parts; the sums over words, contexts and parts are the same."""
    docs = [(k, " ".join(f"w{(k * j) % 11}" for j in range(1, 30))) for k in range(1, 90)]
    frame, s = spark.createDataFrame([(i, x, 0.0, 1) for i, x in docs], SCHEMA), p.Sampling(draw_contexts=True)
    corpus = p.Corpus(frame, F.col("doc_id") > 9, ("doc_id",))
    assert len(corpus.layout.heavy) and corpus.layout.shares.max() > 1
    model = p.PitmanYor(corpus, s)
    seatings = [p.unpacked(bytes(r.data))["seatings"] for r in model.homes.collect()]
    for k, (_, (tables, customers)) in enumerate(model.states[s.burn_in :]):
        n, t, contexts = (sum(int(x[k][j].sum()) for x in seatings) for j in range(3))
        assert n == contexts == customers and t == tables
    want, drawn_tables, _ = drawn(docs, lambda i: i > 9, s)
    assert sum(drawn_tables[-1].values()) > len(drawn_tables[-1])
    got = {r.doc_id: r.score for r in p.score_texts(frame, F.col("doc_id") > 9, s=s).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)
