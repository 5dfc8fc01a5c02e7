import zlib

import numpy as np

from astroloom.llm import toxicity as t

SCHEMA = "doc_id long, text string, toxic int, score double"
SMALL = t.Training(toxic=60, clean=120, clean_windows=3, rounds=2, epochs=4)


def test_gradients():
    """Backpropagation against differences of the loss."""
    net = t.Network.new(t.Training(size=3, width=2, seed=1))
    for k, v in net.p.items():
        net.p[k] = v.astype(np.float64)
    words, rng = [b"ab", b"abc", b"zzzz", b"q"], np.random.default_rng(0)
    ids, mask = rng.integers(0, 4, (3, 5)), np.array([[1, 1, 1, 1, 1], [1, 1, 0, 0, 0], [1, 0, 0, 0, 0]], dtype=bool)
    y, weight = np.array([1.0, 0, 1]), np.array([0.5, 1, 2])

    def loss():
        z = net.logits(net.project(words), ids, mask).astype(float)
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum())

    before = {k: v.copy() for k, v in net.p.items()}
    adam = {}
    net.step(words, ids, mask, y, weight, adam, 0.0)
    for name in ("Wf", "Uf", "Ub", "cb", "A", "a", "o", "s", "word", "gram"):
        grad = adam[name][0] / 0.1
        at = np.unravel_index(int(np.abs(grad).argmax()), grad.shape)
        net.p = {k: v.copy() for k, v in before.items()}
        net.p[name][at] += 1e-3
        up = loss()
        net.p[name][at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - grad[at]) < 0.02 * abs(grad[at]) + 1e-4, name


def test_windows_cover_whole_texts():
    for n in (0, 1, 24, 25, 36, 37, 100, 1000):
        at = t.windows_at(n)
        assert at[0] == 0 and at[-1] + t.WINDOW >= n and (np.diff(at) == t.STRIDE).all()


def corpus():
    rng = np.random.default_rng(4)
    bad = [f"vex{x}" for x in "abcdefgh"]
    texts, labels = [], []
    for k in range(200):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["lo", "ti", "ran"], 90), rng.choice(["ma", "ko", "de"], 90))]
        if k % 3 == 0:
            for i in rng.integers(0, 90, 3):
                words[i] = bad[int(rng.integers(0, 4 if k < 150 else 8))]
        texts.append(" ".join(words))
        labels.append(int(k % 3 == 0))
    return texts, labels


def test_held_out_texts_with_unseen_words():
    texts, labels = corpus()
    net = t.fit_network(texts[:150], labels[:150], SMALL)
    assert ((net.scores(texts[150:]) >= t.THRESHOLD) == np.array(labels[150:])).mean() > 0.95
    late = "loma " * 3000 + "vexa vexb " + "kode " * 10
    assert net.scores([late, "loma " * 3000])[0] > 0.5 > net.scores(["loma " * 3000])[0]
    one = net.scores(["loma tiko"], 1)
    assert np.allclose(net.scores(["loma tiko"] * 5 + [""])[:5], one)


def test_odd_rows(spark):
    texts, labels = corpus()
    docs = spark.createDataFrame([(k, x, 5, 0.5) for k, x in enumerate(texts)] + [(900, None, 1, 0.0), (901, "", 1, 0.0), (None, "x", 1, 0.0), (0, texts[0], 1, 0.0)], SCHEMA)
    marks = spark.createDataFrame([(k, y, "e") for k, y in enumerate(labels)] + [(3, 0, "e"), (7, None, "e"), (None, 1, "e")], "doc_id long, toxic int, text string")
    net = t.learn(docs, marks, SMALL)
    out = t.score_texts(docs, net).collect()
    assert len(out) == 204 and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id in (900, 901)} == {net.scores([""])[0]} and net.scores([""])[0] < t.THRESHOLD
    kept = {r.doc_id for r in t.drop_toxic(docs, net).select("doc_id").collect()}
    assert {900, 901, None, 1} <= kept and 0 not in kept
    assert t.score_texts(docs.limit(0), net).count() == 0
    none = t.learn(docs, marks.filter("toxic = 5"), SMALL)
    assert all(r.score < t.THRESHOLD for r in t.score_texts(docs, none).collect())


def test_corpus_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = t.op7_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id", how="left")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    test = out[out.held_out & out.toxic.notna()]
    assert ((test.predicted == 1) == (test.toxic == 1)).mean() > 0.85


def test_scores_are_those_of_plain_windows():
    """Each window by itself, word by word and unit by unit, against the batched scores."""
    net = t.Network.new(t.Training(size=3, width=2, seed=5))
    rng = np.random.default_rng(2)
    net.p = {k: (v + rng.normal(0, 0.4, v.shape)).astype(np.float32) for k, v in net.p.items()}
    net.scale = (0.7, -0.2)
    p, n = net.p, 2
    sig = lambda v: 1 / (1 + np.exp(-float(v)))

    def vector(word):
        rows, _ = t.grams_of([word])
        return [*p["word"][zlib.crc32(word) % t.WORD_ROWS], *np.mean([p["gram"][r] for r in rows], axis=0)]

    def states(xs, way):
        h, out = [0.0] * n, []
        for x in xs:
            a = [sum(x[i] * p[f"W{way}"][i, j] for i in range(len(x))) + p[f"c{way}"][j] for j in range(3 * n)]
            g = [sum(h[i] * p[f"U{way}"][i, j] for i in range(n)) for j in range(3 * n)]
            z, r = [sig(a[j] + g[j]) for j in range(n)], [sig(a[n + j] + g[n + j]) for j in range(n)]
            h = [(1 - z[j]) * np.tanh(a[2 * n + j] + r[j] * g[2 * n + j]) + z[j] * h[j] for j in range(n)]
            out.append(h)
        return out

    def logit(words):
        xs = [vector(w) for w in words]
        both = [[*f, *b] for f, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1], strict=True)]
        e = [np.exp(sum(np.tanh(sum(s[i] * p["A"][i, j] for i in range(2 * n))) * p["a"][j] for j in range(n))) for s in both]
        return sum(w / sum(e) * s[i] * p["o"][i] for w, s in zip(e, both, strict=True) for i in range(2 * n)) + p["s"][0]

    texts = ["", "one", " ".join(f"w{k}" for k in range(24)), " ".join(f"v{k % 31}" for k in range(61)), "!?"]
    want = []
    for text in texts:
        words, start, found = text.encode().split() if text != "!?" else [], 0, []
        while True:
            found.append(logit(words[start : start + t.WINDOW]))
            if start + t.WINDOW >= len(words):
                break
            start += t.STRIDE
        want.append(sig(0.7 * max(found) - 0.2))
    assert np.allclose(net.scores(texts), want, atol=1e-5)
