import zlib

import numpy as np

from astroloom.llm import langid

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double"


def test_kernel_is_shared_ngrams():
    texts = ["abcab", "ABX", "", "zz"]
    grams = [{t.lower()[i : i + n] for n in (1, 2, 3, 4) for i in range(len(t) - n + 1)} for t in texts]
    want = [[len(a & b) / np.sqrt(max(len(a) * len(b), 1)) for b in grams] for a in grams]
    assert np.allclose(langid.kernel(langid.presence(texts), langid.presence(texts)), want, atol=1e-6)


def test_scores_equal_the_landmark_form():
    texts = [w * 5 + " " + v for w in ("the", "und", "que") for v in ("a", "bb", "ccc", "dd")]
    labels = [x for x in ("en", "de", "es") for _ in range(4)]
    rows = langid.presence(texts)
    model = langid.LanguageModel.fit(rows, labels, langid.Training(landmarks=4))
    assert [model.languages[k] for k in model.score(texts).argmax(axis=1)] == labels


def test_held_out_accuracy(spark):
    out = langid.op6_language(spark, "/root/testdata/sf0.01").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    both = out.merge(docs, on="doc_id")
    assert len(out) == len(docs) and both.score.between(0, 1).all()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    known = both[both.held_out & (both.lang_pred != "und")]
    assert (known.lang == known.lang_pred).mean() > 0.97


def test_odd_rows(spark):
    rows = [(k, t, x, "", 0.0) for k, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("x", None), (None, "en"), ("", "de"), ("12 !?", "en"), ("the " * 40_000, "en"), ("²", "en")])]
    rows += [(None, "the dog", "en", "", 0.0), rows[0]]
    frame = spark.createDataFrame(rows, SCHEMA)
    out = langid.predict_languages(frame, langid.fit_languages(frame)).collect()
    assert len(out) == len(rows)
    said = {r.doc_id: r.lang_pred for r in out}
    assert [said[k] for k in (0, 1, 3, 4, 5, 6, 7)] == ["en", "de", "und", "und", "und", "en", "und"]
    assert {r.lang_pred for r in langid.predict_languages(frame, langid.fit_languages(frame.filter("lang = 'xx'"))).collect()} == {"und"}
    assert langid.predict_languages(frame.limit(0), None).count() == 0


def test_prediction_against_the_kernel_form():
    """Scores equal kernel(text, landmarks) times ridge coefficients, written out."""
    rng = np.random.default_rng(0)
    words = {"en": "the and of to in is that".split(), "de": "der und die das ist nicht ein".split(), "es": "que de no la el en y".split()}
    texts, labels = [], []
    for lang, w in words.items():
        for _ in range(20):
            texts.append(" ".join(rng.choice(w, 12)))
            labels.append(lang)
    t = langid.Training(landmarks=8)
    rows = langid.presence(texts)
    model = langid.LanguageModel.fit(rows, labels, t)
    langs = sorted(words)
    y = np.array([langs.index(x) for x in labels])
    marks = np.concatenate([np.flatnonzero(y == k)[:8] for k in range(3)])
    inner = langid.kernel(rows[marks], rows[marks]).astype(float)
    values, vectors = np.linalg.eigh(inner)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = langid.kernel(rows, rows[marks]).astype(float) @ root
    centre, target = x.mean(axis=0), (y[:, None] == np.arange(3)).astype(float)
    beta = np.linalg.solve((x - centre).T @ (x - centre) / 60 + t.ridge / 24 * np.eye(x.shape[1]), (x - centre).T @ (target - target.mean(axis=0)) / 60)
    new = ["the und que", "der die das", "en la que no", "zzz"]
    want = (langid.kernel(langid.presence(new), rows[marks]).astype(float) @ root - centre) @ beta + target.mean(axis=0)
    assert np.allclose(model.score(new), want, atol=1e-3)


def test_bounds_hold_and_no_language_is_left_out(spark):
    rows = [(k, f"w{k % 7} word{k} l{k % 50}", f"l{k % 50}", "", 0.0) for k in range(2000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit_languages(frame, langid.Training(rows=10, all_rows=200, all_landmarks=100))
    assert len(model.languages) == 50
