import re

from astroloom.llm import licenses

SCHEMA = "doc_id long, text string, words string, labels string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """The base columns straight from their wording."""
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), sorted(labels)


def same(found, docs):
    want = sorted((repr((i, *brute(t))) for i, t in docs))
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found) == want
    assert all(set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1 for r in found)


CASES = [
    (1, None), (2, ""), (3, "no notice"), (4, "Licensed under the Apache License, Version 2.0."), (5, "MIT LICENSE mit-license mit\nlicense"), (5, "MIT LICENSE"),
    (6, "the GNU general, public license"), (7, "cc by; cc by cc"), (None, "mit license"), (8, "pad " * 60_000 + "apache license"), (9, "mit licensé mıt license"),
    (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (11, "apache words then license version 2 0"), (12, "xmit license mit licenses"),
]


def test_cases(spark):
    found = licenses.licence_labels(spark.createDataFrame([(i, t, "x", "y") for i, t in CASES], SCHEMA)).collect()
    same(found, CASES)
    labels = {r.doc_id: r.labels for r in found}
    assert labels[4] == ["apache", "apache-2.0"] and labels[10] == ["mit-text"] and labels[11] == labels[12] == [] and labels[3] == []


def test_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    same(licenses.licence_labels(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty(spark):
    assert licenses.licence_labels(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(spark, small):
    plan = licenses.op3_licenses(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_labels(text, templates, idf):
    """Labels and score from their wording: every relative position is tried."""
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    has, joined, found = set(w), f" {' '.join(w)} ", {}
    for t in templates:
        posted = sorted(enumerate(re.findall(r"[a-z0-9]+", t.text.lower())), key=lambda x: (-idf[x[1]], x[1], x[0]))
        looked = [(k, x) for k, x in posted if x in has][: licenses.LOOKED_UP]
        if looked and all(f" {p} " in joined for p in t.mandatory):
            best = max(sum(0 <= rel + k < len(w) and w[rel + k] == x for k, x in looked) for rel in range(-60, len(w)))
            if best / len(looked) >= licenses.LINED_UP:
                found[t.label] = best / len(looked)
    base = {label for phrase, label in licenses.PHRASES if f" {phrase} " in joined}
    return sorted(base | set(found)), max([*found.values(), 1.0 if base else 0.0])


def test_labels_against_plain_python(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + CASES
    every = "\n\nThird-party notices. ".join(t.text for t in licenses.TEMPLATES)
    docs += [(1001, every), (1002, "the work is free software " * 3000 + every), (1003, every.replace(" and ", " or "))]
    docs += [(1100 + k, f"See: {t.text}.") for k, t in enumerate(licenses.TEMPLATES)] + [(1200, "This work is licensed elsewhere. GNU General Public License version 3")]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in licenses._tokens(t.text)})
    idf = {r.word: r.idf for r in licenses.template_frequencies(frame, vocabulary).collect()}
    out = licenses.licence_labels(frame).collect()
    got = sorted((repr(r.doc_id), r.labels, round(r.score, 9)) for r in out)
    assert got == sorted((repr(i), labels, round(score, 9)) for i, (labels, score) in ((i, plain_labels(t, licenses.TEMPLATES, idf)) for i, t in docs))
    of = {r.doc_id: r.labels for r in out}
    for k in (1001, 1002):
        assert {t.label for t in licenses.TEMPLATES} <= set(of[k])
    assert all(t.label in of[1100 + k] for k, t in enumerate(licenses.TEMPLATES))
