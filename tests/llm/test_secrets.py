import hashlib
import re

import pytest
from pyspark.sql import functions as F

from astroloom.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, blob string, findings string"
TOKEN = "AKIA" + "A1" * 8


def brute(text):
    """The base spans straight from their wording."""
    found = []
    rules = [
        (re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        (re.compile("[0-9a-f]+"), 0, 24),
    ]
    for k, (pattern, group, least) in enumerate(rules):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(found))


def rows(spark, values):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y") for i, t in values], SCHEMA)


CASES = [
    (1, None), (2, ""), (3, "plain words"), (4, 'Token = "abcdef0123"'), (5, "é password=short1 token: abc"), (6, f"{TOKEN} {TOKEN} AKIASHORT"),
    (7, "0123456789abcdef01234567"), (8, "ſecret=abcdef toKen=abcdefg"), (9, "x" * 200_000 + " secret: abcdef"), (None, "api_key=abcdefgh"), (4, 'Token = "abcdef0123"'),
    (10, "Bearer abcdefghijklmnopqrstuvwxyz"),
]


def test_base_spans(spark):
    out = secrets.digest(secrets.scan_corpus(rows(spark, CASES))).collect()
    assert len(out) == len(CASES)
    texts = {i: t or "" for i, t in CASES}
    for r in out:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [want.count(f"{k}:") for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert next(r.spans for r in out if r.doc_id == 10).startswith("bearer:")


def test_corpus(spark, small):
    out = {r.doc_id: r.base_sha256 for r in secrets.op2_secrets(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert out == {r.doc_id: hashlib.sha256(brute(r.text or "").encode()).hexdigest() for r in docs}


def test_ledger_scans_only_unseen(spark):
    old, new = rows(spark, [(1, "secret=abcdef"), (2, "clean")]), rows(spark, [(3, "secret=abcdef"), (4, "fresh token=abcdef")])
    ledger = secrets.scan_unseen(old)
    added = secrets.scan_unseen(old.union(new), ledger)
    assert [r.blob for r in added.collect()] == [hashlib.sha256(b"fresh token=abcdef").hexdigest()]
    both = secrets.findings_by_path(old.union(new), ledger.union(added))
    assert {r.doc_id: len(r.findings) for r in both.select("doc_id", "findings").collect()} == {1: 1, 2: 0, 3: 1, 4: 1}
    other = secrets.RULES[:1]
    assert secrets.scan_unseen(old, ledger, other).count() == 2  # another rule version has seen nothing


def test_redact(spark):
    frame = rows(spark, CASES)
    for ledger in (None, secrets.scan_unseen(frame.filter("doc_id = 4"))):
        out = secrets.redact(frame, ledger)
        assert out.columns == frame.columns and out.count() == len(CASES)
        texts = {r.doc_id: r.text for r in out.collect()}
        assert texts[4] == "[secret]\"" and texts[3] == "plain words" and texts[1] is None and texts[2] == ""
        assert texts[9] == "x" * 200_000 + " [secret]"


def test_redact_keeps_clashing_columns(spark):
    frame = rows(spark, CASES).withColumns({c: F.col("doc_id") for c in ("_blob", "_FINDINGS", "blob", "findings", "kind")})
    plain = {r.doc_id: r.text for r in secrets.redact(rows(spark, CASES)).collect()}
    out = secrets.redact(frame)
    assert out.columns == frame.columns
    assert all(r.text == plain[r.doc_id] and list(r)[-5:] == [r.doc_id] * 5 for r in out.collect())


@pytest.mark.parametrize("n", [0])
def test_empty_table(spark, n):
    assert secrets.digest(secrets.scan_corpus(rows(spark, CASES).filter(F.lit(False)))).count() == n


def test_long_runs_take_linear_time():
    import time

    for text in ("eyJ" * 1_700_000, "eyJabcdefgh." * 400_000, "-----BEGIN " * 400_000, "bearer " * 700_000, "token" + " " * 5_000_000):
        began = time.perf_counter()
        secrets.scan_text(text)
        assert time.perf_counter() - began < 20
    assert [k for k, _, _ in secrets.scan_text("x eyJhbGciOiJI.eyJzdWIiOiIx.sig-_1 y")] == ["jwt"]
