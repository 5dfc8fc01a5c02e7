"""Secret scanning over every stored version of a corpus, as an incremental blob ledger.

Each version of a text is addressed by the SHA-256 of its content. Only (blob, rule version) pairs that the ledger
has not seen are scanned; the findings are kept in the ledger per blob and joined back to every path that holds it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unused

# The base rules, in the order in which ties of a start are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"


@dataclass(frozen=True)
class Rule:
    """kind, pattern, what must occur for the pattern to match (lower case; none: always tried), the group whose
    length counts, its least length, whether the pattern's ASCII letters match in either case."""

    kind: str
    pattern: str
    needs: tuple[bytes, ...] = ()
    group: int = 0
    least: int = 0
    any_case: bool = False


BASE_RULES = (
    Rule("assign", ASSIGN, (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), 2, 6, True),
    Rule("access", ACCESS, (b"akia",), 0, 20),
    # Runs of 24 and more are what is left of all runs once the short ones are dropped.
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Spans that the operator adds to the base ones.
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", (b"private key",)),
    # From the start of a run only, and runs are not given back: each character is read a fixed number of times.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]+", (b"eyj",)),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{16,}=*", (b"bearer ",), any_case=True),
    Rule("hosted", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", (b"gh", b"xox", b"sk_live_")),
)
RULES = BASE_RULES + EXTRA_RULES
FINDING = "array<struct<kind:string,start:int,end:int>>"


def rule_version(rules: tuple[Rule, ...]) -> str:
    """A rule set's version is its content: any edit makes every blob unseen again."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then in the rules' order."""
    low, found = text.encode().lower(), []
    for order, rule in enumerate(rules):
        if rule.needs and not any(x in low for x in rule.needs):
            continue
        for m in re.finditer(rule.pattern, text, re.ASCII | re.IGNORECASE if rule.any_case else re.ASCII):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def _scanner(rules: tuple[Rule, ...]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan_text(t or "", rules)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, type=kind)], names=["blob", "findings"])

    return scan


def address(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``blob``, the SHA-256 of the text's UTF-8 bytes; a null text is the empty blob."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule_version, findings) for the (blob, rule version) pairs that the ledger lacks.

    Copies collapse before the shuffle (a partial aggregate by address), so a group of copies, however large, is one
    scan and one row. Blobs without findings are ledger rows too: they need no second scan."""
    version = rule_version(rules)
    blobs = address(versions.select(F.coalesce(F.col(text), F.lit("")).alias("text"))).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    found = blobs.mapInArrow(_scanner(rules), f"blob string, findings {FINDING}")
    return found.select("blob", F.lit(version).alias("rule_version"), "findings")


def findings_by_path(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Every row of ``versions`` without its text, with ``findings`` of its blob. The ledger has one row per blob and
    rule version, so the join keeps the number of rows; columns named blob or findings are replaced. The shared blobs' side may be split by Spark's skew join."""
    known = ledger.filter((F.col("rule_version") == rule_version(rules)) & (F.size("findings") > 0)).select("blob", "findings")
    paths = address(versions, text).drop(text, "findings")
    return paths.join(known, "blob", "left").withColumn("findings", F.coalesce("findings", F.array().cast(FINDING)))


def digest(findings: DataFrame) -> DataFrame:
    """The base kinds' counts and hash, and all spans as text."""
    kinds = [r.kind for r in BASE_RULES]
    of = lambda kind: F.filter("findings", lambda x: x["kind"] == kind)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return findings.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(joined(F.filter("findings", lambda x: x["kind"].isin(kinds))).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )


def scan_corpus(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the findings of each row, from an empty ledger. Nulls: an empty text has no findings; a null doc_id
    stays a row of its own. Repeated rows each get their result; other columns are not read."""
    docs = docs.select("doc_id", "text")
    return findings_by_path(docs, scan_unseen(docs, None, rules), rules)


def redact(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """The rows with every found span replaced by ``mask``; columns, whatever their names, and rows stay, and overlapping spans become one.

    Each distinct text that the ledger has not seen is scanned once; its findings meet all rows that hold it."""
    known = scan_unseen(docs, ledger, rules)
    if ledger is not None:
        known = known.unionByName(ledger.filter(F.col("rule_version") == rule_version(rules)).select(*known.columns))
    names, blob, findings = docs.columns, unused(docs, "_blob"), unused(docs, "_findings")
    known = known.filter(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(findings))
    rows = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).join(known, blob, "left").drop(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, found = batch.schema.get_field_index("text"), batch.column(findings).to_pylist()
            out = [t if not f or t is None else _masked(t, [(x["kind"], x["start"], x["end"]) for x in f], mask) for t, f in zip(batch.column(k).to_pylist(), found, strict=True)]
            batch = batch.set_column(k, batch.schema.field(k), pa.array(out, type=batch.schema.field(k).type))
            yield batch.select(names)

    return rows.select(*names, findings).mapInArrow(run, docs.schema)


def _masked(text: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    parts, at = [], 0
    for _, start, end in spans:
        if start >= at:
            parts += [text[at:start], mask]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_corpus(table(spark, sf_dir, "documents")))


QUERIES = {"op2_secrets": op2_secrets}
ORACLE_SQL: dict[str, str] = {}
