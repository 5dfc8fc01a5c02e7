"""URL filters: longest-match host and path rules, and exact list membership by a Bloom filter cascade.

The cascade needs the complete key universe of the corpus. Level 1 encodes the listed keys, level 2 the keys that are
not listed and pass level 1, level 3 the listed keys that pass level 2, and so on until no key is wrong; a key's verdict
is the parity of the levels that it passes, exact for every key of the universe. Keys are cut by hash into shards of
bounded size, each with a cascade of its own, so no level is ever built or held whole in one place. The filter is applied
row by row: no join, as long as the shards together pass the checked size bound. Beyond it the rows are dealt out by shard,
in parts where a shard has many rows, and each part reads its shard's levels once, ahead of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table, unused

# Fixed values: (verdict, host, path) rules of the page query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of a shard on average, and bytes of all shards up to which they are broadcast.
SHARD_KEYS = 50_000
BROADCAST_BYTES = 64_000_000
#: Rows that meet one copy of their shard's levels; a shard with more is read in parts.
PART_ROWS = 2_000_000
HASHES = 5


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/ ? #`` or end, A-Z lower-cased) and path (then up to ``? #`` or end)."""
    column = F.col(url)
    at = F.instr(column, "://")
    rest = F.coalesce(F.when(at > 0, column.substr(at + 3, F.length(column))), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the host or a parent domain and whose path starts the path; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(of + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _places(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    """HASHES bit places of each 64-bit hash, by double hashing; each level mixes differently."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03) * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        step = (x >> np.uint64(32)) | np.uint64(1)
        return (x[:, None] + np.arange(HASHES, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)


def _passes(level: int, filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _places(hashes, level, 8 * len(filled))
    return (filled[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


def build_levels(listed: np.ndarray, others: np.ndarray) -> list[bytes]:
    """The levels' bits for 64-bit hashes of listed and other keys, which are disjoint."""
    levels: list[bytes] = []
    inside, outside = listed, others
    while len(inside):
        # The rarer the listed keys are, the more bits each gets on the first level, so that few others pass it.
        bits = 7 if levels else max(7.0, 1.44 * np.log2(1.5 * max(1.0, len(outside) / len(inside))))
        filled = np.zeros(int(bits * len(inside)) // 8 + 1, dtype=np.uint8)
        at = _places(inside, len(levels), 8 * len(filled)).ravel()
        np.bitwise_or.at(filled, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        outside = outside[_passes(len(levels), filled, outside)] if len(outside) else outside
        levels.append(filled.tobytes())
        inside, outside = outside, inside
    return levels


def member(levels: list[bytes], hashes: np.ndarray) -> np.ndarray:
    """Whether each hash is listed: the first level that it fails has an odd number, counted from zero."""
    out, open_ = np.zeros(len(hashes), dtype=bool), np.arange(len(hashes))
    for k, level in enumerate(levels):
        passed = _passes(k, np.frombuffer(level, dtype=np.uint8), hashes[open_])
        out[open_[~passed]] = k % 2 == 1
        open_ = open_[passed]
    out[open_] = len(levels) % 2 == 1
    return out


class BloomCascade:
    """Exact membership of a universe's keys in a listed part of it.

    ``keys``: DataFrame (key string, listed boolean), each key once, no nulls. Two keys of the universe with equal
    64-bit hashes could not be told apart, so each hash of a key that meets another verdict under the same hash is kept
    by name in ``clashes`` (none are expected below billions of keys)."""

    def __init__(self, keys: DataFrame):
        keys = durable(keys.select("key", "listed"))
        n = keys.count()
        self.shards = 1 + n // SHARD_KEYS
        hashed = keys.select("key", "listed", F.xxhash64("key").alias("h"))
        self.table = durable(
            hashed.select(F.pmod("h", F.lit(self.shards)).alias("shard"), "h", "listed").groupBy("shard").applyInPandas(self._build, "shard long, level int, bits binary")
        )
        clash = hashed.groupBy("h").agg(F.min("listed").alias("a"), F.max("listed").alias("b"), F.sum(F.when(F.col("listed"), F.length("key")).otherwise(0)).alias("size"))
        clash = hashed.join(clash.filter("a <> b").select("h"), "h", "left_semi").filter("listed").select("key")
        self.clashes = durable(clash)
        self.bytes = self.table.agg(F.sum(F.length("bits"))).first()[0] or 0

    @staticmethod
    def _build(shard: pd.DataFrame) -> pd.DataFrame:
        h, listed = shard["h"].to_numpy(), shard["listed"].to_numpy().astype(bool)
        levels = build_levels(h[listed], np.setdiff1d(h[~listed], h[listed]))
        return pd.DataFrame({"shard": np.full(len(levels), shard["shard"].iloc[0], dtype=np.int64), "level": np.arange(len(levels), dtype=np.int32), "bits": levels})

    def mark(self, rows: DataFrame, key: str, into: str) -> DataFrame:
        """Adds ``into``: whether the row's key is listed. Nulls are not; keys outside the universe get either answer."""
        h, clash = unused(rows, "h"), unused(rows, "clash")
        rows = rows.withColumn(h, F.xxhash64(key))
        rows = self._looked_up(rows, h, into) if self.bytes <= BROADCAST_BYTES else self._met(rows, h, into)
        if not self.clashes.isEmpty():
            rows = rows.join(self.clashes.select(F.col("key").alias(key), F.lit(True).alias(clash)), key, "left").withColumn(into, F.col(into) | F.coalesce(clash, F.lit(False))).drop(clash)
        return rows.withColumn(into, F.col(key).isNotNull() & F.col(into)).drop(h)

    def _looked_up(self, rows: DataFrame, h: str, into: str) -> DataFrame:
        shards, levels = self.shards, {}
        for r in self.table.orderBy("shard", "level").collect():
            levels.setdefault(r.shard, []).append(bytes(r.bits))
        shared = rows.sparkSession.sparkContext.broadcast(levels)

        @F.pandas_udf("boolean")
        def listed(h: pd.Series) -> pd.Series:
            hashes = h.to_numpy()
            out, of = np.zeros(len(hashes), dtype=bool), hashes % shards
            for k in np.unique(of):
                out[of == k] = member(shared.value.get(int(k), []), hashes[of == k])
            return pd.Series(out)

        return rows.withColumn(into, listed(h))

    def _met(self, rows: DataFrame, h: str, into: str) -> DataFrame:
        """Rows and levels sorted by shard and part, a part's levels first; a task holds one shard's levels at a time. Rows
        take a part by the hash of all that they hold, so a row that is computed again goes where it went before."""
        schema = rows.withColumn(into, F.lit(True)).schema
        shard, part, level, bits, parts = (unused(rows, c) for c in ("shard", "part", "level", "bits", "parts"))
        whole = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
        rows = rows.withColumn(shard, F.pmod(h, F.lit(self.shards)))
        hot = rows.groupBy(shard).count().filter(F.col("count") > PART_ROWS).select(shard, F.ceil(F.col("count") / PART_ROWS).alias(parts))
        hot = durable(hot)
        rows = rows.join(hot, shard, "left").withColumn(part, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in whole]), F.coalesce(parts, F.lit(1)))).drop(parts)
        levels = self.table.select(F.col("shard").alias(shard), F.col("level").alias(level), F.col("bits").alias(bits), F.lit(0).cast("long").alias(h)).join(hot, shard, "left")
        levels = levels.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
        both = rows.unionByName(levels, allowMissingColumns=True).repartition(shard, part).sortWithinPartitions(shard, part, F.col(level).asc_nulls_last())

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, held = None, []
            for batch in batches:
                of, parts_, hashes = (batch.column(c).to_numpy() for c in (shard, part, h))
                is_row = batch.column(level).is_null().to_numpy(zero_copy_only=False)
                out = np.zeros(batch.num_rows, dtype=bool)
                cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(parts_) != 0)) + 1
                for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
                    if a == b:
                        continue
                    if (of[a], parts_[a]) != current:
                        current, held = (of[a], parts_[a]), []
                    k = b - int(is_row[a:b].sum())
                    held += batch.column(bits).slice(a, k - a).to_pylist()
                    out[k:b] = member(held, hashes[k:b])
                columns = [batch.column(c) if c != into else pa.array(out) for c in schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(is_row))

        return both.mapInArrow(answer, schema)


def insecure_hosts(pages: DataFrame) -> DataFrame:
    """The page query's list and its universe: every host, listed if none of its urls is https."""
    host, _ = url_parts("url")
    return pages.select(host.alias("key"), F.col("url").startswith("https://").alias("safe")).filter("key <> ''").groupBy("key").agg(
        (~F.max(F.coalesce("safe", F.lit(False)))).alias("listed")
    )


def judge(pages: DataFrame, rules: tuple = RULES, keys: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each row: the longest rule's, else block for a listed host, else allow.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Repeated rows each get
    their verdict; an empty table gives none; only page_id and url are read."""
    host, path = url_parts("url")
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    marked = BloomCascade(insecure_hosts(pages) if keys is None else keys).mark(rows, "host", "listed")
    return marked.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_HOST = f"translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}')"
_FIT = lambda host, path: f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"
_LONGEST = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1:]))
OP4_SQL = f"""
WITH rests AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
listed AS (SELECT host FROM parts WHERE host <> '' GROUP BY host HAVING NOT max(starts_with(url, 'https://')))
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FIT(h, p)} THEN '{h}{p}'" for _, h, p in _LONGEST)} END AS rule,
  CASE {" ".join(f"WHEN {_FIT(h, p)} THEN '{v}'" for v, h, p in _LONGEST)}
    WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""
QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {"op4_url_filter": OP4_SQL}
