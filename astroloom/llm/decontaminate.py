"""Benchmark decontamination as a prefix-filtered set join.

An item's windows of ten words are sets of positional two-word shingles. Their document frequencies in the corpus order
the shingles by rarity; full containment makes the rarest shingle a window's whole necessary prefix, so a document can
hold a window only where it holds that shingle. Each such place fixes the alignment: it must lie inside the document
(length and positional bounds), and the ten words are then compared one by one.

One way serves any number of items. A scan of the documents tests its shingles against a bit filter of bounded size
before any of them leaves the task; what passes meets the exact shingles in a join, along with the words around it, so
that no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BYTES, alnum_words, byte_list, i64, table, unused, written

WINDOW = 10
#: Bits of the filter that all tasks hold are at most two to this power (64 MB). Where many more shingles are wanted than
#: it can tell apart, more pass it that the join then drops; the rows stay the same.
FILTER_LOG = 29
SHIFTS = (0, 17, 35)
#: Words whose hashes a task keeps, words (of whole texts) that are tested together, and places that are handed on at once.
KEPT_WORDS, GROUP_WORDS, KEPT_PLACES = 1 << 20, 50_000, 10_000
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of ``size`` consecutive words; all words where there are fewer, none where there are none."""
    return [tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []


class Shingles(dict):
    """Hashes of two-word shingles, and of single words, from the words' own hashes, which are kept."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes], single: bool) -> tuple[np.ndarray, np.ndarray]:
        """The hashes and their places: every pair of neighbours and, if ``single``, every word, after the pairs. Two
        shingles with one hash cost a comparison, no result."""
        pairs, alone = self._hashes([words], single)
        return np.concatenate([pairs, alone]), np.concatenate([np.arange(len(pairs)), np.arange(len(alone))])

    def passing(self, texts: list[list[bytes]], single: bool, wanted: ShingleFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and hash of those shingles of several texts that pass the filter; none reaches over a text's end."""
        n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(n)
        found = []
        for hashes, length in zip(self._hashes(texts, single), (2, 1), strict=True):
            at = wanted.passing(hashes)
            text = np.searchsorted(ends, at, side="right")
            inside = at + length <= ends[text]
            at, text = at[inside], text[inside]
            found.append((text, at - (ends - n)[text], hashes[at]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _hashes(self, texts: list[list[bytes]], single: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of all neighbours in the texts laid end to end, and of all words if ``single``."""
        if len(self) > KEPT_WORDS:
            self.clear()
        h = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), dtype=np.uint64, count=sum(map(len, texts)))
        return _mixed(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]), _mixed(h[: len(h) * single] ^ np.uint64(0xD1B54A32D192ED03))


def _grouped(texts: Iterable[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The texts' words, some texts at a time, with the number of the first of them."""
    first, group, n = 0, [], 0
    for text in texts:
        group.append(alnum_words(text))
        n += len(group[-1])
        if n >= GROUP_WORDS:
            yield first, group
            first, group, n = first + len(group), [], 0
    if group:
        yield first, group


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class ShingleFilter:
    """Bits at three places for each hash of a set: passes all of them, and few others. Its size is bounded."""

    def __init__(self, hashes: DataFrame):
        self.log = min(FILTER_LOG, max(10, (64 * hashes.count()).bit_length()))
        places = F.array(*[F.shiftrightunsigned("shingle", s).bitwiseAND(F.lit((1 << self.log) - 1)) for s in SHIFTS])
        filled = hashes.select(F.explode(places).alias("p")).groupBy(F.shiftrightunsigned("p", 6).alias("word"))
        filled = filled.agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits")).toArrow()
        self.bits = np.zeros(max(1, (1 << self.log) >> 6), dtype=np.uint64)
        self.bits[filled.column("word").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that pass."""
        left = np.flatnonzero(self._filled(hashes >> np.uint64(SHIFTS[0])))
        for shift in SHIFTS[1:]:
            left = left[self._filled(hashes[left] >> np.uint64(shift))]
        return left

    def _filled(self, places: np.ndarray) -> np.ndarray:
        at = places & np.uint64((1 << self.log) - 1)
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def merged(found: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order; those that overlap or touch are one."""
    spans: list[list[int]] = []
    for start, end in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [(a, b) for a, b in spans]


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (array of start and end in words) and items (sorted strings), one row per document.

    Null and empty texts have no words, so nothing hits them; null items and items without words occur nowhere; items
    with equal texts are all reported. Rows with equal or null doc_id stay apart. Only doc_id and text are read."""
    of, prefix, single = _prefixes(docs, items, size)
    seen = _places(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "row", prefix, single, size)
    hits = _verified(seen, "row", prefix)
    named = hits.select("row", "window").distinct().join(of, "window").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = seen.filter("shingle IS NULL").select("row", "doc_id", "n_words").join(_spans(hits, "row"), "row", "left").join(named, "row", "left")
    empty = F.array().cast("array<struct<start:int,end:int>>"), F.array().cast("array<string>")
    return found.select("doc_id", "n_words", F.coalesce("spans", empty[0]).alias("spans"), F.coalesce("items", empty[1]).alias("items"))


def _prefixes(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame, bool]:
    """(item_id, window), (window, shingle, offset) of each window's rarest shingle, and whether a window is one word."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), byte_list(batch.column("text")), strict=True):
                made = windows_of(alnum_words(text), size)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(made), type=pa.string()), pa.array(made, type=pa.list_(pa.binary()))], names=["item_id", "window"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shingles()
        for batch in batches:
            for window in batch.column("window").to_pylist():
                hashes, at = known.of(window, len(window) == 1)
                made = pa.array([window] * len(at), type=pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([made, i64(hashes.view(np.int64)), i64(at)], names=["window", "shingle", "at"])

    of = written(items.mapInArrow(cut, "item_id string, window array<binary>").distinct())
    mine = written(of.select("window").distinct().mapInArrow(spell, "window array<binary>, shingle long, at long"))
    single = not mine.filter(F.size("window") == 1).isEmpty()
    counted = _document_frequencies(docs, ShingleFilter(mine.select("shingle").distinct()), single)
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "at")).alias("x")
    prefix = mine.join(counted, "shingle", "left").groupBy("window").agg(rarest).select("window", "x.shingle", F.col("x.at").alias("offset"))
    return of, written(prefix), single


def _document_frequencies(docs: DataFrame, wanted: ShingleFilter, single: bool) -> DataFrame:
    """(shingle, df): in how many documents of the whole table each shingle occurs that passes the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shingles()
        for batch in batches:
            found = [np.empty(0, dtype=np.uint64)]
            for _, texts in _grouped(byte_list(batch.column("text"))):
                text, _, hashes = known.passing(texts, single, shared.value)
                order = np.lexsort((text, hashes))
                text, hashes = text[order], hashes[order]
                once = np.ones(len(hashes), dtype=bool)
                once[1:] = (np.diff(text) != 0) | (np.diff(hashes) != 0)
                found.append(hashes[once])
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([i64(values.view(np.int64)), i64(n)], names=["shingle", "n"])

    return docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df"))


def _places(docs: DataFrame, key: str, prefix: DataFrame, single: bool, size: int) -> DataFrame:
    """A row with ``key``, doc_id and n_words for each document, and one with ``key``, shingle and at for each place whose
    shingle passes the filter of the prefixes, with the words ``near`` it, which begin at ``first``. Written once."""
    shared = docs.sparkSession.sparkContext.broadcast(ShingleFilter(prefix.select("shingle").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shingles()
        names = [key, "doc_id", "n_words", "shingle", "at", "first", "near"]

        def rows(batch: pa.RecordBatch, of: list[tuple]) -> pa.RecordBatch:
            k, whole, n, shingle, at, first, near = zip(*of, strict=True) if of else [()] * 7
            ids = [batch.column(key).take(pa.array(k, type=pa.int64())), batch.column("doc_id").take(pa.array(whole, type=pa.int64()))]
            return pa.RecordBatch.from_arrays([*ids, i64(n), i64(shingle), i64(at), i64(first), pa.array(near, type=pa.list_(pa.binary()))], names=names)

        for batch in batches:
            out: list[tuple] = []
            for begin, texts in _grouped(byte_list(batch.column("text"))):
                out += [(begin + k, begin + k, len(words), None, None, None, None) for k, words in enumerate(texts)]
                text, places, hashes = known.passing(texts, single, shared.value)
                for k, at, shingle in zip(text.tolist(), places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                    first = max(0, at - size + 1)
                    out.append((begin + k, None, None, shingle, at, first, texts[k][first : at + size]))
                    if len(out) >= KEPT_PLACES:
                        yield rows(batch, out)
                        out = []
            yield rows(batch, out)

    ids = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, "doc_id"))
    return written(docs.mapInArrow(run, f"{ids}, n_words long, shingle long, at long, first long, near array<binary>"))


def _verified(seen: DataFrame, key: str, prefix: DataFrame) -> DataFrame:
    """(key, start, end, window): the places at which a window stands word by word. A shingle that many places hold is a
    skewed key of rows and few windows, which the join splits."""
    start, words = F.col("at") - F.col("offset"), F.size("window")
    same = F.slice("near", F.greatest(start - F.col("first") + 1, F.lit(1)).cast("int"), words) == F.col("window")
    met = seen.filter("shingle IS NOT NULL").join(prefix, "shingle").filter((start >= 0) & same)
    return written(met.select(key, start.cast("int").alias("start"), (start + words).cast("int").alias("end"), "window").distinct())


def _spans(hits: DataFrame, key: str) -> DataFrame:
    """(key, spans): the hit words of each document, in order; spans that overlap or touch are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in merged((s["start"], s["end"]) for s in of)] for of in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(spans, type=SPANS)], names=[key, "spans"])

    found = hits.groupBy(key).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return found.mapInArrow(run, f"`{key}` {hits.schema[key].dataType.simpleString()}, spans array<struct<start:int,end:int>>")


def drop_hit_words(docs: DataFrame, items: DataFrame, share: float = 0.5, size: int = WINDOW) -> DataFrame:
    """Removes documents of whose words more than ``share`` are hit; cuts the hit words out of the others, along with
    what stands between them. Columns and the other texts stay as they are. All hits are found on the whole texts,
    judged together and cut out at once; a text's hits follow from the text, so its sha256 is what they are joined by."""
    key, spans = unused(docs, "key"), unused(docs, "spans")
    _, prefix, single = _prefixes(docs, items, size)
    keyed = docs.filter(F.col("text").isNotNull()).select(F.sha2("text", 256).alias(key), F.lit(None).cast("long").alias("doc_id"), "text")
    hits = written(_spans(_verified(_places(keyed, key, prefix, single, size), key, prefix), key)).withColumnRenamed("spans", spans)
    met = docs.withColumn(key, F.sha2("text", 256)).join(hits, key, "left").select(*docs.columns, spans)
    return _cut(met, spans, share)


def _cut(docs: DataFrame, given: str, share: float) -> DataFrame:
    """Rejects and cuts by the spans in the column ``given``, which goes; null where nothing is hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts, keep = batch.column(k).to_pylist(), []
            for i, found in enumerate(batch.column(given).to_pylist()):
                spans = [(s["start"], s["end"]) for s in found or ()]
                hit = sum(b - a for a, b in spans)
                keep.append(not hit or hit <= share * len(alnum_words(texts[i].encode())))
                if hit and keep[-1]:
                    texts[i] = _without(texts[i], spans)
            batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, type=batch.schema.field(k).type)).drop_columns([given])
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.drop(given).schema)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans``, each cut from its first word's start to its last word's end."""
    raw = text.encode()
    plain = raw.translate(WORD_BYTES)
    bounds, at = [], 0
    for word in plain.split():
        start = plain.index(word, at)
        at = start + len(word)
        bounds.append((start, at))
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : bounds[a][0]])
        last = bounds[b - 1][1]
    return b"".join([*out, raw[last:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {"op8_decontamination": op8_decontamination}
ORACLE_SQL: dict[str, str] = {}
