"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits are a ring of segments. If two fingerprints differ in at most ``distance`` bits, some segment
starts a chain along the ring whose first 1, 2, ... segments differ in at most 1, 2, ... times distance / segments bits;
its first segment therefore differs in at most distance // segments bits, none when there are more segments than
distance. So equal fingerprints collapse, each distinct one is keyed by every segment, and within a key only pairs that
pass the whole chain reach the full Hamming check. A key's block hands on a spanning forest of its links, never all
pairs; a key of many fingerprints is dealt out as pairs of bounded blocks. Components come from stars over the forests.

The pipeline's stage asks for another likeness, Jaccard 0.8 of five-word shingles. That leaves about 10 of 64 SimHash
bits different, more than segments of a useful length allow; so its ring has 64 MinHash slots in place of the bits, of
which the same pair leaves about 13 different, and what the ring lets through is verified on the shingles themselves.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_list, durable, i64, space_words, table, written

BITS = 64
#: Distinct fingerprints that are compared with each other in one block of a key.
BLOCK = 1024
#: The same for shingle sets, which are larger.
SETS = 256
#: Of 64 MinHash slots, those in which a pair of the stage may differ; at Jaccard 0.8 more differ in one pair of a hundred.
SLOTS_APART = 20
_ODD, _SHIFT = np.random.default_rng(10).integers(0, 1 << 63, (2, BITS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``width`` words; all words where there are fewer, none where there are none."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], dtype=np.uint64)


def slots(shingles: np.ndarray) -> np.ndarray:
    """MinHash of a set: for each of 64 hash functions the least value. Two sets agree in a slot as often as their Jaccard
    similarity says."""
    least = np.full(BITS, (1 << 32) - 1, dtype=np.uint32)
    for k in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[k : k + 4096, None] * _ODD + _SHIFT >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return least


def simhash(words: list[bytes], width: int = 3) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values (seed 42); repeats count."""
    h = shingle_hashes(words, width)
    if len(words) <= width:
        return int(h[0]) if words else 0
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > len(h)).tolist())


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fingerprint (a long that holds the 64 bits), one row per row. No words, as in a null: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [simhash(space_words(t), width) for t in byte_list(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(made, dtype=np.uint64).view(np.int64))], names=["doc_id", "fingerprint"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, fingerprint long")


def ring(segments: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def chained(difference: np.ndarray, start: np.ndarray, segments: int, distance: int) -> np.ndarray:
    """Differences (a ^ b) whose chain from segment ``start`` stays within its proportional budgets; the whole ring is the
    last link, so what passes is within ``distance``. Of slots, bit k says whether slot k differs."""
    shift, bits = (np.array(x, dtype=np.uint64) for x in zip(*ring(segments)))
    mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
    ok, total = np.ones(len(difference), dtype=bool), np.zeros(len(difference), dtype=np.int16)
    for step in range(segments):
        at = (start + step) % segments
        total += np.bitwise_count(difference >> shift[at] & mask[at])
        ok &= total * segments <= (step + 1) * distance
    return ok


def linked_pairs(key: np.ndarray, prints: np.ndarray, own: np.ndarray, start: np.ndarray, segments: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one key that pass the chain. ``key`` numbers the groups, whose rows stand together; groups of two
    blocks are met across the blocks only, by ``own``, those of one block (own 0) within. Pairs are taken lag by lag, for
    all groups at once, and none is kept that fails."""
    ends = np.searchsorted(key, key, side="right")
    rows, lag, found = np.arange(len(key)), 1, []
    rows = rows[rows + 1 < ends]
    while len(rows):
        other = rows + lag
        meet = (own[rows] != own[other]) | (own[rows] == 0)
        a, b = rows[meet], other[meet]
        difference = prints[a] ^ prints[b] if prints.ndim == 1 else np.packbits(prints[a] != prints[b], axis=1, bitorder="little").view(np.uint64).ravel()
        ok = chained(difference, start[a], segments, distance)
        found.append(np.stack([a[ok], b[ok]]))
        lag += 1
        rows = rows[rows + lag < ends[rows]]
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    return pairs[0], pairs[1]


def forest(links: list[tuple[int, int]], parent: dict[int, int] | None = None) -> dict[int, int]:
    """node -> smallest reachable node."""
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


def whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and the number of each row's group, of rows that come sorted by ``by``. What is held is a
    batch and the group that it breaks off in."""
    kept: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            part = pa.Table.from_batches([batch])
            kept = part if kept is None else pa.concat_tables([kept, part])
        if kept is None or not len(kept):
            continue
        new = np.zeros(len(kept), dtype=bool)
        for c in by:
            c = kept.column(c).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        key = np.cumsum(new)
        whole = len(kept) if batch is None else int(np.searchsorted(key, key[-1]))
        if whole:
            yield kept.slice(0, whole), key[:whole]
            kept = kept.slice(whole)


def dealt_out(rows: DataFrame, by: list[str], block: int) -> DataFrame:
    """The rows (node and others) of groups of more than one, with i, j and side: a group of one block is met within
    (side 0); of more, each row belongs to one block and goes to that block's pairs, in which side tells the two apart."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block)).drop("n")
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    dealt = rows.join(sizes, by).withColumn("own", own).withColumn("pair", F.explode(others))
    side = F.when(F.col("pair.i") == F.col("pair.j"), 0).otherwise(F.when(F.col("own") == F.col("pair.i"), 1).otherwise(2))
    return dealt.select(*rows.columns, "pair.i", "pair.j", side.alias("side"))


def links(nodes: DataFrame, distance: int = 2, segments: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b) with a > b: per block, stars that connect what is linked directly or through the block.

    ``nodes``: node long and distinct fingerprint, a long of 64 bits or a binary of 64 slots of four bytes. No pair within
    the distance is lost: the forest of a block has the same components as all its links."""
    segments = segments or distance + 1
    if not 0 <= distance < segments <= BITS:
        raise ValueError("the ring needs more segments than bits of distance")
    parts = ring(segments)
    wide = dict(nodes.dtypes)["fingerprint"] == "binary"
    value = lambda shift, bits: F.xxhash64(F.substring("fingerprint", 4 * shift + 1, 4 * bits)) if wide else F.shiftrightunsigned(F.shiftleft("fingerprint", BITS - bits - shift), BITS - bits)
    keyed = nodes.select("node", *([] if wide else ["fingerprint"]), F.posexplode(F.array(*[value(s, b) for s, b in parts])).alias("segment", "value"))
    dealt = dealt_out(keyed.withColumn("segment", F.col("segment").cast("int")), ["segment", "value"], block)
    # Slots are wide, so only keys that nodes share get them.
    dealt = dealt.join(nodes.select("node", "fingerprint"), "node") if wide else dealt

    # Equal keys stand together in a task.
    by = ("segment", "value", "i", "j")
    dealt = dealt.select("node", "fingerprint", *by, "side").repartition(*by).sortWithinPartitions(*by)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, key in whole_groups(batches, by):
            nodes, side, start = (rows.column(c).to_numpy() for c in ("node", "side", "segment"))
            if wide:
                prints = np.frombuffer(b"".join(rows.column("fingerprint").to_pylist()), dtype=np.uint32).reshape(-1, BITS)
            else:
                prints = rows.column("fingerprint").to_numpy().view(np.uint64)
            a, b = linked_pairs(key, prints, side, start, segments, distance)
            # One node's rows of several keys may meet here; a forest over all pairs keeps their components.
            stars = [(x, r) for x, r in forest(np.stack([nodes[a], nodes[b]], axis=1).tolist()).items() if x != r]
            yield pa.RecordBatch.from_arrays([i64([x for x, _ in stars]), i64([r for _, r in stars])], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge, where edges are (a, b) with a > b; component is the smallest
    node reachable. Large-star and small-star in turn until nothing changes; each round is checkpointed."""
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    edges = durable(edges)
    seen = state(edges)
    while seen[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = durable(small.filter("a <> b").distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, segments: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links of at most
    ``distance`` differing bits; one row per row.

    Texts without words have fingerprint zero and are linked like any other. A null doc_id has a fingerprint and links
    like any other, but is nobody's smallest id (null if no id is reachable); repeated rows, and unequal texts under one
    id, each get their own result. Only doc_id and text are read; an empty table gives no rows."""
    prints = durable(fingerprints(docs, width))
    # The nodes are the fingerprints themselves: one id may have several.
    distinct = durable(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")))
    joined = components(links(distinct.select(F.col("fingerprint").alias("node"), "fingerprint"), distance, segments))
    named = distinct.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("fingerprint", "doc_id", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "component").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def shingled(docs: DataFrame, width: int, sets: bool = False) -> DataFrame:
    """The rows with node, a hash of the text's set of shingles, and its MinHash slots or the sorted set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(shingle_hashes(space_words(t), width)) for t in byte_list(batch.column("text"))]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes(), seed=42) for h in made], dtype=np.uint64).view(np.int64)
            what = pa.array([(h if sets else slots(h)).tobytes() for h in made], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), i64(node), what], names=[*kept, "node", name])

    kept, name = [c for c in docs.columns if c != "text"], "shingles" if sets else "fingerprint"
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.mapInArrow(run, ", ".join([*fields, "node long", f"{name} binary"]))


def alike(members: DataFrame, similarity: float, block: int = SETS) -> DataFrame:
    """(a, b) with a > b: forests over the pairs of a component whose sets have at least this Jaccard similarity.
    ``members``: component, node and shingles. Pairs that others connect already are not compared."""
    by = ("component", "i", "j")
    dealt = dealt_out(members.select("component", "node"), ["component"], block).join(members.select("node", "shingles"), "node")
    dealt = dealt.select("node", *by, "side", "shingles").repartition(*by).sortWithinPartitions(*by)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, key in whole_groups(batches, by):
            nodes, side, found = rows.column("node").to_pylist(), rows.column("side").to_pylist(), []
            sets = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("shingles").to_pylist()]
            edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1)).tolist()
            for start, end in itertools.pairwise(edges):
                root, parts = list(range(end - start)), end - start
                for lag in range(1, end - start):
                    for x in range(start, end - lag):
                        y = x + lag
                        ra, rb = root[x - start], root[y - start]
                        if ra == rb or (side[x] and side[x] == side[y]):
                            continue
                        n, m = len(sets[x]), len(sets[y])
                        if min(n, m) < similarity * max(n, m) * (1 - 1e-9):
                            continue
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if both / (n + m - both) >= similarity:
                            found.append((max(nodes[x], nodes[y]), min(nodes[x], nodes[y])))
                            root, parts = [ra if r == rb else r for r in root], parts - 1
                    if parts == 1:
                        break
            yield pa.RecordBatch.from_arrays([i64([a for a, _ in found]), i64([b for _, b in found])], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, distance: int = SLOTS_APART) -> DataFrame:
    """doc_id, node (the text's set of shingles) and group, one row per row with an id: groups are joined by pairs of at
    least this Jaccard similarity. Texts of equal sets are one node, those without words too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    made = written(shingled(docs, width))
    nodes = written(made.groupBy("node").agg(F.first("fingerprint").alias("fingerprint"), F.min("doc_id").alias("doc_id")))
    near = components(links(nodes, distance)).select(F.col("node").alias("of"), "component")
    near = near.union(near.select("component", "component").distinct())  # the smallest node of each has no row of its own
    # Their texts, by the smallest id of each, which may have other texts, too.
    near = durable(near.join(nodes.select(F.col("node").alias("of"), "doc_id"), "of"))
    texts = shingled(docs.join(near.select("doc_id").distinct(), "doc_id", "left_semi"), width, sets=True).drop("doc_id").dropDuplicates(["node"])
    members = written(texts.join(near, texts["node"] == near["of"]).select("component", "node", "shingles"))
    joined = components(alike(members, similarity))
    return made.select("doc_id", "node").join(joined, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("group"))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of one document of each group of near copies, the one with the smallest doc_id; one row of those that
    repeat it. An id that is repeated with other texts has a decision for each. Rows without an id belong to no group
    and stay. Columns stay as they are."""
    found = durable(near_copies(docs, width, similarity))
    best = F.min(F.struct("doc_id", "node"))
    stay = durable(found.groupBy("group").agg(best.alias("best")).select("best.*"))
    repeats = durable(found.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    # Of an id that stands once, the row is known by it; the rows of others are told apart by their text.
    gone = found.select("doc_id").join(stay, "doc_id", "left_anti").union(repeats).distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    if repeats.isEmpty():
        return kept
    again = docs.join(repeats, "doc_id", "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    again = shingled(again, width).join(stay, ["doc_id", "node"], "left_semi").dropDuplicates(["doc_id", "node"])
    return kept.unionByName(again.select("row.*"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL: dict[str, str] = {}
