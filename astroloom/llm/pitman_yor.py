"""Language-model scoring with a hierarchical Pitman-Yor model.

Every previous word (or the start of a text) is a context with a restaurant of its own, in which the words that followed
it are seated. Its tables are the customers of the restaurant that all contexts share; each of that one's tables orders
a spelling, and spellings are byte after byte from restaurants of ever shorter contexts (three, two, one and no
preceding bytes), where the tables of a context are the customers of the shorter context that it shares with others.
The seatings are drawn by blocked Gibbs sampling, restaurant after restaurant: all pairs of a context and a word that
occur more than once are seated together given the words' probabilities and the contexts' tables of the last sweep, then
all words of the vocabulary given the contexts' new tables, the spelling model and the number of tables of the last
sweep, then the byte contexts given the spellings that the words' tables order. The predictive probabilities of several
sweeps are averaged. Discounts are estimated from the pairs and words that occur once and twice, strengths are fixed.
Contexts are drawn with ``Sampling(draw_contexts=True)``, as op9 does; without it each pair keeps one table.

Nothing that grows with the corpus passes through the driver, but for the words that make up a large share of the
tokens. Texts are tokenised once into blocks with a dictionary each. A word belongs to a part by its hash. A block tells
each part the words of that part and the words before them, by hashes of 20 bits more than the corpus has bytes, so that
fewer than one pair in a million meets another at any size; the words themselves are compared whole. The part counts the
pairs and keeps where each block's pairs and words stand in its own order. In a sweep parts and homes exchange the
repeated pairs' words alone, and at the end each block is answered by lists in the order of its own. The pairs of a
frequent word are shared by several parts, which ask its home for its probability. The byte contexts are folded to a
fixed number, which bounds the spelling table (8.4 MB a sweep) whatever the corpus.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_list, bytes_column, f64, fold, i64, shared_dir, space_words, table

#: The end of a text, a token that no word can equal.
END = b"\n"
#: Symbols: bytes and the end of a spelling. Contexts: the last byte, and the two before it folded.
SYMBOLS = 257
FOLDS = (256, 8, 4)
CONTEXTS = [int(np.prod(FOLDS[:k])) for k in range(4)]
#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000


@dataclass(frozen=True)
class Sampling:
    burn_in: int = 1
    kept: int = 2
    byte_discount: float = 0.5
    byte_strength: float = 2.0
    word_strength: float = 10.0
    context_strength: float = 1.0
    seed: int = 11
    #: Whether the tables of a repeated pair are drawn in its context; if not, it keeps one.
    draw_contexts: bool = False


def uniforms(dish: np.ndarray, salt: int) -> np.ndarray:
    """A number between 0 and 1 for each dish (64-bit hashes) and salt: the same wherever and whenever it is drawn."""
    x = dish.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def binomials(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Draws of n trials by inversion at u; by the normal curve, rounded, where the mean and its complement exceed 50."""
    p = np.clip(p, 0, 1 - 1e-12)
    out, many = np.zeros(len(n)), (n * p > 50) & (n * (1 - p) > 50)
    if many.any():
        out[many] = np.clip(np.rint(n[many] * p[many] + np.sqrt(n[many] * p[many] * (1 - p[many])) * _normal(u[many])), 0, n[many])
    turn = p > 0.5  # fewer steps from the other end
    n, q, at = n[~many], np.where(turn, 1 - p, p)[~many], np.flatnonzero(~many)
    mass, odds, k = np.exp(n * np.log1p(-q)), q / (1 - q), np.zeros(len(n))
    total, open_ = mass.copy(), np.arange(len(n))
    while len(open_ := open_[(u[at[open_]] > total[open_]) & (k[open_] < n[open_])]):
        mass[open_] *= (n[open_] - k[open_]) / (k[open_] + 1) * odds[open_]
        k[open_] += 1
        total[open_] += mass[open_]
    out[at] = np.where(turn[at], n - k, k)
    return out


def _normal(u: np.ndarray) -> np.ndarray:
    """Normal quantiles by the logistic curve with a cubic correction, to a few thousandths of a deviation."""
    z = np.log(np.clip(u, 1e-12, 1 - 1e-12) / (1 - np.clip(u, 1e-12, 1 - 1e-12)))
    x = z / 1.702
    for _ in range(6):  # 1.5976 x + 0.07056 x^3 = z
        x -= (1.5976 * x + 0.07056 * x**3 - z) / (1.5976 + 0.21168 * x * x)
    return x


def seat(customers: np.ndarray, new: np.ndarray, discount: float, dish: np.ndarray, sweep: int) -> np.ndarray:
    """Tables of each dish after seating its customers one by one: the first opens a table, and with j seated at t
    tables the next opens one with odds new : j - discount * t, where ``new`` is what the restaurant and its parent give
    a new table of the dish. Beyond 32 customers they are seated by the dozen, an eighth of those seated at a time. What
    is drawn depends on the dish, the sweep and j alone."""
    tables = np.minimum(customers, 1).astype(np.float64)
    j = 1
    live = np.flatnonzero(customers > 1)
    while len(live):
        block = np.minimum(1 if j < 32 else j // 8, customers[live] - j)
        p = np.clip(new[live] / (j + (block - 1) / 2 - discount * tables[live] + new[live]), 0, 1)
        u = uniforms(dish[live], sweep * 1_000_003 + j)
        tables[live] += (u < p) if j < 32 else binomials(block.astype(np.float64), p, u)
        j += 1 if j < 32 else j // 8
        live = live[customers[live] > j]
    return tables


class Spelling:
    """Probabilities of the next symbol in every folded context; ``logs`` is (context, symbol), natural logarithms."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs.astype(np.float32)

    @classmethod
    def sample(cls, cells: np.ndarray, counts: np.ndarray, s: Sampling, sweep: int) -> Spelling:
        """Seats the spellings' symbols (cell = context * SYMBOLS + symbol) and returns what the seating predicts."""
        d, theta = s.byte_discount, s.byte_strength
        levels = [np.zeros((n, SYMBOLS)) for n in CONTEXTS]
        levels[3].ravel()[cells] = counts
        tables = [np.minimum(x, 1) for x in levels]

        def pass_up(k: int) -> None:
            levels[k - 1] = tables[k].reshape(CONTEXTS[k - 1], FOLDS[k - 1], SYMBOLS).sum(axis=1)

        def predict() -> list[np.ndarray]:
            parent, out = np.full((1, SYMBOLS), 1 / SYMBOLS), []
            for k, (n, t) in enumerate(zip(levels, tables, strict=True)):
                if k:
                    parent = np.repeat(parent, FOLDS[k - 1], axis=0)
                out.append(parent)
                parent = (n - d * t + (theta + d * t.sum(axis=1, keepdims=True)) * parent) / (theta + n.sum(axis=1, keepdims=True))
            return [*out, parent]

        for k in (3, 2, 1):
            pass_up(k)
            tables[k - 1] = np.minimum(levels[k - 1], 1)
        for turn in range(2):
            base = predict()
            for k in (3, 2, 1, 0):
                n, t = levels[k], tables[k]
                at = np.flatnonzero(n)
                new = ((theta + d * t.sum(axis=1, keepdims=True)) * base[k]).ravel()[at]
                t = np.zeros(n.size)
                t[at] = seat(n.ravel()[at], new, d, at * 4 + k, s.seed + 2 * sweep + turn)
                tables[k] = t.reshape(n.shape)
                if k:
                    pass_up(k)
        return cls(np.log(predict()[4]))

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Of each word's whole spelling with its end."""
        at, ends = cells_of(words)
        return np.add.reduceat(self.logs.ravel()[at].astype(np.float64), np.concatenate([[0], ends[:-1]])) if words else np.zeros(0)


def cells_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the words' symbols, one word after the other, and where each word ends."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"\0".join(words) + b"\0" if words else b"", dtype=np.uint8).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
    symbol = data.copy()
    symbol[ends - 1] = SYMBOLS - 1
    back = []
    for n in (1, 2, 3):
        before = np.concatenate([np.zeros(n, dtype=np.int64), data[:-n]])[: len(data)]
        back.append(np.where(place >= n, before, 0))
    context = (back[0] * FOLDS[1] + back[1] % FOLDS[1]) * FOLDS[2] + back[2] % FOLDS[2]
    return context * SYMBOLS + symbol, ends


def dishes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def short_dishes(words: list[bytes], bits: int) -> np.ndarray:
    return dishes(words) >> np.uint64(64 - bits)


def homes_of(short: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part that a word belongs to; it rises with the hash."""
    return ((short >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the codes, and where each distinct one begins in it."""
    order = np.argsort(codes)
    ordered = codes[order]
    return order, np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(codes)])


def summed(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, dtype=np.uint32) if len(starts) else np.zeros(0, dtype=np.uint32)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes(), "zstd", asbytes=True)


def from_planes(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    plain = pa.decompress(data, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, dtype=np.uint8).reshape(size, n).T).view(kind).ravel()


def packed(**made) -> bytes:
    """Arrays, bytes, numbers and lists of these as one binary value."""

    def one(x):
        if isinstance(x, list):
            return [one(y) for y in x]
        if isinstance(x, bytes):
            return ("bytes", len(x), pa.compress(x, "zstd", asbytes=True) if x else b"")
        return (x.dtype.str, len(x), planes(x) if len(x) else b"") if isinstance(x, np.ndarray) else x

    return pickle.dumps({k: one(x) for k, x in made.items()}, protocol=5)


def unpacked(data: bytes) -> dict:
    def one(x):
        if isinstance(x, list):
            return [one(y) for y in x]
        if not isinstance(x, tuple):
            return x
        kind, n, body = x
        if kind == "bytes":
            return pa.decompress(body, n, "zstd", asbytes=True) if n else b""
        return from_planes(body, n, kind) if n else np.zeros(0, dtype=kind)

    return {k: one(x) for k, x in pickle.loads(data).items()}


def joined(words: list[bytes]) -> bytes:
    """No word has a space in it."""
    return b" ".join(words)


def parted(data: bytes) -> list[bytes]:
    return data.split(b" ") if data else []


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x.astype(np.uint32), prepend=np.uint32(0))


def from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint32)


class Corpus:
    """Texts as blocks of word numbers, and what is known of their pairs of words.

    ``blocks``, bucketed by block so that no later step moves it: for each text its kept columns and word numbers; for
    each block a row with its dictionary. ``lists``, bucketed by part: for each part of the words the pairs that end in
    one of them, how often they occur in learned texts, and where each block's pairs stand among them; the pairs of a
    frequent word are dealt to several parts. ``homes``, bucketed alike: each part's words with their counts, and which
    of them other parts ask for when they seat repeated pairs."""

    def __init__(self, docs: DataFrame, learned: Column, keep: tuple[str, ...]):
        self.spark = docs.sparkSession
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.parts = parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // BLOCK_BYTES)
        self.bits = bits = min(64, max(40, 20 + total.bit_length()))
        self.keep = keep
        share = max(1 / (4 * parts), 1e-4)
        kept = [T.StructField(c, docs.schema[c].dataType) for c in keep]
        often = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType())]))
        schema = T.StructType([T.StructField("block", T.LongType()), *kept, T.StructField("learned", T.BooleanType()), T.StructField("ids", T.BinaryType()), T.StructField("words", T.ArrayType(T.BinaryType())), T.StructField("tokens", T.LongType()), T.StructField("often", often)])
        often_type = pa.list_(pa.struct([("word", pa.binary()), ("c", pa.int64())]))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, at, size, types, all_ids = TaskContext.get().partitionId() << 20, {END: 0}, 0, {}, []

            def entry() -> pa.RecordBatch:
                words, c = list(at), np.bincount(np.concatenate(all_ids), minlength=len(at))
                found = [{"word": words[k], "c": int(c[k])} for k in np.flatnonzero(c >= max(2, c.sum() * share / 2))]
                made = {"block": i64([block]), **{c: pa.nulls(1, t) for c, t in types.items()}, "learned": pa.nulls(1, pa.bool_()), "ids": pa.nulls(1, pa.binary())}
                return pa.RecordBatch.from_pydict(made | {"words": pa.array([words], pa.list_(pa.binary())), "tokens": i64([int(c.sum())]), "often": pa.array([found], often_type)})

            for batch in batches:
                types = {c: batch.column(c).type for c in keep}
                for k in range(0, batch.num_rows, 64):
                    part, ids = batch.slice(k, 64), []
                    for text in byte_list(part.column("text")):
                        ids.append(np.fromiter((at.setdefault(x, len(at)) for x in [*space_words(text), END]), dtype=np.int32))
                        size += len(text) + 1
                    all_ids += ids
                    made = {"block": pa.array(np.full(len(ids), block)), **{c: part.column(c) for c in keep}, "learned": part.column("learned_row"), "ids": bytes_column([x.tobytes() for x in ids])}
                    yield pa.RecordBatch.from_pydict(made | {"words": pa.nulls(len(ids), pa.list_(pa.binary())), "tokens": pa.nulls(len(ids), pa.int64()), "often": pa.nulls(len(ids), often_type)})
                    if size >= BLOCK_BYTES:
                        yield entry()
                        block, at, size, all_ids = block + 1, {END: 0}, 0, []
            if size:
                yield entry()

        texts = docs.select(*keep, "text", F.coalesce(learned, F.lit(False)).alias("learned_row"))
        stored = _bucketed(texts.mapInArrow(read, schema), parts, "block")
        self.blocks = stored.drop("tokens", "often")
        limit = (stored.agg(F.sum("tokens")).first()[0] or 0) * share
        counts = stored.filter("often is not null").select(F.explode("often").alias("x")).groupBy("x.word").agg(F.sum("x.c").alias("c"))
        heavy = [(bytes(r.word), min(parts, math.ceil(r.c / limit))) for r in counts.filter(F.col("c") >= limit).collect()] if limit else []
        short = short_dishes([w for w, _ in heavy], bits)
        by = np.argsort(short)
        self.layout = layout = _Layout(bits, parts, short[by], np.array([n for _, n in heavy], dtype=np.int64)[by])

        def ask(table: pa.Table) -> pa.Table:
            block = _Block(table, layout)
            learn = np.repeat(block.docs.column("learned").to_numpy(), block.lengths)
            c, rows = np.add.reduceat(learn[block.order], block.starts, dtype=np.uint32)[block.dealt], []
            ends, middle = np.searchsorted(block.place, 2 * np.arange(parts + 1)), np.searchsorted(block.place, 2 * np.arange(parts) + 1)
            home_ends = np.searchsorted(block.home[block.by], np.arange(parts + 1))
            for part in np.flatnonzero((np.diff(ends) > 0) | (np.diff(home_ends) > 0)):
                a, m, b = ends[part], middle[part], ends[part + 1]
                first, last = home_ends[part], home_ends[part + 1]
                at = np.flatnonzero(np.diff(block.w[m:b], prepend=-1))
                numbers = np.concatenate([block.by[first:last], block.w[m:b][at]])
                runs = np.concatenate([np.bincount(block.rank[block.w[a:m]] - first, minlength=last - first), np.diff(at, append=b - m)])
                words = joined([block.words[k] for k in numbers.tolist()])
                rows.append((int(part), packed(words=words, at_home=int(last - first), runs=runs.astype(np.uint32), u=block.short[block.u[a:b]], c=c[a:b])))
            return pa.table([pa.array(np.full(len(rows), block.name)), pa.array([k for k, _ in rows], pa.int32()), bytes_column([x for _, x in rows])], names=["block", "part", "data"])

        def meet(table: pa.Table) -> pa.Table:
            part, blocks = table.column("part")[0].as_py(), table.column("block").to_pylist()
            lists = [unpacked(x) for x in table.column("data").to_pylist()]
            each = [parted(x["words"]) for x in lists]
            code = pa.array([w for words in each for w in words], pa.binary()).dictionary_encode()
            words = code.dictionary.to_pylist()
            short = short_dishes(words, bits)
            home = homes_of(short, bits, parts)
            by = np.lexsort((short, home != part))  # its own first
            rank = np.empty(len(by), dtype=np.int64)
            rank[by] = np.arange(len(by))
            number, words, short, home = rank[code.indices.to_numpy()], [words[k] for k in by], short[by], home[by]
            own = int((home == part).sum())
            w = np.repeat(number, np.concatenate([x["runs"] for x in lists]))
            u, c = np.concatenate([x["u"] for x in lists]), np.concatenate([x["c"] for x in lists])
            wide = np.uint64(max(1, len(words).bit_length()))
            order, starts = distinct((w.astype(np.uint64) << (np.uint64(64) - wide)) | (u << np.uint64(64 - bits) >> wide))
            totals = summed(c[order], starts)
            which = np.empty(len(u), dtype=np.uint32)
            which[order] = np.repeat(np.arange(len(starts), dtype=np.uint32), np.diff(starts, append=len(u)))
            w, u, seen, often = w[order[starts]], u[order[starts]], totals > 0, np.flatnonzero(totals > 1)
            n, count = np.bincount(w[seen], minlength=len(words)), np.bincount(w, totals, len(words)).astype(np.int64)
            before, followed = np.unique(u[seen], return_counts=True)
            ask_w, ask_u = np.unique(short[w[often]]), np.unique(u[often])
            rows = [(0, part, packed(words=joined(words[:own]), totals=totals, w=np.searchsorted(ask_w, short[w[often]]).astype(np.uint32), u=np.searchsorted(ask_u, u[often]).astype(np.uint32), dish=pair_dishes(short[w[often]], u[often])))]
            at, pair = 0, 0
            for block, x, mine in zip(blocks, lists, each, strict=True):
                rows.append((1, block, packed(w=steps(number[at : at + x["at_home"]]), pair=steps(which[pair : pair + len(x["u"])]))))
                at, pair = at + len(mine), pair + len(x["u"])
            by = np.argsort(home, kind="stable")
            cuts = [np.searchsorted(x, np.arange(parts + 1)) for x in (home[by], *(homes_of(x, bits, parts) for x in (before, ask_w, ask_u)))]
            for to in np.flatnonzero(sum(np.diff(x) for x in cuts)):
                v, f, p, q = (slice(x[to], x[to + 1]) for x in cuts)
                rows.append((2, int(to), packed(w=short[by[v]], n=n[by[v]], c=count[by[v]], u=before[f], followed=followed[f], ask_w=ask_w[p], ask_u=ask_u[q])))
            tail = [0] * (len(rows) - 1)
            counted = [i64([int((totals == k).sum()), *tail]) for k in (1, 2)]
            made = [pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array([x for x, _, _ in rows], pa.int32()), i64([x for _, x, _ in rows]), bytes_column([x for _, _, x in rows])]
            return pa.table([*made, *counted], names=["part", "kind", "to", "data", "once", "twice"])

        def settle(lists: pa.Table, told: pa.Table) -> pa.Table:
            part, words = lists.column("part")[0].as_py(), unpacked(lists.column("data")[0].as_py())["words"]
            short = short_dishes(parted(words), bits)
            n, c, followed = np.zeros((3, len(short)), dtype=np.int64)
            asked = []
            for source, data in zip(told.column("part").to_pylist(), told.column("data").to_pylist(), strict=True):
                x = unpacked(data)
                at = np.arange(len(short)) if source == part else np.searchsorted(short, x["w"])
                n[at] += x["n"]
                c[at] += x["c"]
                np.add.at(followed, np.searchsorted(short, x["u"]), x["followed"])
                if len(x["ask_w"]) or len(x["ask_u"]):
                    asked.append([source, *(steps(np.searchsorted(short, x[k])) for k in ("ask_w", "ask_u"))])
            made = packed(words=words, c=c, n=n, followed=followed, asked=asked, seatings=[[n, np.minimum(n, 1), followed]])
            return pa.table([lists.column("part"), bytes_column([made]), i64([int((n == 1).sum())]), i64([int((n == 2).sum())]), i64([int(c.sum())]), i64([int((c > 0).sum())])], names=["part", "data", "once", "twice", "tokens", "known"])

        asked = self.blocks.groupBy("block").applyInArrow(ask, "block long, part int, data binary")
        self.lists = _bucketed(asked.repartition(parts, "part").groupBy("part").applyInArrow(meet, "part int, kind int, to long, data binary, once long, twice long"), parts, "part")
        self.once, self.twice = (int(x or 0) for x in self.lists.agg(F.sum("once"), F.sum("twice")).first())
        told = self.lists.filter("kind = 2").select(F.col("to").cast("int").alias("to"), "part", "data")
        cast = "part int, data binary, once long, twice long, tokens long, known long"
        self.homes = _bucketed(self.lists.filter("kind = 0").select("part", "data").groupBy("part").cogroup(told.groupBy("to")).applyInArrow(settle, cast), parts, "part")


@dataclass(frozen=True)
class _Layout:
    """How pairs are dealt to parts: the frequent words' hashes, in order, and the parts that share the pairs of each."""

    bits: int
    parts: int
    heavy: np.ndarray
    shares: np.ndarray


def pair_dishes(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    x = w + u * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


class _Block:
    """A block's rows: word numbers of all its texts, the words before them (texts end, so each begins after an end,
    number 0), and its distinct pairs: the tokens in the order of their pairs, where each pair begins there, and the
    order in which the pairs are dealt to parts: ``place`` is twice the part, and one more away from the word's home."""

    def __init__(self, table: pa.Table, layout: _Layout):
        self.name = table.column("block")[0].as_py()
        self.docs = table.filter(table.column("ids").is_valid())
        self.words = table.filter(table.column("words").is_valid()).column("words")[0].as_py()
        each = [np.frombuffer(x, dtype=np.int32) for x in self.docs.column("ids").to_pylist()]
        self.ids, self.lengths = np.concatenate(each), np.array([len(x) for x in each])
        self.before = np.concatenate([np.zeros(1, dtype=np.int32), self.ids[:-1]])
        self.short = short_dishes(self.words, layout.bits)
        self.home = homes_of(self.short, layout.bits, layout.parts)
        self.by = np.argsort(self.short, kind="stable")
        self.rank = np.empty(len(self.by), dtype=np.int64)
        self.rank[self.by] = np.arange(len(self.by))
        self.order, self.starts = distinct(self.rank[self.ids] * len(self.words) + self.rank[self.before])
        first = self.order[self.starts]
        w, u = self.ids[first], self.before[first]
        at = np.searchsorted(layout.heavy, self.short).clip(0, max(len(layout.heavy) - 1, 0))
        shares = np.where(layout.heavy[at] == self.short, layout.shares[at], 1) if len(layout.heavy) else np.ones(len(at), dtype=np.int64)
        mixed = ((self.short * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
        away = mixed[u] % shares[w]
        place = 2 * ((self.home[w] + away) % layout.parts) + (away > 0)
        self.dealt = np.argsort(place, kind="stable")
        self.w, self.u, self.place = w[self.dealt], u[self.dealt], place[self.dealt]

    def of_tokens(self, pairs: np.ndarray) -> np.ndarray:
        """What is known of the dealt pairs, for each token."""
        found, out = np.empty(len(pairs), dtype=pairs.dtype), np.empty(len(self.ids), dtype=pairs.dtype)
        found[self.dealt] = pairs
        out[self.order] = np.repeat(found, np.diff(self.starts, append=len(self.ids)))
        return out


def _bucketed(df: DataFrame, buckets: int, column: str) -> DataFrame:
    """The rows as a table in the shared folder, bucketed so that grouping by the column moves none of them."""
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", f"{shared_dir(df.sparkSession)}/{name}").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


@dataclass(frozen=True)
class _Shared:
    """What goes with a task: the sampling, the discounts of words and contexts."""

    s: Sampling
    discount: float
    context_discount: float

    def p(self, words: list[bytes], n: np.ndarray, t: np.ndarray, state: tuple) -> np.ndarray:
        """The words' predictive probability in the shared restaurant after a sweep."""
        spelling, (tables, customers) = state
        return (n - self.discount * t + (self.s.word_strength + self.discount * tables) * np.exp(spelling.log_probability(words))) / (self.s.word_strength + customers)

    def tables(self, words: list[bytes], n: np.ndarray, sweep: int, state: tuple) -> np.ndarray:
        """The tables that a sweep gives the words, however these are dealt to tasks."""
        t, at = np.minimum(n, 1), np.flatnonzero(n > 1)
        some = [words[k] for k in at.tolist()]
        new = (self.s.word_strength + self.discount * state[1][0]) * np.exp(state[0].log_probability(some))
        t[at] = seat(n[at], new, self.discount, dishes(some), self.s.seed + sweep).astype(np.int64)
        return t

    def context_tables(self, pairs: dict, p: np.ndarray, tables: np.ndarray, sweep: int) -> np.ndarray:
        """The tables that a sweep gives a part's repeated pairs, given the words' probabilities and the tables of the
        contexts after the sweep before."""
        new = (self.s.context_strength + self.context_discount * tables[pairs["u"]]) * p[pairs["w"]]
        c = pairs["totals"][pairs["totals"] > 1].astype(np.int64)
        return seat(c, new, self.context_discount, pairs["dish"], self.s.seed + sweep).astype(np.int64)


class PitmanYor:
    """The sampled model: the words' homes (a table) with the seatings of the kept sweeps and the one before them, and
    for each sweep a spelling model, the number of shared tables and that of their customers, the contexts' tables."""

    def __init__(self, corpus: Corpus, s: Sampling = Sampling()):
        self.s, self.spark, self.corpus = s, corpus.spark, corpus
        once, twice, tokens, known = (int(x or 0) for x in corpus.homes.agg(*map(F.sum, ("once", "twice", "tokens", "known"))).first())
        self.tokens, self.words = tokens, known
        self.context_discount = float(np.clip(corpus.once / max(corpus.once + 2 * corpus.twice, 1), 0.1, 0.9))
        self.discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.9))
        self.shared = _Shared(s, self.discount, self.context_discount)
        self.homes = corpus.homes.select("part", "data")
        self.all_words = self._words()
        #: The state after each sweep; the first has one table for each word and pair.
        self.states: list[tuple[Spelling, tuple[int, int]]] = []
        for sweep in range(1 + s.burn_in + s.kept):
            if sweep:
                self.homes = self._swept(sweep)
            rows = self._orders().groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
            cells, counts = rows["cell"].to_numpy(dtype=np.int64), rows["n"].to_numpy(dtype=np.int64)
            order = np.argsort(cells)
            cells, counts = cells[order], counts[order]
            total = tuple(int(counts[cells == k].sum()) for k in (-1, -2))
            self.states.append((Spelling.sample(cells[cells >= 0], counts[cells >= 0], s, sweep), total))
        self.kept = self.spark.sparkContext.broadcast(self.states[s.burn_in :])
        self.unknowns = self._unknown()
        self.unknown = float(np.mean(self.unknowns))

    def _unknown(self) -> list[float]:
        """Probability that a token is none of the known words, in each kept sweep."""
        shared, kept = self.kept, self.s.kept

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mass = np.zeros(kept)
            for x in _blobs(batches):
                words = _those(parted(x["words"]), x["c"] > 0)
                mass += [np.exp(spelling.log_probability(words)).sum() for spelling, _ in shared.value[1:]]
            yield pa.RecordBatch.from_arrays([i64(np.arange(kept)), f64(mass)], names=["k", "mass"])

        known = {r.k: r.mass for r in self.homes.select("data").mapInArrow(run, "k long, mass double").groupBy("k").agg(F.sum("mass").alias("mass")).collect()}
        return [max((self.s.word_strength + self.discount * t) / (self.s.word_strength + n) * (1 - known.get(k, 0.0)), 1e-300) for k, (_, (t, n)) in enumerate(shared.value[1:])]

    def _orders(self) -> DataFrame:
        """(cell, n): the symbols that the words' tables order, the tables themselves as cell -1, customers as -2."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = np.zeros(CONTEXTS[3] * SYMBOLS), np.zeros(2)
            for x in _blobs(batches):
                n, t, _ = x["seatings"][-1]
                at, ends = cells_of(_those(parted(x["words"]), t > 0))
                total += np.bincount(at, np.repeat(t[t > 0], np.diff(ends, prepend=0)), len(total))
                sums += t.sum(), n.sum()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([i64(np.append(at, (-1, -2))), i64(np.append(total[at], sums).astype(np.int64))], names=["cell", "n"])

        return self.homes.select("data").mapInArrow(run, "cell long, n long")

    def _swept(self, sweep: int) -> DataFrame:
        """The homes after another sweep: the repeated pairs are seated in their contexts, then the words."""
        last, shared, back = self.spark.sparkContext.broadcast(self.states[-1]), self.shared, self.s.burn_in

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    x = unpacked(data)
                    yield from _answers(source, x, [_wanted(shared, x, -1, last.value)])

        def draw(lists: pa.Table, told: pa.Table) -> pa.Table:
            rows = []
            if len(told):
                homes, pairs = _by_source(told), unpacked(lists.column("data")[0].as_py())
                p, tables = (np.concatenate([x[k][0] for _, x in homes]) for k in ("p", "tables"))
                more = shared.context_tables(pairs, p, tables, sweep) - 1
                more_w, more_u = np.bincount(pairs["w"], more, len(p)).astype(np.int64), np.bincount(pairs["u"], more, len(tables)).astype(np.int64)
                cut_w, cut_u = (np.cumsum([0, *(len(x[k][0]) for _, x in homes)]) for k in ("p", "tables"))
                rows = [(home, packed(n=more_w[cut_w[k] : cut_w[k + 1]], tables=more_u[cut_u[k] : cut_u[k + 1]])) for k, (home, _) in enumerate(homes)]
            source = lists.column("part")[0].as_py()
            return pa.table([pa.array([k for k, _ in rows], pa.int32()), pa.array([source] * len(rows), pa.int32()), bytes_column([x for _, x in rows])], names=["to", "part", "data"])

        def seated(x: dict, told: list[tuple[int, dict]]) -> bytes:
            n, tables, asked = x["n"].copy(), x["followed"].copy(), {k: v for k, *v in x["asked"]}
            for source, more in told:
                at_w, at_u = map(from_steps, asked[source])
                n[at_w] += more["n"]
                tables[at_u] += more["tables"]
            seatings = [*x["seatings"], [n, shared.tables(parted(x["words"]), n, sweep, last.value), tables]]
            return packed(**x | {"seatings": seatings if sweep > back else seatings[-1:]})

        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [seated(x, []) for x in _blobs([batch])]
                yield pa.RecordBatch.from_arrays([batch.column("part"), bytes_column(made)], names=["part", "data"])

        def meet(home: pa.Table, told: pa.Table) -> pa.Table:
            x = unpacked(home.column("data")[0].as_py())
            return pa.table([home.column("part"), bytes_column([seated(x, _by_source(told))])], names=["part", "data"])

        if not self.s.draw_contexts:
            return _bucketed(self.homes.mapInArrow(alone, "part int, data binary"), self.corpus.parts, "part")
        told = self.homes.mapInArrow(answer, "to int, part int, data binary")
        drawn = self.corpus.lists.filter("kind = 0").select("part", "data").groupBy("part").cogroup(told.groupBy("to")).applyInArrow(draw, "to int, part int, data binary")
        return _bucketed(self.homes.groupBy("part").cogroup(drawn.groupBy("to")).applyInArrow(meet, "part int, data binary"), self.corpus.parts, "part")

    def _words(self) -> DataFrame:
        """(word, c, n, followed): all texts' words, ends included: tokens in learned texts, contexts that the word
        follows there, words that follow it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _blobs(batches):
                yield pa.RecordBatch.from_arrays([bytes_column(parted(x["words"])), i64(x["c"]), i64(x["n"]), i64(x["followed"])], names=["word", "c", "n", "followed"])

        return self.homes.select("data").mapInArrow(run, "word binary, c long, n long, followed long")

    def scored_vocabulary(self) -> DataFrame:
        """(word, c, followed, p): each word's predictive probability in the shared restaurant, averaged over the kept
        sweeps; of a word that no learned text has, that of spelling it out."""
        shared, states = self.shared, self.kept

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in _blobs(batches):
                words = parted(x["words"])
                p = np.mean([shared.p(words, n, t, state) for (n, t, _), state in zip(x["seatings"][1:], states.value[1:], strict=True)], axis=0)
                yield pa.RecordBatch.from_arrays([bytes_column(words), i64(x["c"]), i64(x["followed"]), f64(p)], names=["word", "c", "followed", "p"])

        return self.homes.select("data").mapInArrow(run, "word binary, c long, followed long, p double")

    def answers(self) -> DataFrame:
        """(block, part, data): what each part knows of a block's words and pairs, in the order of its list."""
        shared, states, s = self.shared, self.kept, self.s

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    x = unpacked(data)
                    if s.draw_contexts:
                        yield from _answers(source, x, [_wanted(shared, x, k, states.value[k]) for k in range(s.kept)])
                    words = parted(x["words"])
                    p = [shared.p(words, n, t, state) for (n, t, _), state in zip(x["seatings"][1:], states.value[1:], strict=True)]
                    yield _row(source, -1, packed(c=x["c"], p=p, tables=[y[2] for y in x["seatings"][1:]]))

        def run(lists: pa.Table, told: pa.Table) -> pa.Table:
            kinds = lists.column("kind").to_numpy()
            pairs = unpacked(lists.column("data")[int(np.flatnonzero(kinds == 0)[0])].as_py())
            (_, words), *homes = _by_source(told)
            totals, at = pairs["totals"], np.flatnonzero(pairs["totals"] > 1)
            seated = []
            for k in range(s.kept):
                t = np.minimum(totals, 1)
                if homes:
                    t[at] = shared.context_tables(pairs, *(np.concatenate([x[y][k] for _, x in homes]) for y in ("p", "tables")), s.burn_in + 1 + k)
                seated.append(t)
            lists, rows = lists.filter(pa.array(kinds == 1)), []
            for data in lists.column("data").to_pylist():
                x = unpacked(data)
                w, pair = from_steps(x["w"]), from_steps(x["pair"])
                rows.append(packed(c=words["c"][w], p=[y[w] for y in words["p"]], tables=[y[w] for y in words["tables"]], totals=totals[pair], t=[y[pair] for y in seated]))
            return pa.table([lists.column("to"), lists.column("part"), bytes_column(rows)], names=["block", "part", "data"])

        told = self.homes.mapInArrow(answer, "to int, part int, data binary")
        return self.corpus.lists.filter("kind < 2").select("part", "kind", "to", "data").groupBy("part").cogroup(told.groupBy("to")).applyInArrow(run, "block long, part int, data binary")


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from map(unpacked, batch.column("data").to_pylist())


def _those(words: list[bytes], where: np.ndarray) -> list[bytes]:
    return list(compress(words, where.tolist()))


def _by_source(told: pa.Table) -> list[tuple[int, dict]]:
    return sorted(((k, unpacked(x)) for k, x in zip(told.column("part").to_pylist(), told.column("data").to_pylist(), strict=True)), key=lambda x: x[0])


def _row(to: int, source: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([source], pa.int32()), bytes_column([data])], names=["to", "part", "data"])


def _wanted(shared: _Shared, x: dict, k: int, state: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of a home's words that other parts ask for (0 for the others), and its contexts' tables."""
    n, t, tables = x["seatings"][k]
    at = np.unique(np.concatenate([from_steps(w) for _, w, _ in x["asked"]] or [np.zeros(0, dtype=np.uint32)]))
    words, p = parted(x["words"]), np.zeros(len(n))
    p[at] = shared.p([words[i] for i in at.tolist()], n[at], t[at], state)
    return p, tables


def _answers(source: int, x: dict, wanted: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """To each part that asks: probabilities of the words and tables of the contexts that it asks for."""
    for to, w, u in x["asked"]:
        w, u = from_steps(w), from_steps(u)
        yield _row(to, source, packed(p=[p[w] for p, _ in wanted], tables=[t[u] for _, t in wanted]))


def score_texts(docs: DataFrame, learned: Column, keep: tuple[str, ...] = ("doc_id",), s: Sampling = Sampling()) -> DataFrame:
    """The kept columns of all rows, scored by a model of those where ``learned`` holds, with n_tokens, n_known,
    train_tokens, base_score (add-one unigram), score and spelled_score: log10 of the averaged predictive probability of
    the text's tokens and its end, each given the token before it. As in the base, all unknown words are one outcome of
    ``score``; ``spelled_score`` goes on to spell out which unknown word it is.

    A null or empty text is its end alone. Each row is scored, so repeated rows and null ids stay; other columns are
    not read. Long texts only make their block larger."""
    corpus = Corpus(docs, learned, keep)
    model = PitmanYor(corpus, s)
    layout, n, unknowns, smooth = corpus.layout, model.tokens, model.unknowns, float(np.log10(model.tokens + model.words + 1))
    d, strength = model.context_discount, s.context_strength
    schema = ", ".join([*(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double"])

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        block, told = _Block(rows, layout), [x for _, x in _by_source(answers)]

        def of_words(x: list[np.ndarray]) -> np.ndarray:
            out = np.empty(len(block.words))
            out[block.by] = np.concatenate(x)
            return out

        c = of_words([x["c"] for x in told])
        known, base = c > 0, np.log10(c + 1) - smooth
        total_of, sweeps = block.of_tokens(np.concatenate([x["totals"] for x in told])), []
        for k, unknown in enumerate(unknowns):
            p = np.maximum(of_words([x["p"][k] for x in told]), 1e-300)
            back = strength + d * of_words([x["tables"][k] for x in told])
            sweeps.append((block.of_tokens(np.concatenate([x["t"][k] for x in told])), back, np.where(known, p, unknown), p))
        del told
        ends, sums, k = np.cumsum(block.lengths), [], 0
        while k < len(ends):  # texts of some 200,000 tokens at a time
            first, stop = ends[k] - block.lengths[k], max(k + 1, int(np.searchsorted(ends, ends[k] + 200_000)))
            span = slice(first, ends[stop - 1])
            w, u, total = block.ids[span], block.before[span], total_of[span].astype(np.float64)
            shared = spelled = 0.0
            for t, back, p, q in sweeps:
                own, new = total - d * t[span], back[u]
                shared, spelled = shared + own + new * p[w], spelled + own + new * q[w]
            logs = (np.log10(x / (len(sweeps) * (strength + c[u]))) for x in (shared, spelled))
            starts = ends[k:stop] - block.lengths[k:stop] - first
            sums.append([np.add.reduceat(x, starts) for x in (known[w].astype(np.int64), base[w], *logs)])
            k = stop
        sums = [np.concatenate(x) for x in zip(*sums, strict=True)]
        made = [*(block.docs.column(k) for k in keep), i64(block.lengths), i64(sums[0]), i64([n] * len(ends)), *map(f64, sums[1:])]
        return pa.table(made, names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score"])

    return corpus.blocks.groupBy("block").cogroup(model.answers().groupBy("block")).applyInArrow(score, schema)


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: 10 to the mean negative log10 probability of a token."""
    return scores.agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out")
    return score_texts(docs.select("doc_id", held, "text"), fold("doc_id", 7) != 2, ("doc_id", "held_out"), Sampling(draw_contexts=True))


QUERIES = {"op9_pitman_yor": op9_pitman_yor}
ORACLE_SQL: dict[str, str] = {}
