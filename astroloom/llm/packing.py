"""Vector bin packing of training examples into sequences.

Every example is a vector (tokens, segments, loss-bearing tokens). An open sequence takes, of the waiting examples that
fit, the one whose demand has the largest dot product with what the sequence has left of each limit; when none fits
whole, the best one is cut. Tokens can be cut anywhere, so what bounds a sequence is whichever limit runs out first.
Packing runs inside the tasks that hold the rows: no shuffle, and sequence ids carry the partition's number.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import i64, table

#: The public vocabulary file that the packing query uses.
TOKENIZER = "byte_bpe_50k.json"
END_ID = 1
#: Pieces that a worker remembers; beyond it, it starts anew.
REMEMBERED = 300_000


@dataclass(frozen=True)
class Limits:
    """Of one sequence. ``waiting`` examples are looked at together; it bounds memory and does not drop any."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    waiting: int = 512


@dataclass
class Example:
    key: int
    tokens: int
    loss: np.ndarray | None = None  # a flag for each token; None: every token bears loss
    payload: object = None
    start: int = 0

    def left(self) -> int:
        return self.tokens - self.start

    def loss_left(self) -> int:
        return self.left() if self.loss is None else int(self.loss[self.start :].sum())

    def head(self, tokens: int, loss_tokens: int) -> int:
        """How many of the next tokens fit."""
        take = min(tokens, self.left())
        if self.loss is None:
            return min(take, loss_tokens)
        used = np.cumsum(self.loss[self.start : self.start + take])
        return int(np.searchsorted(used, loss_tokens, side="right"))


class Packer:
    """Yields (example, start, length, sequence, offset) as soon as a sequence is closed."""

    def __init__(self, limits: Limits, first: int = 0):
        if min(limits.tokens, limits.segments, limits.loss_tokens, limits.waiting) < 1:
            raise ValueError("every limit is at least 1")
        self.limits, self.sequence = limits, first
        self.waiting: list[Example] = []
        self.demand = np.zeros((limits.waiting, 3))
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=float)

    def add(self, example: Example) -> Iterator[tuple]:
        lim = self.limits
        while example.loss is None and example.left() >= lim.tokens and lim.loss_tokens >= lim.tokens:
            yield example, example.start, lim.tokens, self.sequence, 0  # a full sequence of its own
            example.start += lim.tokens
            self.sequence += 1
        if example.left():
            self.demand[len(self.waiting)] = example.left(), 1, example.loss_left()
            self.waiting.append(example)
            while len(self.waiting) == lim.waiting:
                yield from self._fill()

    def finish(self) -> Iterator[tuple]:
        while self.waiting:
            yield from self._fill()

    def _fill(self) -> Iterator[tuple]:
        """Fills one sequence."""
        lim = self.limits
        left, offset, placed = np.array([lim.tokens, lim.segments, lim.loss_tokens], dtype=float), 0, []
        while self.waiting and left[0] > 0 and left[1] > 0:
            n = len(self.waiting)
            demand = self.demand[:n]
            score = (demand * self.scale) @ (left * self.scale)
            whole = (demand <= left).all(axis=1)
            k = int(np.argmax(np.where(whole, score, -1.0))) if whole.any() else int(np.argmax(score))
            x = self.waiting[k]
            take = x.left() if whole[k] else x.head(int(left[0]), int(left[2]))
            if not take:  # the first waiting token of the best one bears loss and none is left
                fits = [i for i in range(n) if self.waiting[i].head(int(left[0]), int(left[2]))]
                if not fits:
                    break
                k = max(fits, key=lambda i: (score[i], -i))
                x = self.waiting[k]
                take = x.head(int(left[0]), int(left[2]))
            loss = take if x.loss is None else int(x.loss[x.start : x.start + take].sum())
            placed.append((x, x.start, take, offset))
            offset += take
            left -= take, 1, loss
            x.start += take
            if x.left():
                self.demand[k] = x.left(), 1, x.loss_left()
            else:
                self.waiting[k] = self.waiting[-1]
                self.demand[k] = self.demand[n - 1]
                self.waiting.pop()
        yield from self._close(placed)

    def _close(self, placed: list[tuple]) -> Iterator[tuple]:
        """A sequence that came out short is cut once more, into powers of two, which need no padding."""
        total = sum(p[2] for p in placed)
        if total == self.limits.tokens:
            cuts = [total]
        else:
            cuts = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        room, at = cuts[0], 0
        for x, start, take, _ in placed:
            while take:
                part = min(take, room - at)
                yield x, start, part, self.sequence, at
                start, take, at = start + part, take - part, at + part
                if at == room:
                    self.sequence += 1
                    cuts, at = cuts[1:], 0
                    room = cuts[0] if cuts else 0


class Pieces(dict):
    """Little-endian uint32 ids of a text by its pieces between spaces.

    Under the byte-level pattern a token never holds a space after another character, so a text can be cut before each
    single space and every distinct piece be encoded once. White-space runs with a space inside them are the one case
    where such a cut could fall within a token; those texts, and texts that hold a special token, are encoded whole."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        try:
            import base64

            import public_tokenizers

            with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if all(self.whole.token_to_id(t) in (None, i) for t, i in (("!", 0), ("the", ranks[b"the"]))):
                self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (OSError, ModuleNotFoundError):
            pass  # the tokenizer alone, slower

    def ids(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast else self.whole.encode(text, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids(" " + piece)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    ODD = re.compile(r"[^\S \n]")

    def packed(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
        elif "  " in text or "\n " in text or text.endswith(" ") or self.ODD.search(text):
            ids = self.ids(text)
        else:
            first, *rest = text.split(" ")
            ids = self.ids(first)
            return struct.pack(f"<{len(ids)}I", *ids) + b"".join(map(self.__getitem__, rest))
        return struct.pack(f"<{len(ids)}I", *ids)


def _first_sequence() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, limits: Limits = Limits(), end_id: int = END_ID) -> DataFrame:
    """Packs whole texts, each followed by ``end_id``; every token bears loss. A row per piece.

    Null and empty texts are the end id alone. A null doc_id is kept; repeated rows are packed each. An empty table
    gives no rows. Only doc_id and text are read, so other columns cannot clash. A sequence that cannot be filled is
    divided into powers of two, so there is no padding."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        pieces, packer = Pieces(path), Packer(limits, _first_sequence())

        def placed(made: Iterable[tuple]) -> list[tuple]:
            return [(x.key, start, n, zlib.crc32(memoryview(x.payload)[4 * start : 4 * (start + n)]), x.tokens, seq, at) for x, start, n, seq, at in made]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([i64(list(c)) for c in columns], names=[c.split()[0] for c in schema.split(", ")])

        rows: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = pieces.packed(text or "") + end
                rows += placed(packer.add(Example(key, len(ids) // 4, payload=ids)))
            if len(rows) >= 10_000:
                yield out(rows)
                rows = []
        yield out(rows + placed(packer.finish()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Instruction data: rows (example_id, loss array<boolean>, one flag for each token) under all three limits.

    A row per piece: example_id, start, length, sequence_id, offset. Null or empty arrays hold no token and give no row."""
    schema = "example_id long, start long, length long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, _first_sequence())

        def out(made: list[tuple]) -> pa.RecordBatch:
            rows = [(x.key, start, n, seq, at) for x, start, n, seq, at in made]
            return pa.RecordBatch.from_arrays([i64(list(c)) for c in (list(zip(*rows, strict=True)) or [[]] * 5)], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            made: list[tuple] = []
            for key, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if loss:
                    made += packer.add(Example(key, len(loss), np.array([bool(x) for x in loss])))
            yield out(made)
        yield out(list(packer.finish()))

    return examples.select(F.col("example_id").cast("long").alias("example_id"), "loss").mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLE_SQL: dict[str, str] = {}
