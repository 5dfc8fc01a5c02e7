"""Many patterns in one pass over texts, without a join of all patterns with all texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton, which takes some fifty times that in each worker.
BLOCK_BYTES = 4 << 20


def occurring(texts: DataFrame, key: str, text: str, patterns: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, pattern): which of ``patterns`` (pattern string) stand in which texts, each pair once for a row of texts.

    One automaton over all patterns runs over each text where it lies. Patterns are a stated set; beyond ``block_bytes``
    they are dealt into blocks by hash, each of which passes over the texts once. The empty pattern stands in every text,
    a null one in none."""
    patterns = patterns.select("pattern").filter("pattern IS NOT NULL").distinct()
    size = patterns.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = []
    for block in range(blocks):
        mine = patterns if blocks == 1 else patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        words = [r.pattern for r in mine.collect()]  # of the checked size
        shared = texts.sparkSession.sparkContext.broadcast(words)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for k, word in enumerate(shared.value):
                if word:
                    machine.add_word(word, k)
            machine.make_automaton()
            empty = [k for k, word in enumerate(shared.value) if not word]
            for batch in batches:
                at, which = [], []
                for n, value in enumerate(batch.column("text").to_pylist()):
                    found = {k for _, k in machine.iter(value)} if len(machine) else set()
                    found.update(empty)
                    at += [n] * len(found)
                    which += found
                names = pa.array([shared.value[k] for k in which], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), names], names=["key", "pattern"])

        parts.append(rows.mapInArrow(run, f"key {kind}, pattern string"))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)
