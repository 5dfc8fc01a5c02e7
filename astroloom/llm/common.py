"""Helpers shared by the corpus operators: tables, folds, byte-level words, durable intermediates."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every byte that cannot belong to a ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` word becomes a space, A-Z become a-z;
#: bytes of multi-byte characters are all above 0x7F and stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else (b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20)
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes."""
    return text.translate(WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+``: bytes.lower and bytes.split know only ASCII."""
    return text.lower().split()


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; a null id is in no fold (null)."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(modulus)


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string or binary Arrow column as bytes; nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it as long as the table has such a column, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a temporary one only where none is set and all
    executors are on this machine, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        return sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the shared folder: a lost executor costs no recomputation of what led to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again (columnar, compressed, pruned)."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def letters(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).rlike(r"\p{L}")


def f64(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.float64))


def i64(values: np.ndarray | list) -> pa.Array:
    return pa.array(values, type=pa.int64())
