"""Writers: datasets by type, JSON lines, stored indexes, and work that skips what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


#: Bytes of JSON that are written as one array.
ARRAY_BYTES = 256 << 20


def dataset(rows: DataFrame, path: str, by: str) -> None:
    """JSON lines, a folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def json_array(rows: DataFrame, path: str) -> None:
    """One file that is a JSON array: for sets that a reader loads whole; order by the rows' text. Sets beyond what one
    task should hold are refused: write those as lines."""
    size = rows.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.sum("n")).first()[0] or 0
    if size > ARRAY_BYTES:
        raise ValueError(f"{size} bytes are too many for one array; use json_lines")
    lines = rows.select(F.to_json(F.struct("*")).alias("line"))
    whole = lines.groupBy().agg(F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list("line")), ",\n"), F.lit("\n]")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def stored_index(spark: SparkSession, name: str) -> DataFrame:
    """The postings that ``index`` wrote."""
    return spark.table(name)


def table_text(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def report(rows: DataFrame, key: str) -> DataFrame:
    """(key, result): the rest of each row as JSON, nulls left out."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("result"))


def index(postings: DataFrame, name: str, buckets: int = 64) -> None:
    """Postings bucketed and sorted by term, so later probes on the term need no exchange of this side."""
    postings.write.mode("overwrite").bucketBy(buckets, "term").sortBy("term").saveAsTable(name)


def resume(spark: SparkSession, inputs: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Appends ``work`` of the inputs whose key the output at ``path`` lacks, and returns all of the output."""
    try:
        done = spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None  # nothing is there yet
    if done is not None:
        inputs = inputs.join(done.select(key).distinct(), key, "left_anti")
    work(inputs).write.mode("append").parquet(path)
    return spark.read.parquet(path)
