"""A knowledge table that a stream keeps: each batch of new facts is set against what the table held before it, and its
outcome is one numbered part. A version is the parts of the batches before its number, so nothing is rewritten, older
versions stay readable, and a batch that is run again sees what it saw and replaces its own part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import conflicts
from ..operators.blocks import beside


def trust(confidence: Column, ts: Column) -> Column:
    return confidence + 0.1 * F.unix_timestamp(ts) / 1e9


def settled(new: DataFrame, old: DataFrame, least: float = 0.85, spread: float = 0.2) -> DataFrame:
    """The new facts (id, kind, value, entities, terms, confidence, ts, source) as they enter the table, with ``kept`` and
    ``note``: a fact that contradicts old ones is replaced by the one of them and itself with the largest confidence + 0.1 x
    seconds / 1e9 (ties: the new one, then the smaller id); ``kept`` is then the winner's id and the note names the source
    that lost. Ids of facts are unique."""
    columns = [c for c in new.columns if c != "id"]
    pairs = conflicts(new, old, least, spread).select(F.col("n_id").alias("id"), F.col("o_id").alias("_o"))
    scored = pairs.join(old.select(F.col("id").alias("_o"), trust(F.col("confidence"), F.col("ts")).alias("_s")), "_o")
    # Of the old ones that a fact contradicts, the best: one row for each fact.
    best = scored.groupBy("id").agg(F.max(F.struct("_s", (-F.col("_o")).alias("_minus"))).alias("_b")).select("id", F.col("_b._s").alias("_s"), (-F.col("_b._minus")).alias("_o"))
    rows = beside(new, best, ["id"]).withColumn("kept", F.when(F.col("_s") > trust(F.col("confidence"), F.col("ts")), F.col("_o")).otherwise(F.col("id")))
    won = old.select(F.col("id").alias("_w"), F.struct(*columns).alias("_won"))
    rows = rows.join(won, (F.col("kept") == F.col("_w")) & (F.col("kept") != F.col("id")), "left")
    note = F.when(F.col("_won").isNotNull(), F.concat(F.lit("kept over "), F.coalesce(F.col("source").cast("string"), F.lit("an unnamed source"))))
    return rows.select("id", *[F.when(F.col("_won").isNotNull(), F.col(f"_won.{c}")).otherwise(F.col(c)).alias(c) for c in columns], "kept", note.alias("note"))


class KnowledgeTable:
    """The table in a folder; ``schema`` is that of the facts."""

    def __init__(self, path: str):
        self.path = path

    def version(self, spark: SparkSession, number: int, schema) -> DataFrame:
        """What the table held before batch ``number``; no rows before the first."""
        if not number:
            return spark.createDataFrame([], schema).withColumns({"kept": F.col("id"), "note": F.lit(None).cast("string"), "batch": F.lit(0)})
        return spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").filter(F.col("batch") < number)

    def keep(self, stream: DataFrame, checkpoint: str) -> None:
        """Takes in what the stream has now, and stops."""

        def take(rows: DataFrame, batch: int) -> None:
            old = self.version(rows.sparkSession, batch, rows.schema).drop("kept", "note", "batch")
            settled(rows, old).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

        stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start().awaitTermination()
