"""Structured Streaming operators over event streams (source, ts, value) and the incremental upkeep of tables.

Late rows, older than the watermark, are dropped. Every sink takes a checkpoint folder of its own; ``foreachBatch``
sinks write under the batch's id, so a replayed batch replaces what it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def downsampled(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean and count per source and window; tumbling, or sliding with ``slide``."""
    return windowed(events.withWatermark("ts", late), width, slide)


def observing_runs(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of a source's samples with no gap as long as ``gap``."""
    return runs(events.withWatermark("ts", late), gap)


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark; ``new_rows`` remembers keys for good."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def new_rows(stream: DataFrame, key: str, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Appends the rows whose key was never seen before, changed, to ``path/rows`` and ``path/changed``: the persistent
    seen-set of a new-document source. Of rows that share a key one stays.

    Seen keys are the stream's own state, dealt out by key and kept with the checkpoint, so a batch looks up its own keys
    and reads no others; name the RocksDB provider for more keys than memory holds. A batch that is run again finds the
    state of its start and overwrites what it wrote."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
        if change:
            kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows/batch={batch}")
            change(kept).write.mode("overwrite").parquet(f"{path}/changed/batch={batch}")

    stream.dropDuplicates([key]).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def every(hours: float) -> dict[str, str]:
    """The trigger of a source that is polled every n hours, for writeStream.trigger(**every(6))."""
    return {"processingTime": f"{int(hours * 3600)} seconds"}


def with_open(closed: DataFrame, events: DataFrame, windows: Callable[[DataFrame], DataFrame], width: str | None = None) -> DataFrame:
    """Closed windows (source, start, end, ...) that a stream wrote, and those that are still open, which end after their
    source's last closed one: ``windows`` over the events that can lie in such. Sliding windows overlap, so an open one may
    begin up to a ``width`` before the last closed one ends; windows that do not overlap need none."""
    last = closed.groupBy("source").agg(F.max("end").alias("_end"))
    begins = F.col("_end") - F.expr(f"INTERVAL {width}") if width else F.col("_end")
    rest = events.join(last, "source", "left").filter(F.col("_end").isNull() | (F.col("ts") >= begins)).drop("_end")
    made = windows(rest)
    open_ = made.join(last, "source", "left").filter(F.col("_end").isNull() | (F.col("end") > F.col("_end"))).drop("_end")
    return closed.unionByName(open_)


def windowed(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    rows = events.groupBy("source", window.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rows.select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean")


def runs(events: DataFrame, gap: str) -> DataFrame:
    rows = events.groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return rows.select("source", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "top")


def variability(events: DataFrame) -> DataFrame:
    """Running count, mean, population sigma and flag (sigma over a tenth of the mean) of each source; update mode."""
    rows = events.groupBy("source").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    mean = F.col("s") / F.col("n")
    sigma = F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0)))
    return rows.select("source", "n", mean.alias("mean"), sigma.alias("sigma"), (sigma > 0.1 * F.abs(mean)).alias("variable"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what is there now, and stops."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def by_batch(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] | None = None, mode: str = "append") -> None:
    """Writes each batch, changed, to ``path/batch=<id>``; the same id always overwrites the same folder."""

    def write(rows: DataFrame, batch: int) -> None:
        (change(rows) if change else rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def latest_of_batches(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest batch's row of each key, of a table that ``by_batch`` wrote in update mode."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    newest = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [key, "batch"]).drop("batch")


def resolved(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Conflicts of a knowledge table (key..., content, confidence, ts): of each key the row with the largest
    confidence + 0.1 * seconds / 1e9 stays (ties: the newer, then by content), with a note where an old row won over a
    new one."""
    score = F.col("confidence") + 0.1 * F.unix_timestamp("ts") / 1e9
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("_s", score)
    best = both.groupBy(*key).agg(F.max(F.struct("_s", "ts", "content", "confidence", "_new")).alias("b"), F.max("_new").alias("_any"), F.min("_new").alias("_none"))
    kept_old = (F.col("b._new") == 0) & (F.col("_any") == 1)
    return best.select(*key, "b.content", "b.confidence", "b.ts", F.when(kept_old, "kept over a newer statement").alias("note"))


def without_ids(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")
