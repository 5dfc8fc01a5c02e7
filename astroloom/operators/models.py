"""Surfaces for a user's own models: encoders and generators, loaded once in each worker."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval


def encoded(rows: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", into: str = "embedding") -> DataFrame:
    """Adds the vectors of a text encoder; ``load`` runs once in each task's worker and gives texts -> vectors."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model(texts.fillna("").tolist()), index=texts.index)

    return rows.withColumn(into, encode(text))


def generated(prompts: DataFrame, load: Callable[..., Callable[[str], str]], key: str, tries: int = 3, wait: float = 0.0, pool: int = 1, credentials: tuple[str, ...] = ()) -> DataFrame:
    """(key, answer, status, error) of a text generator on (key, prompt); a prompt that fails ``tries`` times is a row
    with status failed, never a failed job.

    ``pool`` prompts of a task are out at a time, as a remote service allows. After a failure a prompt waits ``wait``
    seconds, twice as long after each further one, and goes to the next of the ``credentials``, each of which ``load`` gets
    as its argument once in a worker; without any it gets none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [load(c) for c in credentials] or [load()]

        def answer(place: int, prompt: str) -> tuple:
            for attempt in range(tries):
                try:
                    return models[(place + attempt) % len(models)](prompt), "ok", None
                except Exception as problem:  # noqa: BLE001 - the user's model may raise anything
                    failed = str(problem)
                    if attempt < tries - 1:
                        time.sleep(wait * 2**attempt)
            return None, "failed", failed

        with ThreadPoolExecutor(pool) as threads:
            for batch in batches:
                out = list(threads.map(answer, range(len(batch)), batch["prompt"]))
                made = pd.DataFrame(out, columns=["answer", "status", "error"])
                made.insert(0, key, batch[key].to_numpy())
                yield made

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {prompts.schema[key].dataType.simpleString()}, answer string, status string, error string")


def retrieved(queries: DataFrame, retriever: Callable[[DataFrame], DataFrame], k: int = 5) -> DataFrame:
    """A user's own retriever, from (qid, text) to (qid, doc_id, score), ranked as the built-in ones are."""
    return retrieval.top_k(queries.transform(retriever).select("qid", "doc_id", "score"), k)


class TextIndex:
    """A stored keyword index: two tables of a folder, documents and postings, which grow by appended parts.

    ``add`` gives each part a folder of its own, so a part that failed is written again elsewhere and a reader sees whole
    parts only once they are committed. Subclasses may replace any of add, search, save and load."""

    def __init__(self, path: str):
        self.path, self.postings_path = path, f"{path}/postings"

    def add(self, docs: DataFrame, part: str | None = None) -> None:
        part = part or uuid.uuid4().hex
        docs.groupBy().agg(F.count("*").alias("n_docs")).write.mode("overwrite").parquet(f"{self.path}/counts/batch={part}")
        docs.write.mode("overwrite").parquet(f"{self.path}/documents/batch={part}")
        retrieval.postings(docs).write.mode("overwrite").parquet(f"{self.postings_path}/batch={part}")

    def keep(self, stream: DataFrame, checkpoint: str) -> None:
        """Adds the documents that a stream has now, each batch as the part of its number, and stops; a batch that is run
        again replaces its part."""
        sink = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda docs, batch: self.add(docs, f"stream-{batch}"))
        sink.trigger(availableNow=True).start().awaitTermination()

    def documents(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", f"{self.path}/documents").parquet(f"{self.path}/documents/batch=*").drop("batch")

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.postings_path).parquet(f"{self.postings_path}/batch=*").drop("batch")

    def count(self, spark: SparkSession) -> int:
        """Documents, by the counts that were stored with the parts."""
        return spark.read.parquet(f"{self.path}/counts/batch=*").agg(F.sum("n_docs")).first()[0]

    def search(self, queries: DataFrame, method: str = "idf", k: int = 5) -> DataFrame:
        spark = queries.sparkSession
        return retrieval.keyword_search(self.postings(spark), self.count(spark), retrieval.query_terms(queries), method, k)

    def save(self, spark: SparkSession, path: str) -> TextIndex:
        """A compacted copy: one part of all."""
        copy = TextIndex(path)
        self.documents(spark).write.mode("overwrite").parquet(f"{path}/documents/batch=0")
        spark.createDataFrame([(self.count(spark),)], "n_docs long").write.mode("overwrite").parquet(f"{path}/counts/batch=0")
        self.postings(spark).write.mode("overwrite").parquet(f"{copy.postings_path}/batch=0")
        return copy

    @classmethod
    def load(cls, path: str) -> TextIndex:
        return cls(path)
