"""Language identification with a string kernel.

The blended-spectrum presence kernel counts the character n-grams (n = 1 to 4) that two texts share, normalised by how
many each has. Labelled landmarks span a Nystrom feature space, one ridge regression per language is solved in it, and
a batch of texts is scored by a product of its presence matrix with the landmarks' weights: since the kernel is linear
in a text's presence row, (presence x landmarks) x coefficients is computed as presence x (landmarks x coefficients).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import f64, fold, letters, table

#: n-gram lengths, and buckets of each length's hashed n-grams.
LENGTHS, BUCKETS = (1, 2, 3, 4), 1 << 13
WIDTH = len(LENGTHS) * BUCKETS
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """Bounds of the labelled sample: rows of each language and in all, landmarks of each language and in all. Every
    language is learned, however many there are; beyond the bounds in all each has fewer rows, one at least."""

    rows: int = 600
    all_rows: int = 40_000
    landmarks: int = 24
    all_landmarks: int = 4800
    ridge: float = 1e-2


def presence(texts: list[str]) -> np.ndarray:
    """Which hashed n-grams each text has, over whole texts in lower case: a row of flags per text."""
    out = np.zeros((len(texts), WIDTH), dtype=bool)
    for row, text in zip(out, texts, strict=True):
        chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = np.zeros(0, dtype=np.uint32)
        for k, n in enumerate(LENGTHS):
            if len(chars) < n:
                break
            code = chars.copy() if n == 1 else code[: len(chars) - n + 1] * np.uint32(1_000_003) + chars[n - 1 :]
            row[k * BUCKETS + ((code * np.uint32(2_654_435_761)) >> np.uint32(19)).astype(np.int64)] = True
    return out


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of two presence matrices; 0 for texts without n-grams."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    norm = np.sqrt(np.outer(a.sum(axis=1), b.sum(axis=1)))
    return np.divide(a @ b.T, norm, out=np.zeros_like(norm), where=norm > 0)


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # n-gram bucket x language
    bias: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, labels: list[str], training: Training = Training()) -> LanguageModel:
        languages = sorted(set(labels))
        y = np.array([languages.index(x) for x in labels])
        each = max(1, min(training.landmarks, training.all_landmarks // len(languages)))
        marks = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(languages))])
        inner = kernel(rows[marks], rows[marks]).astype(float)
        values, vectors = np.linalg.eigh(inner)
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        features = kernel(rows, rows[marks]).astype(float) @ root
        counts = np.bincount(y, minlength=len(languages))
        share = 1.0 / (len(languages) * counts[y])  # languages weigh alike
        centre = share @ features
        centred = features - centre
        target = (y[:, None] == np.arange(len(languages))[None, :]).astype(float)
        mean = share @ target
        left = (centred * share[:, None]).T @ centred + training.ridge / len(marks) * np.eye(features.shape[1])
        beta = np.linalg.solve(left, (centred * share[:, None]).T @ (target - mean))
        alpha = root @ beta
        of = rows[marks].astype(float)
        weights = (of / np.sqrt(np.maximum(of.sum(axis=1, keepdims=True), 1))).T @ alpha
        return cls(languages, weights.astype(np.float32), (mean - centre @ beta).astype(np.float32))

    def score(self, texts: list[str], batch: int = 128) -> np.ndarray:
        """One-versus-rest values of each text, near 1 for its language and near 0 for others."""
        out = [np.zeros((0, len(self.languages)), dtype=np.float32)]
        for k in range(0, len(texts), batch):
            rows = presence(texts[k : k + batch])
            norm = np.sqrt(np.maximum(rows.sum(axis=1), 1)).astype(np.float32)
            out.append(rows.astype(np.float32) @ self.weights / norm[:, None] + self.bias)
        return np.concatenate(out)


def training_sample(docs: DataFrame, rows: int) -> DataFrame:
    """lang, text and order of twice ``rows`` labelled rows of each language on average, by the hash of id and text; all
    rows of a language that has no more."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("of"))  # a row for each language
    order = F.xxhash64("doc_id", "text", F.lit("sample"))
    picked = docs.withColumn("order", order).join(F.broadcast(counts), "lang")
    return picked.filter(F.col("order").cast("double") < (2.0 * rows / F.col("of") - 0.5) * 2.0**64).select("lang", "text", "order")


def fit_languages(docs: DataFrame, training: Training = Training()) -> LanguageModel | None:
    """Learns from the given rows' text and lang, whatever the number of rows from at most ``rows`` of each language, the
    first by hash; copies count once. Only flags of n-grams come to the driver, 4 KB for each of these rows. None if
    there is nothing to learn from."""
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & letters("text")).select("doc_id", "text", "lang")
    languages = docs.select("lang").distinct().count()
    rows = max(1, min(training.rows, training.all_rows // max(languages, 1)))

    def flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            packed = [np.packbits(presence([t])[0]).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("order"), pa.array(packed, type=pa.binary())], names=["lang", "order", "flags"])

    flagged = training_sample(docs, rows).mapInArrow(flags, "lang string, order long, flags binary")
    flagged = flagged.groupBy("lang", "flags").agg(F.min("order").alias("order"))
    first = flagged.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("order", "flags"))).filter(F.col("r") <= rows)
    sample = first.select("lang", "order", "flags").collect()
    if not sample:
        return None
    sample.sort(key=lambda r: (r.lang, r.order, bytes(r.flags)))
    rows = np.unpackbits(np.array([np.frombuffer(r.flags, dtype=np.uint8) for r in sample]), axis=1).astype(bool)
    return LanguageModel.fit(rows, [r.lang for r in sample], training)


def predict_languages(docs: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score (0 to 1: how clearly the language leads the others).

    ``und`` and 0 where the text is null, empty or has no letter, and everywhere if there is no model."""
    rows = docs.select(*keep, F.when(letters("text"), F.col("text")).alias("text"))
    schema = rows.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    if model is None:
        return rows.drop("text").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [i for i, t in enumerate(texts) if t is not None]
            value = m.score([texts[i] for i in found])
            lead = np.exp(8 * (value - value.max(axis=1, keepdims=True))) if len(found) else value
            said, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, k in zip(found, np.argmax(value, axis=1).tolist() if len(found) else [], strict=True):
                said[i] = m.languages[k]
            if found:
                score[found] = 1.0 / lead.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(said, type=pa.string()), f64(score)], names=schema.names)

    return rows.mapInArrow(run, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    model = fit_languages(docs.filter(fold("doc_id", 3) != 1))
    return predict_languages(docs.select("doc_id", held, "text"), model, ("doc_id", "held_out"))


QUERIES = {"op6_language": op6_language}
ORACLE_SQL: dict[str, str] = {}
