"""Vector expressions over ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    a = F.transform(a, lambda x: x.cast("double"))
    # The length is bound once by the outer lambda, not worked out again for every component.
    return F.get(F.transform(F.array(F.nullif(norm(a), F.lit(0.0))), lambda n: F.when(n.isNull(), a).otherwise(F.transform(a, lambda x: x / n))), F.lit(0))


def aligned(a: Column, b: Column) -> Column:
    """Average of two vectors, renormalised."""
    return unit(F.zip_with(a, b, lambda x, y: (x + y) / 2))


def weighted(vectors: list[Column], weights: list[float]) -> Column:
    """Weighted mean over the vectors that are present, weights renormalised; null if none is."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(vectors, weights)), F.lit(0.0))
    parts = F.filter(F.array(*[F.when(v.isNotNull(), _scaled(v, w)) for v, w in zip(vectors, weights)]), lambda v: v.isNotNull())
    summed = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.get(parts, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(parts) > 0, F.transform(summed, lambda x: x / total))


def _scaled(v: Column, w: float) -> Column:
    return F.transform(v, lambda x: x * w)


def concatenated(vectors: list[Column], dim: int) -> Column:
    """The vectors that are present one after the other, cut or padded with zeros to ``dim``; null if none is."""
    parts = F.filter(F.array(*vectors), lambda v: v.isNotNull())
    padded = F.concat(F.flatten(parts), F.array_repeat(F.lit(0.0), dim))
    return F.when(F.size(parts) > 0, F.slice(padded, 1, dim))


def softmax_fusion(vectors: list[Column], scores: list[Column]) -> Column:
    """Fusion with softmax weights of the scores."""
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = sum(e[1:], e[0])
    out = _by(vectors[0], e[0] / total)
    for v, x in zip(vectors[1:], e[1:]):
        out = F.zip_with(out, _by(v, x / total), lambda a, b: a + b)
    return out


def _by(v: Column, w: Column) -> Column:
    return F.transform(v, lambda x: x * w)


def project(v: Column, matrix: list[list[float]]) -> Column:
    """Matrix (rows of output) times vector."""
    return F.array(*[dot(v, F.array(*map(F.lit, row))) for row in matrix])


def md5_bytes(token: Column) -> Column:
    """The token's 16 md5 bytes as doubles."""
    digest = F.md5(token.cast("binary"))
    return F.array(*[F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") for i in range(16)])
