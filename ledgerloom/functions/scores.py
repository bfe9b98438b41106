"""Ranking scores as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_of(output: Column, target: Column) -> Column:
    """1-based rank; 0 if absent or the ranking is NULL."""
    return F.coalesce(F.array_position(output, target), F.lit(0))


def hit(output: Column, target: Column, k: int) -> Column:
    return F.when(rank_of(output, target).between(1, k), 1.0).otherwise(0.0)


def ndcg(output: Column, target: Column, k: int) -> Column:
    """With one relevant item: 1 / log2(rank + 1) within the first k, else 0."""
    rank = rank_of(output, target)
    return F.when(rank.between(1, k), 1 / F.log2(rank + 1)).otherwise(0.0)


def shared_levels(a: list[Column], b: list[Column]) -> Column:
    """Share of levels at which two codes agree, position by position; NULL codes agree nowhere."""
    return sum((F.when(x == y, 1).otherwise(0) for x, y in zip(a, b, strict=True)), F.lit(0)) / F.lit(float(len(a)))


def shared_prefix(a: list[Column], b: list[Column]) -> Column:
    """Number of leading levels that agree."""
    out = F.lit(0)
    for x, y in reversed(list(zip(a, b, strict=True))):
        out = F.when(x == y, out + 1).otherwise(0)
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL if either is, norms at least 1e-8."""
    norm = lambda v: F.greatest(F.sqrt(dot(v, v)), F.lit(1e-8))
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalised(v: Column) -> Column:
    """The vector divided by its norm; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))
