"""Scores as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    """1 / (k + rank), rank from 0; an absent rank gives 0."""
    return F.coalesce(1.0 / (F.lit(float(k)) + rank), F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.log(n / F.greatest(df, F.lit(1)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector has no length."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def coverage_blend(score: Column, coverage: Column, floor: float = 0.25) -> Column:
    return score * (F.lit(floor) + F.lit(1.0 - floor) * coverage)
