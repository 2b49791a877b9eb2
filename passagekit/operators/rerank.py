"""Re-ranking, the gates on its scores, and the scorer hook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import coverage_blend
from ..functions.text import tokens

MIN_SCORE, MIN_RESULTS, FULL = 0.01, 3, 0.999


def jaccard(query: Column, passage: Column) -> Column:
    """Shared over all distinct words: the deterministic stand-in for a cross-encoder."""
    return shared_words(F.array_distinct(tokens(query)), F.array_distinct(tokens(passage)))


def shared_words(a: Column, b: Column) -> Column:
    """jaccard() of texts that are at hand as arrays of their distinct words."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def rerank(pool: DataFrame, score: Column, k: int | None = None, qid: str = "qid", pos: str = "pos") -> DataFrame:
    """pool with rerank_score and rerank_rank (from 0), best first, ties in pool order; scores equal to nine digits tie."""
    rows = pool.withColumn("rerank_score", score)
    rows = rows.withColumn("rerank_rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.round("rerank_score", 9).desc(), pos)) - 1)
    return rows if k is None else rows.filter(F.col("rerank_rank") < k)


def blended(ranked: DataFrame, floor: float = 0.25, qid: str = "qid") -> DataFrame:
    """Scores of queries with roots times floor + (1 - floor) x cov, ranked anew; needs cov and n_roots."""
    has = F.col("n_roots") > 0
    rows = ranked.withColumn("rerank_score", F.when(has, coverage_blend(F.col("rerank_score"), F.col("cov"), floor)).otherwise(F.col("rerank_score")))
    return rows.withColumn("rerank_rank", F.row_number().over(Window.partitionBy(qid).orderBy(F.round("rerank_score", 9).desc(), "rerank_rank")) - 1)


def full_coverage_gate(ranked: DataFrame, least: int = MIN_RESULTS, qid: str = "qid") -> DataFrame:
    """Of queries with two roots or more and `least` rows that cover all, only those rows."""
    full = F.col("cov") >= FULL
    n = F.sum(full.cast("int")).over(Window.partitionBy(qid))
    return ranked.withColumn("__n", n).filter((F.col("n_roots") < 2) | (F.col("__n") < least) | full).drop("__n")


def threshold(ranked: DataFrame, least_score: float = MIN_SCORE, fallback: int = MIN_RESULTS, limit: int = 10, qid: str = "qid") -> DataFrame:
    """Rows of at least least_score; only where a query has none, its first `fallback`; then the limit. rank from 0."""
    by = Window.partitionBy(qid)
    rows = ranked.withColumn("__keep", F.col("rerank_score") >= least_score)
    rows = rows.withColumn("__any", F.max("__keep").over(by)).withColumn("__rn", F.row_number().over(by.orderBy("rerank_rank")))
    rows = rows.filter(F.col("__keep") | (~F.col("__any") & (F.col("__rn") <= fallback)))
    rank = F.row_number().over(by.orderBy("rerank_rank")) - 1
    return rows.withColumn("rank", rank).filter(F.col("rank") < limit).drop("__keep", "__any", "__rn")
