"""Retrieval metrics: hit rate, recall and mean reciprocal rank at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, relevant: DataFrame, k: int, qid: str = "qid") -> DataFrame:
    """One row: hit_rate, recall, mrr over the queries of relevant.

    ranked: (qid, doc, rank from 0); relevant: (qid, doc) once each.
    """
    rel = relevant.select(qid, "doc").distinct()
    hits = rel.join(ranked.filter(F.col("rank") < k).select(qid, "doc", "rank"), [qid, "doc"], "left")
    each = hits.groupBy(qid).agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("got"), F.min("rank").alias("first"))
    return each.agg(
        F.avg((F.col("got") > 0).cast("double")).alias("hit_rate"),
        F.avg(F.col("got") / F.col("n")).alias("recall"),
        F.avg(F.coalesce(1.0 / (F.col("first") + 1), F.lit(0.0))).alias("mrr"),
    )
