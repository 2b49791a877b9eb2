"""IDF-weighted coverage of a query's roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import idf

POOL_CAP = 60


def root_weights(roots: DataFrame, posts: DataFrame, n: Column, qid: str = "qid") -> DataFrame:
    """(qid, root, ord, idf) for the roots that the index has; posts: (root, doc) once each."""
    df = posts.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("df"))
    return roots.join(df, "root").select(qid, "root", "ord", idf(n, F.col("df")).alias("idf"))


def candidates(weights: DataFrame, posts: DataFrame, qid: str = "qid", cap: int = POOL_CAP, digits: int = 4) -> DataFrame:
    """(qid, doc, score, rank from 0): the cap best sums of idf; ties to the root named first, then the smaller doc.

    Filters belong after this limit.
    """
    hits = weights.join(posts, "root").groupBy(qid, "doc").agg(F.sum("idf").alias("s"), F.min("ord").alias("o"))
    order = Window.partitionBy(qid).orderBy(F.round("s", 9).desc(), "o", "doc")
    # filtered by the row number itself, so that every task passes on its cap best alone and no task sorts all of a question's documents
    hits = hits.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= cap)
    return hits.select(qid, "doc", F.round("s", digits).alias("score"), (F.col("rn") - 1).alias("rank"))


def fractions(pairs: DataFrame, weights: DataFrame, posts: DataFrame, qid: str = "qid") -> DataFrame:
    """pairs (qid, doc, ...) with cov: the share of the query's idf that the document has; 1 where there is none to have."""
    total = weights.groupBy(qid).agg(F.sum("idf").alias("__all"), F.count(F.lit(1)).alias("n_roots"))
    got = pairs.select(qid, "doc").distinct().join(weights, qid).join(posts, ["root", "doc"], "left_semi")
    got = got.groupBy(qid, "doc").agg(F.sum("idf").alias("__got"))
    out = pairs.join(total, qid, "left").join(got, [qid, "doc"], "left")
    cov = F.coalesce(F.coalesce("__got", F.lit(0.0)) / F.nullif(F.col("__all"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("cov", cov).withColumn("n_roots", F.coalesce("n_roots", F.lit(0))).drop("__all", "__got")
