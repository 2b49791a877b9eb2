"""Reciprocal rank fusion of two ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import reciprocal_rank
from .sampling import numbered

RRF_K = 60


def rrf(a: DataFrame, b: DataFrame, k: int = 5, rrf_k: int = RRF_K, keys: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """a, b: (keys..., id, rank from 0). (keys..., id, score): the k best sums of 1 / (rrf_k + rank), ties to the smaller id.

    Ids in one list only get that list's share. keys name the query columns of a batch.
    """
    on = [*keys, "id"]
    both = a.select(*on, F.col("rank").alias("ra")).join(b.select(*on, F.col("rank").alias("rb")), on, "full_outer")
    both = both.select(*on, F.round(reciprocal_rank(F.col("ra"), rrf_k) + reciprocal_rank(F.col("rb"), rrf_k), digits).alias("score"))
    if not keys:
        return both.orderBy(F.col("score").desc(), "id").limit(k)
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return both.withColumn("__rn", rn).filter(F.col("__rn") <= k).drop("__rn")


def keep_first_union(*lists: DataFrame, keys: tuple[str, ...] = (), id_col: str = "id", most: int | None = None, first_rank: int = 0) -> DataFrame:
    """Ranked lists (keys..., id, rank, score) one after the other, each id once, where it first comes; pos from 0.

    Ranks count from first_rank, without gaps; most cuts each list before the union.
    """
    rows = None
    for n, part in enumerate(lists):
        if most is not None:  # what stands beyond `most` of its own list can't be among the first `most` of all
            part = part.filter(F.col("rank") < F.lit(most) + F.lit(first_rank))
        part = part.withColumn("src", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    first = F.row_number().over(Window.partitionBy(*keys, id_col).orderBy("src", "rank"))
    rows = rows.withColumn("__rn", first).filter("__rn = 1").drop("__rn")
    if not keys and most is None:  # lists of any length: numbered part by part
        return numbered(rows.withColumn("__all", F.lit(0)), "__all", ["src", "rank", id_col]).drop("__all", "n")
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("src", "rank") if keys else Window.orderBy("src", "rank")) - 1
    rows = rows.withColumn("pos", pos)
    return rows if most is None else rows.filter(F.col("pos") < most)
