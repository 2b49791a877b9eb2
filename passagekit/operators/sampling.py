"""Rows at even distances within groups of any size, without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with pos (from 0, in order of `order` within the key) and n (the key's rows); null is a key like others.

    One range exchange writes the rows in sorted parts; a row's number is its rank within its part and key plus the
    key's rows in earlier parts. A large key spans many parts, so no task holds a whole one; the counts are one row
    per part and key.
    """
    parts = materialized(rows.repartitionByRange(F.col(key), *order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy(F.col(key).alias("__key"), "__part").agg(F.count(F.lit(1)).alias("__rows"))
    upto = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__key", F.col("__part").alias("__at"), F.coalesce(F.sum("__rows").over(upto), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy("__key")).alias("n"))
    own = F.row_number().over(Window.partitionBy("__part", key).orderBy(*order)) - 1
    ranked = parts.withColumn("__own", own)
    out = ranked.join(counts, ranked[key].eqNullSafe(counts["__key"]) & (ranked["__part"] == counts["__at"]))
    return out.withColumn("pos", F.col("__before") + F.col("__own")).drop("__part", "__own", "__key", "__at", "__before")


def even_rows(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The rows at floor(i * n / k) for i below k of each key's n rows, all where there are no more than k; with pos and n."""
    at = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (F.col("n") / F.lit(float(k)))) == F.col("pos"))
    return numbered(rows, key, order).filter((F.col("n") <= k) | at)
