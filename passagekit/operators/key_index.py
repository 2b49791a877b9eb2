"""Records by key without a scan or a shuffle: a table bucketed and sorted by the key.

A look-up of keys reads their buckets alone, and two tables with equal buckets
join where they lie. The table's place and layout are a small file beside it, so
any session can open it again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.readers import read_table


def write(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """df as table `name` below path, in buckets of key, each a file sorted by it; what was there is overwritten."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")
    rows = df.repartition(buckets, key)  # one writer a bucket
    rows.write.mode("overwrite").option("path", f"{path}/rows").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
    facts = json.dumps({"key": key, "buckets": buckets, "schema": json.loads(df.schema.json())})
    spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return spark.table(name)


def open(spark: SparkSession, name: str, path: str) -> DataFrame:  # noqa: A001
    """The table that write() made, under `name` in this session; FileNotFoundError where there is none."""
    facts = json.loads(read_table(spark, f"{path}/facts").first()[0])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(facts["schema"]))
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({fields}) USING parquet CLUSTERED BY (`{facts['key']}`) SORTED BY (`{facts['key']}`) INTO {facts['buckets']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def lookup(table: DataFrame, key: str, values: list) -> DataFrame:
    """The rows of these keys; only their buckets are read."""
    return table.filter(F.col(key).isin(values))


def join(table: DataFrame, other: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """table with other's columns, by key; where other is bucketed alike neither side is shuffled."""
    return table.join(other.hint("merge"), key, how)
