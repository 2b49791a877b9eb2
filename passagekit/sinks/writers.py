"""Sinks. Stage and index tables are overwritten whole, so that a rerun gives the same table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.readers import keep_last


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, options: dict[str, str] | None = None) -> None:
    w = df.write.mode("overwrite").options(**(options or {}))
    w = w.option("compression", "zstd") if fmt == "parquet" else w
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of an index under its own name."""
    for name, df in tables.items():
        write_stage(df, f"{path}/{name}")


def last_vectors(df: DataFrame, id_col: str, order: Column, dim: int | None = None) -> DataFrame:
    """One vector per id, the last; vectors of another length than dim fail the job."""
    out = keep_last(df, [id_col], order)
    if dim is not None:
        wrong = F.raise_error(F.concat(F.lit(f"a vector has not {dim} components: id "), F.col(id_col).cast("string")))
        out = out.withColumn(id_col, F.when(F.size("vector") == dim, F.col(id_col)).otherwise(wrong.cast(out.schema[id_col].dataType)))
    return out


def upsert_vectors(existing: DataFrame | None, batch: DataFrame, id_col: str = "id") -> DataFrame:
    """existing with batch's rows put in: the batch wins on an id."""
    new = batch.withColumn("__gen", F.lit(1))
    rows = new if existing is None else existing.withColumn("__gen", F.lit(0)).unionByName(new)
    return keep_last(rows, [id_col], F.col("__gen")).drop("__gen")


def create_vectors(spark: SparkSession, path: str, columns: StructType, filters: list[str] | None = None, recreate: bool = False) -> None:
    """An empty vector table, its folders parted by the fields that searches filter on; one that is there stays, unless recreate."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if recreate or not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        spark.createDataFrame([], columns).write.mode("overwrite").partitionBy(*(filters or [])).parquet(path)


def sse_line(event: Column) -> Column:
    """A struct as one server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))
