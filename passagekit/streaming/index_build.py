"""Incremental builds: whatever files are new since the last run, once each, resumable from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import segments


def build_vectors(spark: SparkSession, source: str, schema: StructType, embed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_a_batch: int = 64) -> int:
    """Embed the new files of source and add them to the table at out; returns the rows added.

    A batch writes its own folder, over what a broken attempt left there, so a
    rerun after a failure neither repeats nor loses rows. latest() reads the
    table with the last row of each id.
    """
    added: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        rows = embed(batch)
        rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")
        added.append(spark.read.parquet(f"{out}/part={number}").count())

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sum(added)


def build_sparse(spark: SparkSession, source: str, schema: StructType, index: str, checkpoint: str, id_col: str, text: Column, files_a_batch: int = 64) -> int:
    """Append the new files of source to the segmented index; returns the batches that were added.

    A batch is named by its number in this checkpoint, so one that is run again after a failure adds nothing.
    """
    added: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        if segments.append(spark, index, batch, id_col, text, batch=f"{checkpoint}#{number}"):
            added.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return len(added)


def build_both(spark: SparkSession, source: str, schema: StructType, embed: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, id_col: str, text: Column, files_a_batch: int = 64) -> tuple[int, int]:
    """Dense and sparse index of the new files, each resumable by itself: (rows embedded, batches added) below out/vectors and out/sparse."""
    rows = build_vectors(spark, source, schema, embed, f"{out}/vectors", f"{checkpoint}/vectors", files_a_batch)
    return rows, build_sparse(spark, source, schema, f"{out}/sparse", f"{checkpoint}/sparse", id_col, text, files_a_batch)


def latest(spark: SparkSession, out: str, id_col: str = "id") -> DataFrame:
    """The table that build_vectors made: of each id the row of the last batch."""
    rows = spark.read.parquet(out)
    rn = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("batch").desc()))
    return rows.withColumn("__rn", rn).filter("__rn = 1").drop("__rn", "batch", "part")


def running_feedback(events: DataFrame, keys: list[str]) -> DataFrame:
    """A streaming upsert: the last rating and the first question and answer of each key (update mode)."""
    return events.groupBy(*keys).agg(
        F.max_by("rating", "created_at").alias("rating"), F.max("created_at").alias("created_at"), F.min_by("question", "created_at").alias("question"), F.min_by("answer", "created_at").alias("answer")
    )
