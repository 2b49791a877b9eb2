"""The corpus pipeline: stages over documents, each calling one operator of passagekit.llm.

Every stage works on all rows its predecessor kept and, but for the last,
returns rows with the columns of documents. run() hands a stage's result on as
a Parquet table in the shared folder, as the stages' callers do.

Null texts count as empty: they are not toxic unless empty texts are, are copies
of each other, take no words of a mix and make sequences of one end id. Null ids
and sources are values like others (of copies, a row without an id stays only
where no other is there); repeated rows are copies of each other; other columns
are carried along whatever their names. An empty table passes every stage and
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.common import Scratch
from passagekit.llm.exact_dedup import drop_exact_copies
from passagekit.llm.mixing import mix
from passagekit.llm.packing import pack, pieces
from passagekit.llm.simhash import drop_near_copies
from passagekit.llm.toxicity import score_toxicity, train, training_labels


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for toxic go; it learns from the training folds of labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, training_labels(labels))
    return score_toxicity(docs, model, out="__toxicity").filter(F.col("__toxicity.score") < 0.5).drop("__toxicity")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity of 0.8 or more) stays, the one with the smallest id."""
    return drop_near_copies(docs, shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those that it doesn't take go. Whole rows come back, whatever their columns' names."""
    rows = docs.select("doc_id", "source", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"))
    mixed = mix(rows).filter("repeats > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("repeats"))))
    return mixed.select("__row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 ids."""
    cut = pieces(docs, capacity=2048, end_id=0)
    return pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The stages learn a classifier and pack by local search, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
