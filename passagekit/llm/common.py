"""Shared pieces of the training-data operators: scratch tables, patterns, folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: ASCII white space as Java regular expressions.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written to the shared folder to cut lineage.

    ``put`` writes and rereads a DataFrame, so that later steps neither repeat
    its work nor depend on blocks of one executor; ``drop`` deletes a table that
    no later step reads. Tables that a returned DataFrame still reads stay, for
    whoever clears the shared folder after the job.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out  # held, so that the number stays its own
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows joined to groups (one row for each value of keys, none null), of which size says how many rows it has.

    A group above a ten-thousandth of total rows (and above 1000) would fill a task of a shuffled join. There are
    under 10,000 of those, so they are broadcast; rows of all others meet their group by a shuffle.
    """
    heavy = groups.filter(F.col(size) > max(1000, total // 10_000))
    light = groups.filter(F.col(size) <= max(1000, total // 10_000))
    hot = F.broadcast(heavy)
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))
