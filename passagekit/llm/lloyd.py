"""Plain Lloyd clustering of integer vectors.

Vectors become integers once and are written to a table. Every round sends the
centroids (k rows of dim integers, a bound of parameters) to all tasks; a task
takes the integer squared differences to each centroid in NumPy, the lowest
index of the least, and gives one row of sums a centroid and component. Those
merge in a groupBy, and the driver divides k x dim totals. All arithmetic is of
integers, so the order of rows and tasks never shows in the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Components of this size or more would let a squared distance of 64 components outgrow a long.
WIDEST = 1 << 27


def whole(x: Column, scale: int, widest: int = WIDEST) -> Column:
    """floor(scale * x) of a number as double; an error beyond what a squared distance can hold."""
    y = F.floor(F.lit(scale) * x.cast("double"))
    return F.when(F.abs(x.cast("double")) < widest / scale, y).otherwise(F.raise_error(F.concat(F.lit("component too large: "), x.cast("string"))).cast("long"))


def finite(vec: str) -> Column:
    """Not null, every component there and finite."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def nearest_centroid(x, centroids):  # noqa: ANN001, ANN202
    """(index of the nearest of centroids, lowest of equals; squared distance) for each row of x; both of int64."""
    import numpy as np

    dist = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = x - c
        dist[:, k] = np.einsum("nd,nd->n", d, d)
    own = np.argmin(dist, axis=1)  # the first of equals
    return own, dist[np.arange(len(x)), own]


def _rows(batch: pd.DataFrame, dim: int):  # noqa: ANN202
    import numpy as np

    return np.concatenate(batch["x"].to_numpy()).astype(np.int64).reshape(len(batch), dim)


def _totals(vecs: DataFrame, centroids: list[list[int]], dim: int) -> dict[int, tuple[int, list[int]]]:
    """(number, sum of each component) of every centroid that has vectors."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        c = np.array(centroids, np.int64)
        sums, many = np.zeros((len(c), dim), np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            if len(batch):
                x = _rows(batch, dim)
                own, _ = nearest_centroid(x, c)
                np.add.at(sums, own, x)
                many += np.bincount(own, minlength=len(c))
        there = np.flatnonzero(many)
        yield pd.DataFrame({"cluster": np.repeat(there, dim), "i": np.tile(np.arange(dim), len(there)), "n": np.repeat(many[there], dim), "s": sums[there].ravel()})

    part = vecs.select("x").mapInPandas(add, "cluster int, i int, n long, s long")
    wide = "decimal(38,0)"
    total = part.groupBy("cluster", "i").agg(F.sum(F.col("n").cast(wide)).alias("n"), F.sum(F.col("s").cast(wide)).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.collect():  # k x dim rows
        out.setdefault(r["cluster"], (int(r["n"]), [0] * dim))[1][r["i"]] = int(r["s"])
    return out


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, salt: str = "1:", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of dim finite components.

    Components become floor(scale * x). Centroids start as the k vectors whose
    sha256 of salt and id comes first; rounds times every vector goes to its
    nearest centroid (of equally near ones the first) and every centroid that has
    vectors to the floor of their mean. Then vectors are assigned once more.

    Vectors that are null, of another length or hold null or non-finite
    components take no part. Repeated rows count each; of starts with one id the
    smaller vector is first; rows without an id are clustered, but start last.
    Under k vectors make as many centroids. An empty table gives no rows; other
    columns are ignored. A component of 2**27 or more after scaling, whose
    squared distances a long may not hold, raises an error.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "lloyd")
    kept = df.filter((F.size(vec_col) == dim) & finite(vec_col))
    widest = min(WIDEST, int((2**61 // dim) ** 0.5))
    vecs = scratch.put(kept.select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: whole(x, scale, widest).cast("int")).alias("x")))
    named = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    first = vecs.select(named.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    centroids = [[int(v) for v in r["x"]] for r in first]
    for _ in range(rounds if centroids else 0):
        for c, (n, sums) in _totals(vecs, centroids, dim).items():
            centroids[c] = [s // n for s in sums]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        c = np.array(centroids, np.int64)
        for batch in batches:
            if len(batch):
                own, dist = nearest_centroid(_rows(batch, dim), c)
                yield pd.DataFrame({"id": batch["id"], "cluster": own.astype(np.int32), "distance": dist})

    kind = vecs.schema["id"].dataType.simpleString()
    done = scratch.put(vecs.mapInPandas(assign, f"id {kind}, cluster int, distance long"))
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(c, s, sum(sums.values()), names[c]) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
