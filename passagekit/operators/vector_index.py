"""Dense search over an inverted file: k-means cells, quantised residuals, exact rescoring, filters inside the probe.

A vector (at length 1) belongs to the nearest of the cells' centroids; its
residual is kept as bytes, one scale for all, with err, its distance from what
the bytes stand for. Cells are folders of a Parquet table, so a search that
probes some reads no others, and the payload's columns are in the same rows, so
a filter is a predicate of the scan, before any limit.

search() is exact. Its first pass takes each question's `probes` nearest cells,
rescores the best of them from the vectors themselves, and has a floor, the k-th
score found. The second pass reads only cells that can hold a better one (a
member is no nearer than the question's distance from the centroid less the
cell's radius) and rescores only rows whose quantised score plus err reaches the
floor. With exact=False the first pass alone answers; probes are then those
that the build measured to be enough for `recall`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.readers import read_table
from .vectors import query_blocks, sound, unit_rows

#: Scores are worked out in single precision where they prune; they differ by less from exact ones.
SLACK = 1e-4
KIND = "qid long, id long, cell int, bound double"


@dataclass
class VectorIndex:
    """rows (id, vector, err, code, payload..., cell): a table parted by cell. The rest is small: centroids, radii, scale, probes."""

    rows: DataFrame
    centroids: Any
    radii: Any
    counts: Any
    scale: float
    probes: int


def cells_of(x, k: int, rounds: int = 10, seed: int = 3):  # noqa: ANN001, ANN201
    """At most k centroids of the rows of x."""
    import numpy as np

    c = x[np.random.default_rng(seed).permutation(len(x))[: max(1, k)]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        for j in range(len(c)):
            mine = x[own == j]
            if len(mine):
                c[j] = mine.mean(axis=0)
    return c


def nearest(x, c):  # noqa: ANN001, ANN201
    """Index of the nearest of c for each row of x."""
    import numpy as np

    return np.argmin((c**2).sum(axis=1) - 2 * (x @ c.T), axis=1)


def enough_probes(sample, c, k: int, recall: float, asked: int = 256) -> int:  # noqa: ANN001
    """How many cells hold that share of the k nearest of the sample's rows, over the first `asked` of them as questions."""
    import numpy as np

    q = sample[:asked]
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
    if not best.size:
        return 1
    near = np.argsort((c**2).sum(axis=1) - 2 * (q @ c.T), axis=1)
    place = np.argsort(near, axis=1)  # of each cell, how manieth it is probed
    own = nearest(sample, c)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def build(spark: SparkSession, vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "vector", payload: tuple[str, ...] = (), dim: int | None = None, cells: int | None = None, most_cells: int = 4096, sample: int = 1 << 15, k: int = 20, recall: float = 0.95) -> VectorIndex:
    """The index of vectors of one length (dim, or the first's), written below path.

    Centroids are fitted on about `sample` vectors, picked by a hash; there are
    twice the root of the number of vectors, most_cells at most. Vectors that
    are null, zero, of another length or hold null or non-finite components are
    not in it. ids are longs; of rows with one id the best is found.
    """
    import numpy as np

    fine = vectors.filter(sound(vec_col))
    if dim is None:
        first = fine.select(F.size(vec_col).alias("d")).first()
        dim = first["d"] if first else 1
    fine = fine.filter(F.size(vec_col) == dim).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("vector"), *payload)
    n = fine.count()
    share = min(1.0, sample / max(1, n))
    picked = fine.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < int(share * (1 << 20))).select("vector").toArrow().column(0)  # about `sample` rows
    flat = np.asarray(picked.combine_chunks().flatten(), np.float64).reshape(-1, dim)
    x = unit_rows(flat) if len(flat) else np.zeros((1, dim))
    x = x[np.lexsort(x.T[::-1])]  # the same order whatever the partitions
    x = x[np.random.default_rng(1).permutation(len(x))]
    c = cells_of(x, cells or max(1, min(most_cells, 2 * int(np.sqrt(n)), len(x) // 4)))
    left = x - c[nearest(x, c)]
    scale = max(float(np.quantile(np.abs(left), 0.9999)), 1e-9) / 127
    probes = min(len(c), enough_probes(x, c, k, recall))

    def code(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            u = unit_rows(np.asarray(batch.column(1).flatten()).reshape(-1, dim))
            cell = nearest(u, c)
            rest = u - c[cell]
            q = np.clip(np.rint(rest / scale), -127, 127).astype(np.int8)
            err = np.linalg.norm(rest - q * scale, axis=1)
            more = [pa.array(err.astype(np.float32)), pa.array(np.linalg.norm(rest, axis=1)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(cell.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "err", "away", "code", "cell"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fine.schema)
    coded = fine.mapInArrow(code, f"{kind}, err float, away double, code binary, cell int")
    # a cell goes to a few files, of which a hot one gets as many as its rows ask for
    rows = coded.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(max(1, n // 1_000_000)))).write.mode("overwrite").partitionBy("cell")
    for name in payload:  # so that a filter skips files that hold none of its values
        rows = rows.option(f"parquet.bloom.filter.enabled#{name}", "true")
    rows.parquet(f"{path}/rows")
    stats = {r["cell"]: (r["r"], r["n"]) for r in spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect()} if n else {}
    facts = {"dim": dim, "scale": scale, "probes": probes, "centroids": c.tolist(), "radii": [stats.get(j, (0.0, 0))[0] for j in range(len(c))], "counts": [stats.get(j, (0.0, 0))[1] for j in range(len(c))]}
    spark.createDataFrame([(json.dumps(facts), coded.schema.json())], "facts string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """The index that build() wrote; FileNotFoundError where there is none."""
    import numpy as np
    from pyspark.sql.types import StructType

    got = read_table(spark, f"{path}/facts").first()
    f, kind = json.loads(got["facts"]), StructType.fromJson(json.loads(got["kind"]))
    rows = spark.read.schema(kind).parquet(f"{path}/rows")
    return VectorIndex(rows, np.array(f["centroids"]).reshape(-1, f["dim"]), np.array(f["radii"]), np.array(f["counts"]), f["scale"], f["probes"])


def _probe(index: VectorIndex, ids, q, cells, floors, k: int, where: Column | None) -> DataFrame:  # noqa: ANN001
    """(qid, id, cell, bound) of rows in the probed cells: a bound of the score for each question (cells: a mask, questions x cells).

    Left out are rows that can't be among the k best: their bound is below the question's floor, or k others of
    their cell and batch are better for certain.
    """
    import numpy as np

    c, scale = index.centroids.astype(np.float32), index.scale
    asked = {int(j): np.flatnonzero(cells[:, j]) for j in np.flatnonzero(cells.any(axis=0) & (index.counts > 0))}
    q = q.astype(np.float32)
    rows = index.rows.filter(F.col("cell").isin(list(asked)))  # folders of other cells aren't listed
    rows = (rows if where is None else rows.filter(where)).select("id", "err", "code", "cell")

    def near(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            of = np.asarray(batch.column(3))
            out: list[tuple] = []
            for j in np.unique(of):
                at = np.flatnonzero(of == j)
                rid, err = (np.asarray(batch.column(k).take(at)) for k in (0, 1))
                code = np.frombuffer(b"".join(batch.column(2).take(at).to_pylist()), np.int8).reshape(len(at), -1)
                u = c[j] + code * np.float32(scale)
                for i in range(0, len(asked[int(j)]), 512):
                    mine = asked[int(j)][i : i + 512]
                    s = q[mine] @ u.T
                    keep = s + err + SLACK >= floors[mine, None]
                    if k < s.shape[1]:
                        keep &= s + err + SLACK >= -np.partition(err - s, k - 1, axis=1)[:, k - 1 : k] - SLACK
                    a, b = np.nonzero(keep)
                    out.append((ids[mine[a]], rid[b], np.full(len(a), j, np.int32), (s[a, b] + err[b]).astype(np.float64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["qid", "id", "cell", "bound"])

    return rows.mapInArrow(near, KIND)


def _rescored(index: VectorIndex, hits: DataFrame, ids, q, where: Column | None) -> DataFrame:  # noqa: ANN001
    """(qid, id, score) of hits, by cosine in double precision from the vectors, to twelve digits."""
    named = {int(i): r for r, i in enumerate(ids)}
    rows = index.rows if where is None else index.rows.filter(where)
    met = hits.select("qid", "id", "cell").distinct().join(rows.select("id", "cell", "vector"), ["id", "cell"])

    def score(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                v = unit_rows(np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1))
                own = q[[named[i] for i in batch.column(0).to_pylist()]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(np.einsum("nd,nd->n", v, own), 12))], ["qid", "id", "score"])

    return met.select("qid", "id", "vector").mapInArrow(score, "qid long, id long, score double")


def _once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("qid", "id").agg(F.max("score").alias("score"))


def _top(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return rows.withColumn("rank", rank - 1).filter(F.col("rank") < k)


def search(index: VectorIndex, queries: DataFrame, k: int = 20, where: Column | None = None, qid: str = "qid", vec_col: str = "vector", exact: bool = True, probes: int | None = None, refine: int = 4, keep: Callable[[DataFrame], DataFrame] = lambda t: t, report: list | None = None) -> DataFrame:
    """(qid, id, score, rank from 0): each question's k nearest by cosine among the rows that pass where; ties to the smaller id.

    A question id occurs once. Unsound vectors, and those of another length than
    the index's, find nothing. keep is applied to what is read twice. Questions
    go through in blocks that fit a task. report gets a row a block: questions,
    cells, and cells read by the first pass and the second, for all questions.
    exact=False skips the second pass, but for questions that the first leaves
    with fewer than k rows, which a filter does to cells.
    """
    import numpy as np

    out = queries.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    c = index.centroids
    for block in query_blocks(queries, qid, vec_col, 1 << 20):
        if c.shape[1] not in block:
            continue
        ids, q = block[c.shape[1]]
        away = np.sqrt(np.maximum(1 + (c**2).sum(axis=1) - 2 * (q @ c.T), 0))
        first = np.argsort(np.argsort(away, axis=1), axis=1) < (probes or index.probes)
        low = np.full(len(q), -np.inf)
        hits = _probe(index, ids, q, first, low, k, where)
        order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), "id")
        hits = hits.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= refine * k)
        found = keep(_top(_once(_rescored(index, hits, ids, q, where)), k))
        got = {r["qid"]: (r["n"], r["floor"]) for r in found.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).collect()}  # a row a question
        floors = np.array([got[i][1] if i in got and got[i][0] >= k else -np.inf for i in ids.tolist()])
        reach = 1 - np.maximum(away - index.radii, 0) ** 2 / 2 >= floors[:, None] - SLACK
        if not exact:
            reach &= np.isneginf(floors)[:, None]
        if report is not None:
            there = index.counts > 0
            report.append({"questions": len(q), "cells": int(there.sum()) * len(q), "first": int((first & there).sum()), "second": int((reach & there).sum())})
        if reach.any():
            more = _rescored(index, _probe(index, ids, q, reach, floors, k, where), ids, q, where)
            found = _top(_once(found.select("qid", "id", "score").unionByName(more)), k)
        out = out.unionByName(found.select("qid", "id", "score", "rank"))
    return out
