"""Exact vector search in blocks, and the embedding hook.

Each query meets every vector, which is what exact search asks for; the stored
vectors are scanned once a block of queries and stay where they are, and
per-task top-k rows are all that is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import cosine

#: Products of a question and a vector that a task has at least, where there are as many.
PAIRS = 1 << 22
FILTER_KEYS = ("surah_number", "period", "juz")


def equality_filter(filters: dict | None, allowed: tuple[str, ...] = FILTER_KEYS) -> Column:
    """All of the given keys equal their values; null values and unknown keys say nothing."""
    conds = [F.col(k) == v for k, v in (filters or {}).items() if k in allowed and v is not None]
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def sound(vec: str) -> Column:
    """Not null, not all zero, every component there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0), F.lit(False))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "vector", where: Column | None = None, digits: int | None = None) -> DataFrame:
    """(id, score) of the k nearest by cosine to one vector; the filter is applied before the limit."""
    rows = vectors if where is None else vectors.filter(where)
    score = cosine(F.col(vec_col), F.array(*(F.lit(float(x)) for x in query)))
    score = score if digits is None else F.round(score, digits)
    return rows.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.col("score").desc_nulls_last(), "id").limit(k)


def unit_rows(x):  # noqa: ANN001, ANN201
    """Rows at length 1; safe for any finite doubles."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def query_blocks(queries: DataFrame, qid: str, vec_col: str, most: int = 1 << 22) -> Iterator[dict]:
    """The sound vectors of queries (id a long) in blocks of about `most` numbers, one after the other: {length: (ids, unit vectors)}.

    A block is what a task holds next to its own rows; each is sent once, whatever the number of tasks' rows.
    """
    import numpy as np

    asked = queries.filter(sound(vec_col)).select(F.col(qid).cast("long").alias("qid"), F.transform(vec_col, lambda x: x.cast("double")).alias("q"))
    size = asked.agg(F.sum(F.size("q"))).first()[0] or 0
    blocks = -(-size // most)
    for b in range(blocks):
        rows = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid", "q"), F.lit(blocks)) == b)).toArrow()
        block: dict[int, tuple[list, list]] = {}
        for q, v in zip(rows.column("qid").to_pylist(), rows.column("q").to_pylist(), strict=True):
            ids, vecs = block.setdefault(len(v), ([], []))
            ids.append(q)
            vecs.append(v)
        yield {dim: (np.array(ids), unit_rows(np.array(vecs))) for dim, (ids, vecs) in block.items()}


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, qid: str = "qid", id_col: str = "id", vec_col: str = "vector", block: int = 1 << 22) -> DataFrame:
    """(qid, id, score, rank from 0) for a table of queries (qid, vector).

    Vectors stay where they are: each block of queries (of about `block` numbers)
    goes to all tasks, which give only the k best of every query among their own
    rows. Vectors that are null, all zero or hold null or non-finite components
    take no part on either side; only vectors of one length meet. Scores are
    rounded to twelve digits, so that equal vectors tie, by id.
    """
    stored = vectors.filter(sound(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    hits = stored.sparkSession.createDataFrame([], "qid long, id long, score double")
    n = vectors.count()
    for asked in query_blocks(queries, qid, "vector", block):
        # a task has some millions of products at least, as each gives k rows a query
        tasks = max(1, -(-n * sum(len(ids) for ids, _ in asked.values()) // PAIRS))
        hits = hits.unionByName(stored.coalesce(tasks).mapInArrow(_best_of(asked, k), "qid long, id long, score double"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", rank - 1).filter(F.col("rank") < k)


def _best_of(asked: dict, k: int, piece: int = 512) -> Callable[[Iterator], Iterator]:
    """A task's k best of every query, cut back as its batches go by."""

    def cut(rows: list) -> tuple:
        import numpy as np

        at, ids, s = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((ids, -s, at))
        at, ids, s = at[order], ids[order], s[order]
        first = np.searchsorted(at, at)
        fine = np.arange(len(at)) - first < k
        return at[fine], ids[fine], s[fine]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        best: dict[int, list] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for dim in map(int, np.unique(sizes)):
                if dim not in asked:
                    continue
                at = np.flatnonzero(sizes == dim)
                ids = np.asarray(batch.column(0).take(at))
                v = unit_rows(np.asarray(batch.column(1).take(at).flatten()).reshape(-1, dim))
                _, q = asked[dim]
                rows = best.setdefault(dim, [])
                for i in range(0, len(q), piece):
                    s = np.round(q[i : i + piece] @ v.T, 12)
                    kth = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if 0 < k < s.shape[1] else -np.inf
                    a, b = np.nonzero(s >= kth)
                    rows.append((a + i, ids[b], s[a, b]))
                if sum(len(r[0]) for r in rows) > 8 * k * len(q):
                    rows[:] = [cut(rows)]
        for dim, rows in best.items():
            at, ids, s = cut(rows)
            yield pa.RecordBatch.from_arrays([pa.array(asked[dim][0][at]), pa.array(ids), pa.array(s)], ["qid", "id", "score"])

    return run


def hash_embedder(dim: int = 256) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed hashed words and letter triples, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = np.zeros((len(texts), dim))
        for k, t in enumerate(texts):
            low = t.lower()
            for w in low.split() + [low[i : i + 3] for i in range(max(0, len(low) - 2))]:
                h = zlib.crc32(w.encode())
                out[k, h % dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()

    return embed


def embed(df: DataFrame, text: Column, make: Callable[[], Callable[[list[str]], list[list[float]]]] = hash_embedder, batch: int = 32, out: str = "vector") -> DataFrame:
    """df with a vector column; `make` builds the model once per task."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in parts:
            vecs: list = []
            values = texts.fillna("").tolist()
            for i in range(0, len(values), batch):
                vecs += model(values[i : i + batch])
            yield pd.Series(vecs, index=texts.index)

    return df.withColumn(out, run(text))
