"""Whitening of embeddings by the leading eigenvectors of their covariance, found with LOBPCG.

The covariance is never formed. A product V B with a block B of columns is a sum
over rows c (the fitted vectors, centred): every task multiplies its rows with B
and gives one row a dimension, and a groupBy adds them up. Each iteration takes
one such product, of an orthonormal basis of the iterate, its residuals and the
previous directions; the Rayleigh-Ritz problem on that basis, of a few dozen
columns, is solved on the driver. What tasks and driver hold is bounded by the
dimension and the block, not by the rows.

Rows are integers, so they are centred without loss: with S = q n + r, a row is
(x - q) - r / n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .lloyd import finite, whole

#: Components of this size or more after scaling are refused: 64 sums of a batch of them stay exact.
WIDEST = 1 << 40


@dataclass
class Whitening:
    """n fitted vectors with sums S; directions (dim x m) and their eigenvalues, falling; trace of the covariance.

    residual: the largest |V y - e y| of the returned pairs, of products made anew. identity_error: the largest
    entry of the whitened rows' covariance minus the identity. passes: products that were made.
    """

    dim: int
    n: int
    sums: list[int]
    values: Any
    directions: Any
    trace: float
    residual: float
    identity_error: float
    passes: int = field(default=0)

    def parts(self):  # noqa: ANN201
        """(q, r / n): what rows are centred by."""
        return _parts(self.sums, self.n)


def _parts(sums: list[int], n: int):  # noqa: ANN202
    import numpy as np

    return np.array([s // n for s in sums], np.int64), np.array([(s % n) / n for s in sums])


def _matrix(column, dim: int):  # noqa: ANN001, ANN202
    import numpy as np

    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _moments(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, sums = 0, [0] * dim
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            n += len(x)
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(s) for s in sums])], ["i", "n", "s"])

    wide = "decimal(38,0)"
    part = fit.select("x").mapInArrow(add, "i int, n long, s string")
    got = part.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast(wide)).alias("s")).collect()  # dim rows
    sums = [0] * dim
    for r in got:
        sums[r["i"]] = int(r["s"])
    return (int(got[0]["n"]) if got else 0), sums


def _product(fit: DataFrame, dim: int, n: int, sums: list[int], block, own: bool = False):  # noqa: ANN001, ANN202
    """(V block, trace of V, covariance of the rows' projections on block if own): sums over centred rows, by n."""
    import numpy as np

    q, rest = _parts(sums, n)
    b = np.ascontiguousarray(block)
    cols = b.shape[1]

    def add(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        out, there = np.zeros((dim + cols * own + 1, cols)), False
        for batch in batches:
            c = (_matrix(batch.column(0), dim) - q) - rest
            z = c @ b
            out[:dim] += c.T @ z
            if own:
                out[dim:-1] += z.T @ z
            out[-1, 0] += np.einsum("nd,nd->", c, c)
            there = there or len(c) > 0
        if there:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(list(out), pa.list_(pa.float64()))], ["i", "y"])

    part = fit.select("x").mapInArrow(add, "i int, y array<double>")
    total = part.groupBy("i").agg(*(F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(cols))).collect()  # a row a dimension and column
    out = np.zeros((dim + cols * own + 1, cols))
    for r in total:
        out[r["i"]] = r[1:]
    out /= n
    return out[:dim], float(out[-1, 0]), out[dim:-1]


def _basis(*blocks):  # noqa: ANN002, ANN202
    """Orthonormal columns that span those of blocks, in their order; columns that depend on earlier ones go."""
    import numpy as np

    q = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        size = np.linalg.norm(block, axis=0)
        w = block[:, size > 0] / size[size > 0]
        for _ in range(2):  # twice is enough
            w = w - q @ (q.T @ w)
            u, s, _ = np.linalg.svd(w, full_matrices=False)
            w = u[:, s > 1e-10]
        q = np.concatenate([q, w], axis=1)[:, : len(q)]
    return q


def leading(product, dim: int, wanted: int, guard: int, tolerance: float, most: int, seed: int):  # noqa: ANN001, ANN201
    """(values, vectors, residuals, passes) of the leading pairs of a symmetric operator, falling, by LOBPCG.

    product(B) is V B. The trial space is the iterate, its residuals and the directions of the last step, made
    orthonormal together; V times that basis is taken anew each time, so that rounding doesn't build up. It ends when
    every wanted residual is below tolerance times the largest value or, having stopped falling, is as small as
    rounding lets it be (below a thousand times that); otherwise it raises after most passes.
    """
    import numpy as np

    width = min(dim, wanted + guard)
    x = _basis(np.random.default_rng(seed).standard_normal((dim, width)))
    last, best, since = np.zeros((dim, 0)), np.inf, 0
    q = x
    for passes in range(1, most + 1):
        vq = product(q)
        small = q.T @ vq
        e, y = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-e, kind="stable")[:width]
        e, y = e[order], y[:, order]
        new, vx = q @ y, vq @ y
        residual = vx - new * e
        size = np.linalg.norm(residual[:, :wanted], axis=0)
        top = max(abs(float(e[0])), np.finfo(float).tiny)
        now = float(size.max(initial=0)) / top
        since = 0 if now < best / 2 else since + 1
        best = min(best, now)
        if now <= tolerance or (since >= 3 and now <= 1000 * tolerance):
            return e[:wanted], new[:, :wanted], size, passes
        last, x = new - x @ (x.T @ new), new
        q = _basis(x, residual, last)
    raise ArithmeticError(f"residual {now:.3g} of the largest eigenvalue after {most} products; {tolerance:.3g} was asked for")


def fit(df: DataFrame, components: int = 16, scale: int = 64, shift: int = 1_000_000, vec_col: str = "embedding", guard: int = 8, tolerance: float = 1e-13, most: int = 500, seed: int = 7) -> Whitening | None:
    """The whitening of the distinct integer vectors of df; None where there are none. See whiten()."""
    import numpy as np

    scratch = Scratch(df.sparkSession, "whitening")
    sizes = df.filter(finite(vec_col) & (F.size(vec_col) > 0)).groupBy(F.size(vec_col).alias("dim")).count()
    first = sizes.orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    if first is None:
        return None
    dim = first["dim"]
    rows = scratch.put(integers(df, dim, scale, shift, vec_col).select("x").distinct())
    n, sums = _moments(rows, dim)
    trace = [0.0]

    def product(block):  # noqa: ANN001, ANN202
        out, trace[0], _ = _product(rows, dim, n, sums, block)
        return out

    wanted = min(components, dim)
    values, vectors, _, passes = leading(product, dim, wanted, guard, tolerance, most, seed)
    real = values > dim * np.finfo(float).eps * max(trace[0], 0)  # others are rounding of zero
    values, vectors = values[real], vectors[:, real]
    most_of = np.abs(vectors).argmax(axis=0) if vectors.size else np.zeros(0, int)
    vectors = vectors * np.sign(vectors[most_of, np.arange(vectors.shape[1])])
    if not len(values):
        scratch.drop(rows)
        return Whitening(dim, n, sums, values, vectors, trace[0], 0.0, 0.0, passes)
    # certified on products made anew, of the directions that are returned
    again, _, own = _product(rows, dim, n, sums, vectors / np.sqrt(values), own=True)
    residual = float(np.linalg.norm(again * np.sqrt(values) - vectors * values, axis=0).max())
    scratch.drop(rows)
    return Whitening(dim, n, sums, values, vectors, trace[0], residual, float(np.abs(own - np.eye(len(values))).max()), passes + 1)


def integers(df: DataFrame, dim: int, scale: int, shift: int, vec_col: str) -> DataFrame:
    """The rows of df whose vector has dim finite components, with x: floor(scale * c) + shift, of longs."""
    return df.filter((F.size(vec_col) == dim) & finite(vec_col)).withColumn("x", F.transform(vec_col, lambda c: whole(c, scale, WIDEST) + F.lit(shift).cast("long")))


def whiten(df: DataFrame, model: Whitening | None, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): each fitted component of each row.

    Rows whose vector is null, empty or holds null or non-finite components take
    no part, nor do those of another length than most vectors have (of equally
    many, the greater length). Repeated rows and rows without an id are whitened
    each; the fit counts every different vector once. Components without
    variance have no whitened value and no row, so one vector alone, or an empty
    table, gives none. deviation is exact; it is null where a long can't hold it.
    Other columns are ignored. A component of 2**40 or more after scaling raises
    an error.
    """
    kind = df.schema[id_col].dataType.simpleString()
    out = "id " + kind + ", component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    dim, n = model.dim, model.n
    q, rest = model.parts()
    left = [s % n for s in model.sums]
    scaled, part, error = model.directions / model.values**0.5, model.values / model.trace, model.identity_error

    def project(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        m = scaled.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _matrix(batch.column(1), dim) - q
            z = (d - rest) @ scaled
            if n * (float(np.abs(d).max(initial=0)) + 1) < (2.0**62 / dim) ** 0.5:
                own = n * d - np.array(left, np.int64)
                deviation = pa.array(np.einsum("nd,nd->n", own, own))
            else:
                exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, left, strict=True)) for row in d]
                deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            at = pa.array(np.repeat(np.arange(len(d)), m))
            many = len(d) * m
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(d))),
                    pa.array(np.full(many, n)),
                    deviation.take(at),
                    pa.array(z.ravel()),
                    pa.array(np.tile(part, len(d))),
                    pa.array(np.full(many, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    rows = integers(df, dim, scale, shift, vec_col).select(F.col(id_col).alias("id"), "x")
    return rows.mapInArrow(project, out).withColumnRenamed("id", id_col)
