"""Near-duplicate embeddings by product quantisation, without losing a pair.

Different vectors with equal labels are linked at a cosine of at least a
threshold, that is, their unit vectors are at most delta = sqrt(2 - 2 cosine)
apart. A coarse quantiser deals unit vectors into inverted lists; residuals are
coded in subspaces, and every coded vector keeps err, how far its code is from
it. Three bounds, all by the triangle inequality, decide what is compared:

* A vector v probes list c only where a member u can be within delta: |v - c| is
  within delta of the members' distances from c, and v no further beyond the
  plane between c and its own cell than delta.
* Within a list, the table-lookup distance from v to the coded u is at most
  delta + err(u) for every u within delta of v.
* What is left is compared by exact cosine in double precision.

So probes and candidates are sufficient by construction, whatever the sample the
quantisers were fitted on. Pairs never leave a task: a unit of work (a chunk of a
list and a block of the vectors that probe it, both bounded) gives one row a
linked vector, with how many it found and the least vector it is tied to.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups
from .components import components
from .graph_ann import _usable

#: Added to all bounds, which are worked out in single precision.
SLACK = 2e-3


def unit(x):  # noqa: ANN001, ANN201
    """Rows at length 1, in double precision; safe for any finite doubles."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def kmeans(x, k: int, rounds: int, seed: int):  # noqa: ANN001, ANN201
    """k centroids of the rows of x (fewer rows: fewer)."""
    import numpy as np

    c = x[np.random.default_rng(seed).permutation(len(x))[: max(1, k)]].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T - (c**2).sum(axis=1) / 2, axis=1)
        many = np.bincount(own, minlength=len(c))
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        c[many > 0] = np.add.reduceat(x[order], first, axis=0) / many[many > 0, None]
    return c


def train(sample, cells: int, width: int, codes: int, seed: int = 11) -> dict[str, Any]:  # noqa: ANN001
    """Coarse centroids, and for each subspace of width dimensions (the last may be narrower) its codewords for residuals."""
    import numpy as np

    u = unit(sample).astype(np.float32)
    coarse = kmeans(u, cells, 8, seed)
    own = np.argmax(u @ coarse.T - (coarse**2).sum(axis=1) / 2, axis=1)
    left = u - coarse[own]
    at = list(range(0, u.shape[1], width))
    return {"coarse": coarse, "at": at, "books": [kmeans(np.ascontiguousarray(left[:, i : i + width]), codes, 8, seed + i) for i in at], "width": width}


def distances(u, coarse):  # noqa: ANN001, ANN201
    """Squared distances of rows of u to the coarse centroids."""
    import numpy as np

    return np.maximum((u**2).sum(axis=1)[:, None] + (coarse**2).sum(axis=1) - 2 * (u @ coarse.T), 0)


def encode(model: dict[str, Any], v):  # noqa: ANN001, ANN201
    """(cell, distance from its centroid, codes, distance from what the codes stand for) of rows of v."""
    import numpy as np

    u = unit(v).astype(np.float32)
    near = distances(u, model["coarse"])
    cell = np.argmin(near, axis=1)
    left = u - model["coarse"][cell]
    code = np.empty((len(u), len(model["at"])), np.uint8)
    miss = np.zeros(len(u), np.float32)
    for m, (i, book) in enumerate(zip(model["at"], model["books"], strict=True)):
        part = left[:, i : i + model["width"]]
        d = distances(part, book)
        code[:, m] = np.argmin(d, axis=1)
        miss += ((part - book[code[:, m]]) ** 2).sum(axis=1)
    return cell.astype(np.int32), np.sqrt((left**2).sum(axis=1)), code, np.sqrt(miss)


def probes(model: dict[str, Any], v, cell, least, most, delta: float):  # noqa: ANN001, ANN201
    """(row, cell) pairs: the lists up to its own that a row may have a neighbour in; least, most: members' distances by cell."""
    import numpy as np

    u, c = unit(v).astype(np.float32), model["coarse"]
    near = distances(u, c)
    away = np.sqrt(near)
    apart = np.sqrt(distances(c, c))[cell]
    over = near - near[np.arange(len(u)), cell][:, None] <= 2 * (delta + SLACK) * apart + SLACK
    ring = (away <= most + delta + SLACK) & (away >= least - delta - SLACK)
    return np.nonzero(over & ring & (np.arange(len(c)) <= cell[:, None]) | (np.arange(len(c)) == cell[:, None]))


def lookup(model: dict[str, Any], cell: int, v, code):  # noqa: ANN001, ANN201
    """Asymmetric distances from rows of v (exact) to the members of list cell that code stands for, by a table a row and subspace."""
    import numpy as np

    left = unit(v).astype(np.float32) - model["coarse"][cell]
    total = np.zeros((len(v), len(code)), np.float32)
    for m, (i, book) in enumerate(zip(model["at"], model["books"], strict=True)):
        table = distances(left[:, i : i + model["width"]], book)
        total += table[:, code[:, m]]
    return np.sqrt(total)


def linked(model: dict[str, Any], cell: int, delta: float, cosine: float, list_node, list_v, code, err, node, v, own, block: int = 256):  # noqa: ANN001, ANN201
    """Index pairs (member of the list, prober) of cosine at least cosine; where a prober is of the list itself, the lesser node is the member."""
    import numpy as np

    lu, u = unit(list_v), unit(v)
    out_l, out_p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(v), block):
        near = lookup(model, cell, v[at : at + block], code) <= delta + err + SLACK
        p, m = np.nonzero(near)
        p = p + at
        fine = ~own[p] | (list_node[m] < node[p])
        p, m = p[fine], m[fine]
        for k in range(0, len(p), 1 << 15):
            pp, mm = p[k : k + (1 << 15)], m[k : k + (1 << 15)]
            good = np.einsum("nd,nd->n", lu[mm], u[pp]) >= cosine
            out_l.append(mm[good])
            out_p.append(pp[good])
    return np.concatenate(out_l), np.concatenate(out_p)


def least_tied(a, b, n: int):  # noqa: ANN001, ANN201
    """For each of n items the least item that the pairs (a, b) tie it to, itself included."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def near_duplicates(
    df: DataFrame,
    cosine: float = 0.98,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    sample: int = 1 << 16,
    cells: int | None = None,
    most_cells: int = 4096,
    width: int = 4,
    codes: int = 16,
    chunk: int = 2048,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; rows link where labels are equal and the cosine is at least cosine.

    n_links counts the other rows linked directly, component_id is the smallest
    id reachable, kept says whether that is the row's own. Vectors that are null,
    zero or hold null or non-finite components, and rows without a label, link
    with nothing; vectors of different lengths never do. Equal vectors link with
    each other and are compared once. Rows with one id are nodes of their own,
    so both count; an id that is null is never smallest (a component without any
    other has a null component_id, and its rows are kept). An empty table gives
    no rows; other columns are ignored.

    The quantisers are fitted on about sample vectors of each length (picked by a
    hash, all where there are fewer), into a coarse list for every eight times the root of the number
    of vectors (at most most_cells, or as many as cells says). That decides how
    much is compared, never what is found.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "pq-dedup")
    delta = math.sqrt(max(0.0, 2 - 2 * cosine))
    id_kind = df.schema[id_col].dataType.simpleString()
    usable = _usable(vec_col) & F.col(label_col).isNotNull()
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"), usable.alias("fit"))
    rows = rows.withColumn("h", F.when(F.col("fit"), F.xxhash64("label", "v")))
    keys = ["label", "h", "v"]
    kinds = rows.filter("fit").groupBy(*keys).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("m"))
    kinds = scratch.put(kinds.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    many = {r["dim"]: r["count"] for r in kinds.groupBy("dim").count().collect()}  # a row for each length of vectors
    # of each length the share whose hash is low enough to make about sample vectors; all where there are fewer
    share = reduce(lambda e, d: e.when(F.col("dim") == d, int(min(1.0, sample / many[d]) * (1 << 32))), many, F.when(F.lit(False), 0))
    picked = kinds.filter(F.pmod("h", F.lit(1 << 32)) < share)

    def learn(table):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        dim = table.column("dim")[0].as_py()
        x = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        wanted = cells or max(4, min(most_cells, math.isqrt(many[dim]) // 8))
        return pa.table({"dim": pa.array([dim], pa.int32()), "model": pa.array([pickle.dumps(train(x, wanted, width, codes))], pa.binary())})

    models = {r["dim"]: pickle.loads(r["model"]) for r in picked.select("dim", "v").groupBy("dim").applyInArrow(learn, "dim int, model binary").collect()}

    def by_dim(batch, dims, v):  # noqa: ANN001, ANN202
        """For each length of vectors in a batch: its rows and their vectors."""
        import numpy as np

        dims = np.asarray(batch.column(dims))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            yield int(dim), at, np.asarray(batch.column(v).take(at).flatten(), np.float64).reshape(-1, dim)

    v_kind, label_kind = kinds.schema["v"].dataType.simpleString(), kinds.schema["label"].dataType.simpleString()

    def code(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names = ["node", "label", "dim", "m", "v"]
            for dim, at, v in by_dim(batch, "dim", "v"):
                cell, away, codes, err = encode(models[dim], v)
                own = [batch.column(c).take(at) for c in names]
                more = [pa.array(cell), pa.array(away.astype(np.float32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(own + more, [*names, "cell", "away", "code", "err"])

    kept = kinds.select("node", "label", "dim", "m", "v")
    listed = scratch.put(kept.mapInArrow(code, f"node long, label {label_kind}, dim int, m long, v {v_kind}, cell int, away float, code binary, err float"))
    rings: dict[int, dict[int, tuple[float, float]]] = {}
    for r in listed.groupBy("dim", "cell").agg(F.min("away").alias("least"), F.max("away").alias("most")).collect():  # a row a cell
        rings.setdefault(r["dim"], {})[r["cell"]] = r["least"], r["most"]

    def ask(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            names = ["node", "label", "dim", "m", "v"]
            for dim, at, v in by_dim(batch, "dim", "v"):
                model = models[dim]
                least, most = (np.array([rings[dim].get(c, (9.0, -9.0))[k] for c in range(len(model["coarse"]))], np.float32) for k in (0, 1))
                cell = np.asarray(batch.column("cell").take(at))
                row, target = probes(model, v, cell, least, most, delta)
                own = [batch.column(c).take(at[row]) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(target.astype(np.int32)), pa.array(cell[row] == target)], [*names, "cell", "own"])

    asking = listed.select("node", "label", "dim", "m", "v", "cell").mapInArrow(ask, f"node long, label {label_kind}, dim int, m long, v {v_kind}, cell int, own boolean")
    where = ["label", "dim", "cell"]
    asking = scratch.put(asking)
    # lists above a chunk, and crowds above a chunk that probe one list, are cut by hash; every cut meets every other
    lists = listed.groupBy(*where).agg(F.count(F.lit(1)).alias("members"))
    crowds = asking.groupBy(*where).agg(F.count(F.lit(1)).alias("probers"))
    sizes = lists.join(crowds, where).select(*where, F.ceil(F.col("members") / chunk).cast("int").alias("chunks"), F.ceil(F.col("probers") / chunk).cast("int").alias("blocks"))
    sizes = scratch.put(sizes)
    cut = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = listed.join(sizes, where).select(*where, "node", "m", "v", "code", "err", cut("chunks").alias("c"), every("blocks").alias("b"))
    probers = asking.join(sizes, where).select(*where, "node", "m", "v", "own", cut("blocks").alias("b"), every("chunks").alias("c"))
    unit_key = [*where, "c", "b"]

    def compare(left, right):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        kind = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        dim, cell = left.column("dim")[0].as_py(), left.column("cell")[0].as_py()
        matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        ln, lm, pn, pm = (np.asarray(t.column(c)) for t in (left, right) for c in ("node", "m"))
        codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(len(ln), -1)
        mm, pp = linked(models[dim], cell, delta, cosine, ln, matrix(left), codes, np.asarray(left.column("err")), pn, matrix(right), np.asarray(right.column("own")))
        nodes, place = np.unique(np.r_[ln[mm], pn[pp]], return_inverse=True)
        a, b = place[: len(mm)], place[len(mm) :]
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, a, pm[pp])
        np.add.at(links, b, lm[mm])
        return pa.table([nodes, links, nodes[least_tied(a, b, len(nodes))]], schema=kind)

    found = members.groupBy(*unit_key).cogroup(probers.groupBy(*unit_key)).applyInArrow(compare, "node long, links long, root long")
    found = scratch.put(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    facts = kinds.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    facts = scratch.put(facts.select(*keys, "least", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "root"))
    smallest = facts.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("parts"))
    total = sum(many.values())
    facts = scratch.put(join_groups(facts, smallest, ["root"], "parts", total).drop("root", "parts", "least"))
    whole = rows.filter("fit").count()
    there = join_groups(rows.filter("fit").select("id", *keys), facts, keys, "m", whole).select("id", "n_links", "component_id")
    alone = rows.filter("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = there.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.select(F.col("id").cast(id_kind).alias(id_col), "n_links", "component_id", "kept")
