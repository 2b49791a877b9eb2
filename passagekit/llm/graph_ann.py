"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors are dealt into shards of bounded size by a hash of the vector, so equal
vectors share a shard and one node. In each shard a graph is built in batches
that double in size: greedy (beam) searches over the graph so far propose
neighbours, relaxed distance pruning keeps diverse edges, and reverse edges are
added and pruned in turn. That graph is of directions, so the lengths of vectors
don't bend it. Largest inner product also depends on length, so every node then
asks as a query would: a beam search by inner product in its direction, whose
best become edges too. A query is beam searched by inner product in every shard,
and the shards' best are merged; scores are computed anew in double precision
from the original vectors.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def beam_search(x, norms, graph, entry: int, q, beam: int):  # noqa: ANN001, ANN202
    """For each query the beam nearest nodes found (ids, distances), nearest first; -1 where there are fewer.

    norms: squared lengths of x for Euclidean distance, None for the largest inner product. A node's neighbours
    must differ. All queries of a block advance together, each expanding its nearest node not yet expanded.
    """
    import numpy as np

    norms = np.zeros(len(x), np.float32) if norms is None else norms
    k, degree = len(q), graph.shape[1]
    width = beam + degree
    ids = np.full((k, width), -1, np.int32)
    dist = np.full((k, width), np.inf, np.float32)
    done = np.ones((k, width), bool)
    seen = np.zeros((k, len(x)), bool)
    ids[:, 0], done[:, 0], seen[:, entry] = entry, False, True
    dist[:, 0] = norms[entry] - 2 * (q @ x[entry])
    live = np.arange(k)
    while len(live):
        at = np.argmax(~done[live, :beam], axis=1)  # columns are in order of distance
        more = ~done[live, at]
        live, at = live[more], at[more]
        if not len(live):
            break
        done[live, at] = True
        near = graph[ids[live, at]]
        new = (near >= 0) & ~seen[live[:, None], near]
        seen[live[:, None], np.where(near >= 0, near, ids[live, at][:, None])] = True
        d = norms[near] - 2 * np.einsum("kmd,kd->km", x[near], q[live])
        ids[live, beam:] = np.where(new, near, -1)
        dist[live, beam:] = np.where(new, d, np.inf)
        done[live, beam:] = ~new
        order = np.argsort(dist[live], axis=1, kind="stable")
        for a in (ids, dist, done):
            a[live] = np.take_along_axis(a[live], order, axis=1)
        done[live, beam:] = True
    return ids[:, :beam], dist[:, :beam]


def robust_prune(x, norms, points, cand, degree: int, alpha: float):  # noqa: ANN001, ANN202
    """For each point at most degree of its candidates (-1: none) such that none is much nearer to a kept one than to the point."""
    import numpy as np

    cand = np.where(cand == points[:, None], -1, cand)
    cand = -np.sort(-cand, axis=1)  # the same candidate twice counts once
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    v = x[cand]
    d = np.maximum(norms[cand] + norms[points][:, None] - 2 * np.einsum("kmd,kd->km", v, x[points]), 0)
    d = np.where(cand < 0, np.inf, d)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    v = x[cand]
    between = np.maximum(norms[cand][:, :, None] + norms[cand][:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0)
    out = np.full((len(points), degree), -1, np.int32)
    open_ = np.isfinite(d)
    rows = np.arange(len(points))
    for k in range(degree):
        first = np.argmax(open_, axis=1)
        there = open_[rows, first]
        if not there.any():
            break
        out[there, k] = cand[rows[there], first[there]]
        open_[rows, first] = False
        open_ &= ~(there[:, None] & (alpha * between[rows, first] <= d))
    return out


def build_graph(x, degree: int = 32, beam: int = 64, alpha: float = 1.2, seed: int = 5, block: int = 512):  # noqa: ANN001, ANN202
    """(graph, entry): a row of neighbours for each row of x (float32; -1: none)."""
    import numpy as np

    n = len(x)
    norms = (x**2).sum(axis=1)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(np.argmin(norms - 2 * (x @ x.mean(axis=0))))
    order = np.random.default_rng(seed).permutation(n)
    order = np.r_[entry, order[order != entry]].astype(np.int32)
    at = 1
    while at < n:
        new = order[at : at + min(block, max(8, at))]
        near, _ = beam_search(x, norms, graph, entry, x[new], beam)
        graph[new] = robust_prune(x, norms, new, near, degree, alpha * alpha)
        src = np.repeat(new, degree)
        dst = graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        many = np.diff(np.r_[first, len(dst)])
        place = np.arange(len(dst)) - np.repeat(first, many)
        targets = dst[first]
        wide = int(many.max())
        add = np.full((len(targets), wide), -1, np.int32)
        add[np.repeat(np.arange(len(targets)), many), place] = src
        own = graph[targets]
        room = (own >= 0).sum(axis=1) + many <= degree
        for k in np.flatnonzero(room):
            free = np.flatnonzero(own[k] < 0)[: many[k]]
            own[k, free] = add[k, : many[k]]
        full = np.flatnonzero(~room)
        for i in range(0, len(full), block):
            f = full[i : i + block]
            some = np.concatenate([graph[targets[f]], add[f][:, : int(many[f].max())]], axis=1)
            own[f] = robust_prune(x, norms, targets[f], some, degree, alpha * alpha)
        graph[targets] = own
        at += len(new)
    return graph, entry


def asked_edges(x, u, graph, entry: int, degree: int, beam: int, block: int = 512):  # noqa: ANN001, ANN202
    """graph with up to degree more columns: of each node the nodes of largest inner product with its direction, as found by beam search."""
    import numpy as np

    more = np.full((len(x), degree), -1, np.int32)
    for i in range(0, len(x), block):
        own = np.arange(i, min(len(x), i + block))
        near, _ = beam_search(x, None, graph, entry, u[own], max(beam, degree + 1))
        near = np.where(near == own[:, None], -1, near)
        first = np.argsort(near < 0, axis=1, kind="stable")[:, :degree]
        more[own] = np.take_along_axis(near, first, axis=1)
    wide = -np.sort(-np.concatenate([graph, more], axis=1), axis=1)
    wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = -1
    return wide


def enough_beam(x, u, graph, entry: int, k: int, recall: float, least: int, asked: int = 128, seed: int = 9) -> tuple[int, float]:  # noqa: ANN001
    """(beam, recall): the least of least, 1.5 x least, ... whose searches find that share of the k nearest, as measured on directions of the graph's own nodes.

    Once a beam holds all nodes, nothing more can be found and it is taken whatever its recall.
    """
    import numpy as np

    own = np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)
    k = min(k, len(x) - 1)
    if k < 1:
        return least, 1.0
    score = u[own] @ x.T
    score[np.arange(len(own)), own] = -np.inf
    kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
    beam = least
    while True:
        found, dist = beam_search(x, None, graph, entry, u[own], beam)
        hit = (found >= 0) & (found != own[:, None]) & (-dist / 2 >= kth[:, None] - 1e-6)
        got = float(np.minimum(hit.sum(axis=1), k).mean() / k)
        if got >= recall or beam >= len(x):
            return beam, got
        beam = min(len(x), max(beam + 1, beam * 3 // 2))


def _scaled(x):  # noqa: ANN001, ANN202
    """(rows by the greatest length of all, directions), float32; safe for any finite doubles."""
    import numpy as np

    own = np.abs(x).max(axis=1, keepdims=True)
    u = x / own
    n = np.sqrt((u**2).sum(axis=1, keepdims=True))
    u /= n
    top = own.max()
    length = own / top * n  # of the longest component of all
    return (u * (length / length.max())).astype(np.float32), u.astype(np.float32)


def _usable(vec: str) -> F.Column:
    """Not null, not all zero, every component there and finite."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, sound) & F.exists(vec, lambda x: x != 0), F.lit(False))


def index(df: DataFrame, scratch: Scratch, id_col: str, vec_col: str, shard_rows: int, degree: int, asked: int, beam: int, alpha: float, copies: int, least_shards: int = 8, least_beam: int = 64, recall: float = 0.97) -> DataFrame:
    """One row per shard: shard, dim, data (vectors, ids of up to copies equal rows, graph, entry, beam as npz), beam, recall.

    beam is what a shard's searches need, measured on its own nodes against all products: the least that finds the
    share recall of as many nearest as one shard has to give (twice its part of copies - 1, and four).

    Shards have shard_rows distinct vectors at most (on average of the hash), which bounds a task's memory and
    time; there are least_shards of them where each still gets 1024, so that small tables build in parallel too.
    Vectors of one dimension make an index of their own; all rows are in it, but
    of equal vectors beyond the copies-th id, which no list of that length can hold.
    """
    vecs = df.filter(_usable(vec_col)).select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    vecs = vecs.filter("id is not null").withColumn("h", F.xxhash64("v"))
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    vecs = scratch.put(vecs.withColumn("r", rank).filter(F.col("r") <= copies).drop("r"))
    kinds = vecs.select("h").distinct().count()
    shards = max(1, -(-kinds // shard_rows), min(least_shards, -(-kinds // 1024)))

    def build(table):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        dim = table.column("dim")[0].as_py()
        flat = np.asarray(table.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)
        ids = np.asarray(table.column("id"), np.int64)
        x, node = np.unique(flat, axis=0, return_inverse=True)
        order = np.lexsort((ids, node.ravel()))
        scaled, u = _scaled(x)
        graph, entry = build_graph(u, degree, beam, alpha)
        graph = asked_edges(scaled, u, graph, entry, asked, beam * 3 // 4)
        enough, found = enough_beam(scaled, u, graph, entry, min(copies - 1, -(-2 * (copies - 1) // shards) + 4), recall, max(least_beam, copies))
        exact = x.astype(np.float32)
        x = exact if np.array_equal(exact, x) else x
        out = io.BytesIO()
        np.savez(out, x=x, node=node.ravel()[order].astype(np.int32), ids=ids[order], graph=graph, entry=entry, beam=enough)
        facts = {"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "data": pa.array([out.getvalue()], pa.binary())}
        return pa.table(facts | {"beam": pa.array([enough], pa.int32()), "recall": pa.array([found])})

    dealt = vecs.select("id", "v", F.size("v").alias("dim"), F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    return scratch.put(dealt.groupBy("dim", "shard").applyInArrow(build, "shard int, dim int, data binary, beam int, recall double"))


def nearest(
    df: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    shard_rows: int = 1 << 15,
    degree: int = 32,
    asked: int = 16,
    build_beam: int = 64,
    beam: int | None = None,
    alpha: float = 1.2,
    block: int = 1 << 14,
    recall: float = 0.97,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k of df nearest to each of queries by inner product, found by beam search.

    Nearest first, ties to the smaller id; a query's own id is no candidate.
    Vectors that are null, zero or hold null or non-finite components, and rows
    without an id, take no part; vectors of other lengths are never compared.
    A query id that occurs with several vectors counts once for each. Finite
    components of any size are searched; a product beyond a double is infinite,
    one that is no number counts as minus infinity. An empty table gives no rows; other
    columns are ignored.

    A shard is read once for every block of queries, so its cost is one beam
    search a query and shard; degree edges of a node come from the pruned graph
    of directions, asked from searches by inner product. The beam is each
    shard's own, as wide as it was measured to need for recall (see index), or
    the one that is given.
    """
    scratch = Scratch(df.sparkSession, "graph-ann")
    shards = index(df, scratch, id_col, vec_col, shard_rows, degree, asked, build_beam, alpha, k + 1, recall=recall)
    ask = queries.filter(_usable(vec_col)).select(F.col(id_col).cast("long").alias("q"), F.transform(vec_col, lambda x: x.cast("double")).alias("v"))
    ask = ask.filter("q is not null").withColumn("dim", F.size("v")).distinct()
    many = ask.count()
    blocks = max(1, -(-many // block), min(4, -(-many // 256)))
    ask = ask.withColumn("b", F.pmod(F.xxhash64("q", "v"), F.lit(blocks)))
    ask = ask.groupBy("dim", "b").agg(F.collect_list(F.struct("q", "v")).alias("x"))
    ask = ask.select("dim", F.col("x.q").alias("q"), F.flatten(F.col("x.v")).alias("v"))
    # a work unit: one block of queries in one shard
    last = shards.agg(F.max("shard")).first()[0]
    ask = ask.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    units = ask.join(shards, ["dim", "shard"]).select("dim", "q", "v", "data")

    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column(0)[r].as_py()
                q = np.asarray(batch.column(1)[r].values, np.int64)
                v = np.asarray(batch.column(2)[r].values, np.float64).reshape(-1, dim)
                with np.load(io.BytesIO(batch.column(3)[r].as_py())) as z:
                    x, node, ids, graph, entry, own_beam = (z[n] for n in ("x", "node", "ids", "graph", "entry", "beam"))
                x, scaled = x.astype(np.float64), _scaled(x.astype(np.float64))[0]
                flat = _scaled(v)[1]
                parts = [beam_search(scaled, None, graph, int(entry), flat[i : i + 256], max(beam or int(own_beam), k + 1))[0] for i in range(0, len(flat), 256)]
                found = np.concatenate(parts)
                first = np.searchsorted(node, np.arange(len(x) + 1))
                out_q, out_v, out_id, out_s = [], [], [], []
                for i in range(len(q)):
                    own = found[i][found[i] >= 0]
                    with np.errstate(over="ignore", invalid="ignore"):
                        score = (x[own] * v[i]).sum(axis=1)
                    score[np.isnan(score)] = -np.inf
                    many = first[own + 1] - first[own]
                    at = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    cid, cs = ids[at], np.repeat(score, many)
                    cid, cs = cid[cid != q[i]], cs[cid != q[i]]
                    best = np.lexsort((cid, -cs))[:k]
                    out_q.append(np.full(len(best), q[i]))
                    out_v.append(np.full(len(best), i))
                    out_id.append(cid[best])
                    out_s.append(cs[best])
                hashes = [zlib.crc32(v[i].tobytes()) for i in range(len(q))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(out_q)), pa.array(np.array(hashes, np.int64)[np.concatenate(out_v)]), pa.array(np.concatenate(out_id)), pa.array(np.concatenate(out_s))],
                    ["query_id", "h", "vec_id", "score"],
                )

    hits = units.mapInArrow(search, "query_id long, h long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
