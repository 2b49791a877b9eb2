"""Near-duplicate texts by the Jaccard similarity of their shingle sets, over SimHash fingerprints and pivot distances.

A similarity of 0.8 is some 10 of 64 differing bits, and up to 22 in pairs that
should not be lost: too many for blocks of bits to agree at scale. So candidates
come from several further fingerprints, each the SimHash of a min-wise sample of
the text's shingles: the three least under a hash of its own. Two texts of
similarity s have the same three with a probability near s cubed, so at 0.8 one
of eight fingerprints agrees with a probability above 0.99, and unlike texts
hardly ever do. Within a bucket of equal sample fingerprints, pairs whose
distances to some pivot differ by more than the radius are discarded, then those
whose whole-text fingerprints do; the survivors' shingle sets are intersected.

Texts with one set of shingles are one node. Only texts that share a bucket have
their sets made. The first samples are worked off first; later buckets are
opened only where they hold texts not yet known to be of one component. Buckets
above a bound of rows or bytes are cut into chunks, and each pair of chunks is a
unit of work of its own; nothing is capped, and a unit emits a spanning forest.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, text_of
from .components import components
from .simhash import _grouped, _majority, _shingles, distance_table, pivots_of

#: Least shingles in a sample.
_SAMPLE = 3


def _samples(u, hashes: list[tuple[int, int]]):  # noqa: ANN001, ANN202
    """The SimHash of the least shingles of a set under each hash (xor, odd factor)."""
    import numpy as np

    if not len(u):
        return np.zeros(len(hashes), np.uint64)
    least = np.empty((len(hashes), min(_SAMPLE, len(u))), "<u8")
    for k, (x, m) in enumerate(hashes):
        v = (u ^ np.uint64(x)) * np.uint64(m)
        least[k] = np.partition(v, _SAMPLE - 1)[:_SAMPLE] if len(v) > _SAMPLE else v
    bits = np.unpackbits(least.view(np.uint8).reshape(*least.shape, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1) > least.shape[1], axis=1, bitorder="little").view("<u8").ravel()


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, n_samples: int, seed: int = 42) -> DataFrame:
    """(id, h, node, fp, keys): hashes of the text and of its shingle set, the set's SimHash and those of its samples."""
    rng = random.Random(seed)
    hashes = [(rng.getrandbits(64), rng.getrandbits(64) | 1) for _ in range(n_samples)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            node, fp = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64)
            keys = np.zeros((batch.num_rows, n_samples), np.uint64)
            for k, value in enumerate(batch.column(2)):
                u = np.unique(_shingles(value.as_py(), shingle, seed))
                if len(u):
                    node[k], fp[k], keys[k] = xxhash.xxh64_intdigest(u.tobytes()), _majority(u), _samples(u, hashes)
            arrays = [pa.array(x.view(np.int64)) for x in (node, fp, keys.ravel())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, n_samples), pa.int32()), arrays[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays[:2], lists], ["doc", "h", "node", "fp", "keys"])

    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_of(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc long, h long, node long, fp long, keys array<long>").withColumnRenamed("doc", id_col)


def shingle_sets(rows: DataFrame, shingle: int, seed: int = 42) -> DataFrame:
    """rows (node, fp, text) with the text's set of shingle hashes, sorted, instead of the text, and its bytes."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            sets = [np.unique(_shingles(v.as_py(), shingle, seed)).tobytes() for v in batch.column(2)]
            arrays = [batch.column(0), batch.column(1), pa.array(sets, pa.binary()), pa.array(map(len, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "fp", "shingles", "bytes"])

    return rows.mapInArrow(run, "node long, fp long, shingles binary, bytes long")


def _forest(fp, comp, chunk, table, sets, similarity: float, radius: int):  # noqa: ANN001, ANN202
    """Rows (i, j) of a spanning forest of a unit's links; chunk: 0, or rows of different chunks only.

    A row with many candidates meets them through lists of the rows that have a shingle, so unlike texts cost next to
    nothing beyond their own shingles.
    """
    import numpy as np

    label = np.unique(comp, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    if not label.any():
        return out
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.r_[0, np.cumsum(size)]
    order = np.argsort(ids, kind="stable")
    having = np.repeat(np.arange(len(size)), size)[order]  # rows by shingle
    first = np.searchsorted(ids[order], np.arange(ids.max(initial=-1) + 2))
    mark = np.zeros(len(ids), np.uint8)
    for i in range(len(fp) - 1):
        j = np.arange(i + 1, len(fp))
        j = j[(label[j] != label[i]) & ((chunk[j] == 0) | (chunk[j] != chunk[i]))]
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i])]
        for t in table:
            if not len(j):
                break
            j = j[np.abs(t[j] - t[i]) <= radius]
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= radius]
        if not len(j):
            continue
        own = ids[starts[i] : starts[i + 1]]
        if len(j) > 16:  # all rows at once, without a step a pair
            many = first[own + 1] - first[own]
            at = np.repeat(first[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            both = np.bincount(having[at], minlength=len(size))[j]
        else:
            mark[own] = 1
            both = np.array([np.count_nonzero(mark[ids[starts[k] : starts[k + 1]]]) for k in j])
            mark[own] = 0
        for k in j[both >= similarity * (size[i] + size[j] - both) - 1e-9]:
            if label[k] != label[i]:
                out.append((i, int(k)))
                label[label == label[k]] = label[i]
    return out


def similar_links(
    member: DataFrame, sets: DataFrame, scratch: Scratch, similarity: float, radius: int, n_pivots: int, unit_rows: int, unit_bytes: int
) -> DataFrame:
    """Edges (a, b) between the nodes of member (m, key, node, comp) that share a bucket, differ in comp and are similar.

    Of a unit's links a spanning forest is given, so no group of copies becomes all its pairs. member's columns hold no
    nulls; a node that is in a bucket twice counts once more; empty tables give no edges.
    """
    bounds = member.join(sets.select("node", "bytes"), "node").groupBy("m", "key")
    cut = F.ceil(F.greatest(F.count(F.lit(1)) / unit_rows, F.sum("bytes") / unit_bytes)).cast("int")
    bounds = bounds.agg(cut.alias("chunks"), F.count(F.lit(1)).alias("n"), (F.min("comp") < F.max("comp")).alias("open"))
    bounds = scratch.put(bounds.filter("open").withColumn("chunks", F.greatest("chunks", F.lit(1))).drop("open"))
    rows = join_groups(member, bounds, ["m", "key"], "n", member.count())
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).join(sets.drop("bytes"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    table = [c for c in sets.columns if c.startswith("t")]
    keys = ["m", "key", "c1", "c2"]
    rows = rows.select(
        *("m", "key", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2")),
        F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2)).alias("chunk"),
        *("node", "comp", "fp", *table, "shingles"),
    )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def unit(held: list) -> list[tuple[int, int]]:
            cols = [np.concatenate([p[k] for p in held]) for k in range(4 + len(table))]
            sets = [np.frombuffer(s, np.uint64) for p in held for s in p[-1]]
            near = np.concatenate([c.astype("<i8").view(np.int8).reshape(-1, 8).T for c in cols[4:]])[:n_pivots]
            pairs = _forest(cols[3].view(np.uint64), cols[2], cols[0], near, sets, similarity, radius)
            return [(int(cols[1][i]), int(cols[1][j])) for i, j in pairs]

        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8 + len(table))]
            change = np.zeros(batch.num_rows, bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            edges, found = [0, *np.flatnonzero(change).tolist(), batch.num_rows], []
            shingles = batch.column(batch.num_columns - 1)
            for a, b in zip(edges, edges[1:], strict=False):
                here = tuple(int(c[a]) for c in cols[:4])
                if here != at and held:
                    found += unit(held)
                    held = []
                at = here
                held.append([*(c[a:b].copy() for c in cols[4:]), shingles.slice(a, b - a).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held:
            found = unit(held)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(run, "a long, b long")


def similar_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 22,
    n_samples: int = 8,
    n_pivots: int = 16,
    unit_rows: int = 4096,
    unit_bytes: int = 16 << 20,
) -> DataFrame:
    """One row per input row: id, h (hash of the text), fp, root (one node of the component), component_id (the least id reachable over links).

    Links are pairs of texts with sets of shingles (A-Z lower-cased, words between ASCII white space; of fewer words
    the whole sequence) whose Jaccard similarity is at least `similarity`; each is checked on the whole sets. Null and
    empty texts are one node, linked to nothing else. Null ids are passed over when the least id is taken; repeated
    rows are one node; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "similar-texts")
    docs = scratch.put(sketches(df, id_col, text_col, shingle, n_samples))
    nodes = docs.groupBy("node").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(id_col).alias("i"), "h")).alias("of"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = scratch.put(nodes)
    rows = nodes.filter("node <> 0").select("node", F.posexplode("keys").alias("m", "key"))
    shared = scratch.put(rows.groupBy("m", "key").agg(F.count(F.lit(1)).alias("nodes")).filter("nodes > 1"))
    member = scratch.put(join_groups(rows, shared, ["m", "key"], "nodes", n_samples * nodes.count()).select("m", "key", "node"))
    # the texts of nodes that share a bucket: one text a node
    wanted = scratch.put(nodes.join(member.select("node"), "node", "left_semi").select("node", "fp", F.col("of.i").alias("__i"), F.col("of.h").alias("__h")))
    texts = df.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_of(text_col)).alias("__hash"), F.col(text_col).cast("string").alias("__text"))
    texts = texts.join(wanted, texts["__id"].eqNullSafe(wanted["__i"]) & (texts["__hash"] == wanted["__h"])).select("node", "fp", "__text")
    sets = distance_table(shingle_sets(texts, shingle).dropDuplicates(["node"]), pivots_of(n_pivots))
    sets = scratch.put(sets)
    how = (similarity, radius, n_pivots, unit_rows, unit_bytes)
    first = scratch.put(similar_links(member.filter("m < 2").withColumn("comp", F.col("node")), sets, scratch, *how))
    roots = components(first, scratch).withColumnRenamed("root", "comp")
    rest = member.filter("m >= 2").join(roots, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    second = scratch.put(similar_links(scratch.put(rest), sets, scratch, *how))
    out = _grouped(docs.drop("keys"), nodes.select("node", "least", "n"), first.unionByName(second), scratch)
    return out.select(id_col, "h", "fp", "root", "component_id")
