"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set where over half of the text's shingle hashes have it.
Two fingerprints within max_bits of each other agree on all but max_bits of any
equal blocks of bits, so the distinct fingerprints are dealt by every choice of
agreeing blocks, and no link is lost. A table made once holds each fingerprint's
Hamming distances to reference fingerprints (pivots) and goes with it into its
buckets; by the triangle inequality a pair whose distances to some pivot differ
by more than max_bits is discarded, and only the survivors are compared bit by
bit. The fingerprints of buckets above a bound are dealt anew by more blocks; what
is still above it is cut into chunks and every pair of chunks is a work unit of
its own, so no bucket is capped and none fills a task; of a large unit only a
spanning forest of its links is emitted.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_groups, text_of
from .components import components

#: Rows of a unit up to which pairs are swept together with those of other units.
_SMALL = 32


def _shingles(text: str | None, shingle: int, seed: int):  # noqa: ANN202
    """XXH64 of every shingle of a text's words, repeats included; of fewer words the whole sequence; no words: none."""
    import numpy as np
    from xxhash import xxh64_intdigest as digest

    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[min(shingle, len(words)) - 1 :]
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends)), np.uint64, len(ends))  # noqa: B905


def _majority(h) -> int:  # noqa: ANN001
    """The bits that are set in over half of the hashes; no hashes: 0."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, h, fp): a hash of each whole text and its 64-bit SimHash as a signed long; no words: 0."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = np.fromiter((_majority(_shingles(v.as_py(), shingle, seed)) for v in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], ["doc", "h", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_of(text_col)).alias("h"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc long, h long, fp long").withColumnRenamed("doc", id_col)


def hex_of(fp: Column) -> Column:
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _masks(n: int, max_bits: int, bits: int, most: int) -> list[int]:
    """Bit masks such that two values within max_bits agree under one at least, for n values.

    bits are cut into as many blocks as it takes for about `most` random values to agree under a mask.
    """
    blocks = max_bits + 1
    while blocks < 2 * max_bits and n >> (bits // blocks * (blocks - max_bits)) > most:
        blocks += 1
    return _masks_of(blocks, max_bits, bits)


def _masks_of(blocks: int, max_bits: int, bits: int) -> list[int]:
    edges = [bits * k // blocks for k in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = [sum(x) for x in combinations(part, blocks - max_bits)]
    assert len(out) == comb(blocks, max_bits)
    return out


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _unit_links(fp, chunk, table, max_bits: int):  # noqa: ANN001, ANN202
    """A spanning forest of the links within one unit; chunk: None, or rows of different chunks only."""
    import numpy as np

    order = np.argsort(table[0], kind="stable")
    fp, table = fp[order], table[:, order]
    chunk = None if chunk is None else chunk[order]
    upto = np.searchsorted(table[0], table[0] + max_bits, side="right")
    label, a_out, b_out = np.arange(len(fp)), [], []
    for i in range(len(fp) - 1):
        j = np.arange(i + 1, upto[i])
        j = j[label[j] != label[i]]
        if chunk is not None:
            j = j[chunk[j] != chunk[i]]
        for t in table[1:]:
            if not len(j):
                break
            j = j[np.abs(t[j] - t[i]) <= max_bits]
        j = j[np.bitwise_count(fp[j] ^ fp[i]) <= max_bits]
        if len(j):
            labels, at = np.unique(label[j], return_index=True)
            for x, k in zip(labels, j[at], strict=True):
                a_out.append(fp[i])
                b_out.append(fp[k])
                label[label == x] = label[i]
    return np.array(a_out, np.uint64), np.array(b_out, np.uint64)


def _links_of(fp, unit, chunk, table, max_bits: int):  # noqa: ANN001, ANN202
    """Links of whole units: rows in order of unit; chunk 0 where a unit's rows may all meet; table: distances by pivot and row."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[starts, len(unit)])
    a_out, b_out = [], []
    for s, n in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
        own = chunk[s : s + n]
        a, b = _unit_links(fp[s : s + n], own if own.any() else None, table[:, s : s + n], max_bits)
        a_out.append(a), b_out.append(b)
    small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
    fp, unit, chunk, table = fp[small], unit[small], chunk[small], table[:, small]
    for k in range(1, min(_SMALL, len(fp))):
        i = np.flatnonzero(unit[k:] == unit[:-k])
        if not len(i):
            break
        i = i[(chunk[i] == 0) | (chunk[i] != chunk[i + k])]
        for t in table:
            i = i[np.abs(t[i + k] - t[i]) <= max_bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= max_bits]
        a_out.append(fp[i]), b_out.append(fp[i + k])
    return np.concatenate([*a_out, np.zeros(0, np.uint64)]), np.concatenate([*b_out, np.zeros(0, np.uint64)])


def pivots_of(n: int, seed: int = 11) -> list[int]:
    """n reference fingerprints."""
    rng = random.Random(seed)
    return [rng.getrandbits(64) for _ in range(n)]


def distance_table(fps: DataFrame, pivots: list[int]) -> DataFrame:
    """fps with t0, t1, ...: the Hamming distances of fp to the pivots, eight to a long."""
    cols = {}
    for k in range(0, len(pivots), 8):
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * j) for j, p in enumerate(pivots[k : k + 8])]
        cols[f"t{k // 8}"] = functools.reduce(lambda a, b: a.bitwiseOR(b), parts)
    return fps.withColumns(cols)


def _dealt(fps: DataFrame, masks: list[int], family: int) -> DataFrame:
    """A row of fps for each mask: m, key."""
    deal = F.explode(F.array(*(F.struct(F.lit(family + k).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(v))).alias("key")) for k, v in enumerate(masks))))
    return fps.withColumn("x", deal).select(*fps.columns, "x.m", "x.key")


def links(fps: DataFrame, scratch: Scratch, max_bits: int = 4, n_pivots: int = 16, unit_rows: int = 4096, pivot_seed: int = 11) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fps.fp within max_bits.

    fp is not null and differs from row to row (the caller's groups of equal ones are one row); no rows give no edges.
    Of links at the same distance any that tie what another has not tied yet may be left out.
    """
    fps = scratch.put(distance_table(fps.select("fp"), pivots_of(n_pivots, pivot_seed)))
    table = fps.columns[1:]
    first, most = _masks(fps.count(), max_bits, 64, 64), _masks_of(2 * max_bits, max_bits, 64)
    crowded = lambda x: x.groupBy("m", "key").count().filter(F.col("count") > unit_rows)
    rows = _dealt(fps, first, 0)
    large = scratch.put(crowded(rows))
    if len(first) < len(most) and not large.isEmpty():
        # what a crowded bucket holds is dealt by more blocks: its pairs agree on some of those too
        hot = scratch.put(rows.join(large.select("m", "key"), ["m", "key"], "left_semi").select("fp", *table).distinct())
        rows = rows.join(large.select("m", "key"), ["m", "key"], "left_anti")
        again = _dealt(hot, most, len(first))
        rows = rows.unionByName(again)
        large = crowded(again)
    # buckets above unit_rows: every pair of their chunks becomes a unit
    large = scratch.put(large.select("m", "key", F.ceil(F.col("count") / unit_rows).cast("int").alias("chunks")))
    rows = rows.join(large, ["m", "key"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select(
        "fp",
        *table,
        "m",
        "key",
        F.least("own", "other").alias("c1"),
        F.greatest("own", "other").alias("c2"),
        F.when(F.col("own") == F.col("other"), 0).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2)).alias("chunk"),
    )
    # a chunk's pairs with itself are units of their own (c1 = c2)
    keys = ["m", "key", "c1", "c2"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: list = []

        def flush(parts: list) -> pa.RecordBatch:
            cols = [np.concatenate([p[k] for p in parts]) for k in range(6 + len(table))]
            change = np.zeros(len(cols[0]), bool)
            for c in cols[1:5]:
                change[1:] |= c[1:] != c[:-1]
            near = np.concatenate([c.astype("<i8").view(np.int8).reshape(-1, 8).T for c in cols[6:]])[:n_pivots]
            a, b = _links_of(cols[0].view(np.uint64), np.cumsum(change), cols[5], near, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6 + len(table))]
            last = np.ones(len(now[0]), bool)
            for c in now[1:5]:
                last &= c == c[-1]
            cut = len(last) - (len(last) if last.all() else int(np.argmin(last[::-1])))
            if cut:  # what comes before the last unit is whole, with what was held
                yield flush([*held, [c[:cut] for c in now]])
                held = []
            held.append([c[cut:] for c in now])
        if held:
            yield flush(held)

    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.select("fp", *keys, "chunk", *table).mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with root and component_id: nodes (node, least, n) are joined by the components of edges."""
    roots = components(edges, scratch)
    nodes = scratch.put(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = scratch.put(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes")))
    nodes = scratch.put(join_groups(nodes, least, ["root"], "nodes", nodes.count()).select("node", "n", "root", "component_id"))
    return join_groups(docs, nodes, ["node"], "n", docs.count())


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
    n_pivots: int = 16,
) -> DataFrame:
    """One row per input row: id, h (hash of the text), fp, root (one fp of the component), component_id (the least id reachable over links).

    Null and empty texts have fingerprint 0 and link like any other. Equal
    fingerprints are one node, so copies are never expanded into pairs. Null ids
    are passed over when the least id is taken; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.put(fingerprints(df, id_col, text_col, shingle))
    fps = scratch.put(docs.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")))
    edges = scratch.put(links(fps.select("fp"), scratch, max_bits, n_pivots))
    rows = _grouped(docs.withColumn("node", F.col("fp")), fps.withColumnRenamed("fp", "node"), edges, scratch)
    return rows.select(id_col, "h", "fp", "root", "component_id")


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float | None = 0.8, max_bits: int = 4
) -> DataFrame:
    """One whole row of df for each component: the one with the least id; of several with that id, one.

    Components are those of texts whose sets of shingles have a Jaccard similarity of at least `similarity`
    (similar_texts), or, where that is None, of fingerprints within max_bits. Null and empty texts are one component
    (with whatever links to fingerprint 0); of a component whose ids are all null one row stays. Other columns stay
    as they are; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "near-copies")
    if similarity is None:
        rows = near_duplicates(df, id_col, text_col, shingle, max_bits)
    else:
        from .similar_texts import similar_texts

        rows = similar_texts(df, id_col, text_col, shingle, similarity)
    rows = scratch.put(rows.groupBy(F.col(id_col).alias("__doc"), F.col("h").alias("__hash")).agg(F.min("root").alias("root"), F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")))
    least = rows.filter(F.col("__doc").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("__doc", "__hash")).alias("k")).select("k.*")
    on = lambda x, y, a="__doc", b="__hash": x[a].eqNullSafe(y["__doc"]) & (x[b] == y["__hash"])
    # lists of keys on disk, so that their size decides whether whole rows are shuffled
    dropped = scratch.put(rows.join(least, on(rows, least), "left_anti").select("__doc", "__hash"))
    again = scratch.put(rows.filter("n > 1").select("__doc", "__hash"))
    keyed = df.withColumn("__h", F.xxhash64(text_of(text_col)))
    kept = keyed.join(dropped, on(keyed, dropped, id_col, "__h"), "left_anti")
    if not again.isEmpty():
        once = kept.join(again, on(kept, again, id_col, "__h"), "left_anti")
        kept = once.unionByName(kept.join(again, on(kept, again, id_col, "__h"), "left_semi").dropDuplicates([id_col, "__h"]))
    return kept.drop("__h")
