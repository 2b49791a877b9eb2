"""Best-fit packing of token sequences with swap-based local search.

Documents are encoded and only those longer than a sequence cut. The pieces'
lengths are dealt at random into groups of bounded size and packed group by
group: best fit of decreasing lengths first, then a local search among the
underfull sequences that moves a piece, exchanges one for one or two for one,
whenever the sum of squared fills rises, until nothing more does; what is
emptied on the way disappears. A group costs at most a fraction of a sequence.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, into the fullest bin that still takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit f: some bin has f free
    for i in order:
        n = lengths[i]
        fit = there >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                there &= ~(1 << free)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_free[free - n].append(b)
        there |= 1 << (free - n)
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int, trace: list | None = None) -> list[list[int]]:
    """Local search among underfull bins: each change raises the sum of squared fills. Ends when none does.

    For a bin A, the fullest that hasn't had its turn, and each of its items a (or
    none): take from an emptier bin an item b longer than a that still fits, or two
    whose sum is, and give a back. The longest gain goes first. Bins that had their
    turn are off, and givers get emptier, so every item on offer is in a bin not
    fuller than A, and what A gains the sum of squares gains twice over and more.
    A sum of squares has an upper bound, so the search ends. trace gets each
    exchange: the fills of A and the giver before it, and the gain.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    open_ = [k for k in range(len(bins)) if 0 < fill[k] < capacity]
    changed = True
    while changed:
        changed = False
        pool = sorted((lengths[i], i) for k in open_ for i in bins[k])
        where = {i: k for k in open_ for i in bins[k]}
        version = dict.fromkeys(open_, 0)

        def pairs_of(k: int) -> list[tuple[int, int, int, int, int]]:
            """Two items of a bin: one pair for any two lengths, so under 2100 for 2048 places."""
            by = {lengths[i]: [] for i in bins[k]}
            for i in bins[k]:
                by[lengths[i]].append(i)
            one = sorted(by)
            out = [(x + y, k, version[k], by[x][0], by[y][0]) for n, x in enumerate(one) for y in one[n + 1 :]]
            return out + [(2 * x, k, version[k], by[x][0], by[x][1]) for x in one if len(by[x]) > 1]

        pairs = sorted(p for k in open_ for p in pairs_of(k))

        def longest(low: int, high: int) -> tuple[int, int] | None:
            """The longest item on offer of low < length <= high."""
            at = bisect_right(pool, (high, len(lengths)))
            return pool[at - 1] if at and pool[at - 1][0] > low else None

        def longest_pair(low: int, high: int) -> tuple[int, int, int, int, int] | None:
            """The longest two items of one bin on offer; pairs of bins that have changed are cleared away."""
            at = bisect_right(pairs, (high, len(bins)))
            while at and pairs[at - 1][0] > low:
                at -= 1
                if version[pairs[at][1]] == pairs[at][2]:
                    return pairs[at]
                del pairs[at]
            return None

        turns = [(-fill[k], k) for k in open_]
        heapify(turns)
        while turns:
            was, a_bin = heappop(turns)
            if -was != fill[a_bin]:  # it has given since: its place is further on
                if fill[a_bin]:
                    heappush(turns, (-fill[a_bin], a_bin))
                continue
            version[a_bin] += 1
            for i in bins[a_bin]:
                del pool[bisect_left(pool, (lengths[i], i))]
            while fill[a_bin] < capacity:
                free, best = capacity - fill[a_bin], (0, [], None)
                if hit := longest(0, free):
                    best = hit[0], [hit[1]], None
                for a in bins[a_bin]:
                    n = lengths[a]
                    if hit := longest(n + best[0], n + free):
                        best = hit[0] - n, [hit[1]], a
                    if two := longest_pair(n + best[0], n + free):
                        best = two[0] - n, [two[3], two[4]], a
                gain, come, go = best
                if not gain:
                    break
                giver = where[come[0]]
                if trace is not None:
                    trace.append((fill[a_bin], fill[giver], gain))
                for i in come:
                    bins[giver].remove(i)
                    del pool[bisect_left(pool, (lengths[i], i))]
                    bins[a_bin].append(i)
                    where[i] = a_bin
                if go is not None:
                    bins[a_bin].remove(go)
                    bins[giver].append(go)
                    where[go] = giver
                    insort(pool, (lengths[go], go))
                fill[a_bin] += gain
                fill[giver] -= gain
                version[giver] += 1
                for p in pairs_of(giver):
                    insort(pairs, p)
                changed = True
        open_ = [k for k in open_ if 0 < fill[k] < capacity]
    return [b for b in bins if b]


def pieces(
    df: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its text's ids and then end_id; null counts as empty. Only
    documents longer than capacity are cut, into pieces of capacity ids.
    """

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .tokens import encoder as own_encoder

        encoder, end = own_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for i in range(0, len(docs), 500):
                rows: list[tuple] = []
                for doc, ids in zip(docs[i : i + 500], encoder.encode(batch.column(1)[i : i + 500].to_pylist()), strict=True):
                    ids += end
                    for p in range(-(-len(ids) // (4 * capacity))):
                        own = ids[4 * p * capacity : 4 * (p + 1) * capacity]
                        rows.append((doc, p, p * capacity, len(own) // 4, own))
                types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc", "piece", "start", "length", "ids"]
                )

    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(encode, "doc long, piece int, start long, length long, ids binary").withColumnRenamed("doc", id_col)


def pack(rows: DataFrame, capacity: int = 2048, group_rows: int = 8192) -> DataFrame:
    """rows with sequence_id and offset; rows must have length (1 to capacity).

    Equal rows are packed each for itself. An empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "packing")
    rows = scratch.put(rows.drop("sequence_id", "offset"))
    groups = max(1, -(-rows.count() // group_rows))
    # the number of a row in its file decides, so no key can fill a group
    dealt = rows.withColumn("__g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def fill(table):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        lengths = table.column("length").to_pylist()
        bins = improve(best_fit(lengths, capacity), lengths, capacity)
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        group = table.column("__g")[0].as_py()
        for k, items in enumerate(bins):
            at = 0
            for i in items:
                seq[i], off[i] = (group << 32) + k, at
                at += lengths[i]
        return table.drop_columns(["__g"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.groupBy("__g").applyInArrow(fill, f"{fields}, sequence_id long, offset long")
