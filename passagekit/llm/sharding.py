"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, hash of the id), so that equal texts
stand together. For each boundary between shards the search counts, over all
partitions, the exact bytes below evenly spaced probes of an interval, narrows
the interval to the gap that holds the wanted position, and stops when a probe
is within the tolerance or nothing is left to split. Between texts first; only
where one group of equal texts is itself too large does a boundary go inside
it. The driver gets only the probe counts. Then the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def _probe(keys: DataFrame, value: str, spans: list[tuple[int, int]], probes: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each span: (smallest, largest, bytes) of the filled bins between its probes, in order."""
    lows, highs = F.array(*(_long(a) for a, _ in spans)), F.array(*(_long(b) for _, b in spans))
    steps = F.array(*(_long(max(1, -(-(b - a + 1) // probes))) for a, b in spans))
    v = F.col(value)
    hit = keys.withColumn("i", F.size(F.filter(lows, lambda x: x <= v))).filter("i > 0")
    hit = hit.filter(v <= F.element_at(highs, F.col("i")))
    bins = hit.groupBy("i", F.expr("0").alias("z"), ((v - F.element_at(lows, F.col("i"))) / F.element_at(steps, F.col("i"))).cast("long").alias("bin"))
    out: dict[int, list[tuple[int, int, int]]] = {k: [] for k in range(len(spans))}
    for r in bins.agg(F.min(v).alias("a"), F.max(v).alias("b"), F.sum("size").alias("s")).collect():
        out[r["i"] - 1].append((r["a"], r["b"], r["s"]))
    return {k: sorted(x) for k, x in out.items()}


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 1e-3, probes: int = 64) -> list[tuple[int, int]]:
    """(key, tie) of the first row right of each of the n_shards - 1 boundaries.

    keys: columns key, tie (not negative) and size. The bytes left of boundary k
    are within tolerance x a shard's share of k shares, or as near as the rows
    allow. Rows equal in key and tie are never split. No column holds nulls; an
    empty table's boundaries stand beyond every key and part nothing.
    """
    total = keys.agg(F.sum("size").alias("s"), F.min("key").alias("a"), F.max("key").alias("b")).first()
    if not total["s"]:
        return [(1 << 62, -1)] * (n_shards - 1)
    share = total["s"] / n_shards
    found: dict[int, tuple[int, int]] = {}
    # boundary -> (key or None, low, high, bytes below low)
    open_: dict[int, tuple[int | None, int, int, int]] = {k: (None, total["a"], total["b"], 0) for k in range(1, n_shards)}
    while open_:
        counts = {}
        for fixed in sorted({x[0] for x in open_.values()}, key=lambda x: (x is not None, x)):
            spans = sorted({x[1:3] for x in open_.values() if x[0] == fixed})
            rows = keys if fixed is None else keys.filter(F.col("key") == _long(fixed))
            for i, bins in _probe(rows, "key" if fixed is None else "tie", spans, probes).items():
                counts[fixed, spans[i]] = bins
        later = {}
        for k, (fixed, low, high, below) in open_.items():
            bins, want = counts[fixed, (low, high)], share * k
            at = 0
            while at < len(bins) - 1 and below + bins[at][2] <= want:
                below += bins[at][2]
                at += 1
            a, b, size = bins[at]
            left, right = want - below, below + size - want
            point = (lambda v: (v, -1)) if fixed is None else (lambda v, f=fixed: (f, v))
            last = b + 1  # nothing lies between b and the next bin's first row
            if min(abs(left), abs(right)) <= tolerance * share or (a == b and fixed is not None):
                found[k] = point(a) if abs(left) <= abs(right) else point(last)
            elif a == b:  # one group of equal texts: go inside
                later[k] = (a, 0, (1 << 63) - 1, below)
            else:
                later[k] = (fixed, a, b, below)
        open_ = later
    return [found[k] for k in range(1, n_shards)]


def shard(
    df: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 1e-3,
    probes: int = 64,
    piece_bytes: int = 4 << 20,
    task_bytes: int = 256 << 20,
) -> DataFrame:
    """df with size, shard and slot.

    size: UTF-8 bytes of the text (null: none) plus 1. Shards get nearly equal
    sums of size. Each shard is written in pieces of about piece_bytes (dealt by
    the id's hash, sorted by text hash within), so no task gets a whole shard,
    and pieces are small enough to spread evenly over tasks; the exchange has
    the session's number of partitions, or more where a task would get above
    task_bytes. slot numbers a shard's rows from 0, piece after piece. Null ids count as one
    id. An empty table gives no rows; columns of df named like a result are replaced.
    """
    scratch = Scratch(df.sparkSession, "shards")
    size = (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long")
    key = F.shiftrightunsigned(F.xxhash64(text_of(text_col)), 1)
    tie = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 1)
    keys = scratch.put(df.select(key.alias("key"), tie.alias("tie"), size.alias("size")))
    cuts = splitters(keys, n_shards, tolerance, probes)
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    pieces = max(1, -(-total // (n_shards * piece_bytes)))

    def placed(k: Column, t: Column) -> Column:
        right = [(k > _long(a)) | ((k == _long(a)) & (t >= _long(b))) for a, b in cuts]
        return sum((x.cast("int") for x in right), F.lit(0))

    piece = lambda t: F.pmod(t, _long(pieces)).cast("int")
    cells = keys.groupBy(placed(F.col("key"), F.col("tie")).alias("__s"), piece(F.col("tie")).alias("__p")).count()
    before = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.put(cells.select("__s", "__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before")))
    scratch.drop(keys)
    rows = df.drop("size", "shard", "slot").withColumns({"size": size, "__k": key, "__t": tie})
    rows = rows.withColumns({"shard": placed(F.col("__k"), F.col("__t")), "__p": piece(F.col("__t"))})
    tasks = -(-total // task_bytes)
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, "shard", "__p")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("shard", "__p").orderBy("__k", "__t", id_col)))
    rows = rows.join(cells.withColumnRenamed("__s", "shard"), ["shard", "__p"])
    return rows.withColumn("slot", F.col("__before") + F.col("__n") - 1).drop("__k", "__t", "__p", "__n", "__before")
