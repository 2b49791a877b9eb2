"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Each text is cut into fixed-size blocks. The distinct blocks are sorted and get
integer names (their positions in that order); then adjacent names are paired
and the distinct pairs named the same way, level by level, until one integer is
left for each document. Names stand for contents one to one, so equal names mean
equal texts: the sort is by hash first, and blocks whose hashes are equal are
told apart by their bytes.

Shuffles: the blocks once, after map-side collapsing of copies; all else is
narrow integers. Joins of occurrences to names are plain equi-joins, which
Spark's adaptive skew handling may split, so a block that a third of all rows
share is dealt over many tasks; groups that are large for the table meet their
rows by a broadcast of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Scratch, join_groups, text_of

#: Names within a range of the sort order; a range is one key of a window, so it bounds what a task sorts.
_LOCAL = 1 << 40
_RANGE_ROWS = 1 << 16


def _bits(rows: int) -> int:
    """So many top bits of a hash that a range has about _RANGE_ROWS of the rows at most; 1024 ranges at least."""
    return min(22, max(10, (rows // _RANGE_ROWS).bit_length()))


def _ranged(key: Column, bits: int) -> Column:
    """A name's range: the top bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits)


def _named_blocks(blocks: DataFrame, bits: int) -> DataFrame:
    """One row per block hash: the first name of its blocks, how many differ, and those if there are several."""
    kinds = blocks.groupBy("bh").agg(F.collect_set("block").alias("v"))
    kinds = kinds.select("bh", F.size("v").alias("kinds"), F.when(F.size("v") > 1, F.array_sort("v")).alias("variants"))
    order = Window.partitionBy("r").orderBy("bh").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("kinds").over(order), F.lit(0))
    return kinds.withColumn("r", _ranged(F.col("bh"), bits)).select(
        "bh", "kinds", "variants", (F.col("r") * F.lit(_LOCAL) + first).alias("name")
    )


def _named_pairs(pairs: DataFrame, bits: int) -> DataFrame:
    """An integer for each distinct pair of names."""
    distinct = pairs.select("a", "b").distinct().withColumn("r", _ranged(F.xxhash64("a", "b"), bits))
    order = Window.partitionBy("r").orderBy("a", "b")
    return distinct.select("a", "b", (F.col("r") * F.lit(_LOCAL) + F.row_number().over(order)).alias("name"))


def _numbered(df: DataFrame, scratch: Scratch) -> DataFrame:
    """df written with a number for each row (__rid), by which all steps tell rows apart, equal ones too."""
    return scratch.put(df.withColumn("__rid", F.monotonically_increasing_id()))


def _normal(text_col: str) -> Column:
    return F.regexp_replace(text_of(text_col), SPACES, " ")


def identities(base: DataFrame, scratch: Scratch, block_bytes: int = 4096, block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(__rid, level, name) for each row of base (__rid, t: normalised text as bytes).

    (level, name) is equal exactly where the texts are equal.
    """
    width = F.greatest(F.lit(1), F.ceil(F.octet_length("t") / F.lit(block_bytes))).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), F.col("width") - 1),
        lambda i: F.substring(F.col("t"), i * block_bytes + 1, F.lit(block_bytes)),
    )
    blocks = base.withColumn("width", width).select("__rid", "width", F.posexplode(cut).alias("pos", "block"))
    blocks = blocks.withColumn("bh", block_hash(F.col("block")))

    names = scratch.put(_named_blocks(blocks.select("bh", "block"), _bits(base.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0])))
    at = ["__rid", "width", "pos"]
    level = blocks.select(*at, "bh").join(names.filter("kinds = 1").select("bh", "name"), "bh").select(*at, "name")
    if not names.filter("kinds > 1").isEmpty():
        # blocks that differ under one hash: told apart by their bytes
        several = names.filter("kinds > 1").select("bh", "variants", F.col("name").alias("first"))
        own = F.col("first") + F.array_position("variants", F.col("block")) - 1
        level = level.unionByName(blocks.join(several, "bh").select(*at, own.alias("name")))
    level = scratch.put(level)
    scratch.drop(names)

    out, depth = [], 0
    while True:
        out.append(level.filter("width = 1").select("__rid", F.lit(depth).alias("level"), "name"))
        rest = level.filter("width > 1")
        if rest.isEmpty():
            break
        half = F.expr("pos div 2").cast("int")
        pairs = rest.groupBy("__rid", "width", half.alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = scratch.put(pairs)
        named = _named_pairs(pairs, _bits(pairs.count()))
        level = scratch.put(pairs.join(named, ["a", "b"]).select("__rid", F.expr("(width + 1) div 2").cast("int").alias("width"), "pos", "name"))
        scratch.drop(pairs)
        depth += 1
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _groups(base: DataFrame, scratch: Scratch, block_bytes: int, block_hash: Callable[[Column], Column]) -> DataFrame:
    """(__rid, keep_id, group_size, kept) for base (__rid, doc, t)."""
    ids = identities(base.select("__rid", "t"), scratch, block_bytes, block_hash)
    rows = scratch.put(ids.join(base.select("__rid", "doc"), "__rid"))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("__rid").alias("rid"))).alias("first")
    groups = scratch.put(rows.groupBy("level", "name").agg(first, F.count(F.lit(1)).alias("group_size")))
    rows = join_groups(rows, groups, ["level", "name"], "group_size", rows.count())
    return rows.select("__rid", F.col("first.doc").alias("keep_id"), "group_size", (F.col("__rid") == F.col("first.rid")).alias("kept"))


def exact_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = 4096,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became
    one space; null counts as empty. keep_id is the smallest id of the group
    (null only if all are null). Of repeated rows with one id and one text,
    one is kept. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(df.sparkSession, "exact-dedup")
    base = _numbered(df.select(F.col(id_col).alias("doc"), _normal(text_col).cast("binary").alias("t")), scratch)
    rows = base.select("__rid", F.col("doc").alias(id_col), F.sha2("t", 256).alias("text_sha256"))
    return rows.join(_groups(base, scratch, block_bytes, block_hash), "__rid").select(id_col, "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4096) -> DataFrame:
    """The rows that exact_groups keeps, whole, with the columns of df; nulls, ties and repeated rows as there."""
    scratch = Scratch(df.sparkSession, "exact-dedup")
    rows = _numbered(df, scratch)
    base = rows.select("__rid", F.col(id_col).alias("doc"), _normal(text_col).cast("binary").alias("t"))
    kept = _groups(base, scratch, block_bytes, F.xxhash64).filter("kept").select("__rid")
    return rows.join(kept, "__rid", "left_semi").select(*df.columns)
