"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: every source starts with its weight's share of all words; sources above
their cap (max_epochs times their size) are clamped to it and the excess is
dealt to the rest by weight, until none is above. Sampling: each document is
taken as often as the whole epochs say; for the fraction left, documents are
ordered by a seeded hash, and taken from the front until the next would go over
the target, plus the one document whose size comes nearest what is missing. The
place where the fraction ends is found on a histogram of the hash, refined until
the bin that holds it has few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, text_of

#: The hash has 63 bits; a round of the search for a place in its order looks at so many more of them.
_BITS = 12


def water_fill(sources: DataFrame, scratch: Scratch, max_epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with target. The driver sees one row of sums a round.

    A source is one row, null included; equal weights share by equal parts, a source without size gets 0; no sources
    give no rows.
    """
    sources = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    free = F.lit(True)
    level = None
    while True:
        row = sources.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(~free, F.col("cap"))).alias("held"),
            F.sum(F.when(free, F.col("weight"))).alias("weight"),
            F.count(F.when(~free, 1)).alias("clamped"),
        ).first()
        if not row["weight"]:
            break
        level = ((row["all"] or 0) - (row["held"] or 0.0)) / row["weight"]
        over = F.col("weight") * F.lit(level) > F.col("cap")
        if sources.filter(over).count() <= row["clamped"]:
            break
        free = ~over
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return scratch.put(sources.withColumn("target", target.cast("double")).drop("cap"))


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    bin_rows: int = 4096,
) -> DataFrame:
    """df with size (words), source_size, target, repeats and taken = size x repeats.

    Sources in code-point order, null last, take the weights in turn. Rows that
    share an id share their fate. A source without words has target 0 and takes
    nothing. An empty table gives no rows; columns named like a result are replaced.
    """
    scratch = Scratch(df.sparkSession, "mixing")
    size = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 1)
    units = df.select(F.col(source_col).alias("source"), u.alias("u"), size.alias("size"))
    units = scratch.put(units.groupBy("source", "u").agg(F.sum("size").alias("size")))

    sources = scratch.put(units.groupBy("source").agg(F.sum("size").alias("source_size")))
    # one row a source: this window orders sources, never documents
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*(F.lit(float(w)) for w in weights))
    sources = scratch.put(sources.withColumn("weight", F.element_at(turn, ((rank - 1) % len(weights) + 1).cast("int"))))
    sources = water_fill(sources, scratch, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(epochs).cast("int"))
    sources = sources.withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))

    # the bin of the hash in which the fraction ends, refined; then the place within it
    end = sources.select(F.col("source").alias("s"), "part", F.lit(0).cast("long").alias("end_bin"), F.lit(0).cast("long").alias("below"))
    shift = 63
    while True:
        inside = units.join(end, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("u", shift) == F.col("end_bin")))
        if shift < 63 and (shift == 0 or not (most or 0) > bin_rows):
            break
        shift = max(0, shift - _BITS)
        bins = inside.groupBy("source", "part", "below", F.shiftright("u", shift).alias("bin")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
        # at most 4096 bins of a source
        bins = bins.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("bin")))
        over = bins.filter(F.col("upto") > F.col("part")).groupBy("source", "part")
        over = over.agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("size")).alias("below"), "n"), "bin").alias("e"))
        old = end
        end = scratch.put(over.select(F.col("source").alias("s"), "part", F.col("e.bin").alias("end_bin"), F.col("e.below").alias("below"), F.col("e.n").alias("n")))
        scratch.drop(old)
        most = end.agg(F.max("n")).first()[0]
    near = inside.withColumn("upto", F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("u")))
    cut = near.filter(F.col("upto") > F.col("part")).groupBy("source", "part").agg(
        F.min_by(F.struct("u", (F.col("upto") - F.col("size")).alias("below")), "u").alias("e")
    )
    cut = scratch.put(cut.select(F.col("source").alias("s"), F.col("e.u").alias("cut"), (F.col("part") - F.col("e.below")).alias("missing")))
    rest = units.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("u") >= F.col("cut")))
    off = F.abs(F.col("size") - F.col("missing"))
    extra = rest.filter(off < F.col("missing")).groupBy("source").agg(F.min_by("u", F.struct(off, F.col("u"))).alias("extra"))
    plan = sources.join(cut.drop("missing"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = plan.join(extra.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = scratch.put(plan.select(F.col("source").alias("__s"), "source_size", "target", "whole", F.col("part").alias("__part"), "cut", "extra"))

    rows = df.drop("size", "source_size", "target", "repeats", "taken").withColumns({"size": size, "__u": u})
    rows = rows.join(plan, F.col(source_col).eqNullSafe(F.col("__s")))
    # a fraction that never ends in the data takes all
    more = (F.col("cut").isNull() & (F.col("target") > F.col("whole") * F.col("source_size"))) | (F.col("__u") < F.col("cut")) | (F.col("__u") == F.col("extra"))
    # where whole epochs meet the target nothing is left to take, documents without words included
    rows = rows.withColumn("repeats", F.col("whole") + F.coalesce(more & (F.col("__part") > 0) & (F.col("whole") < max_epochs), F.lit(False)).cast("int"))
    rows = rows.withColumn("taken", F.col("size") * F.col("repeats"))
    return rows.drop("__u", "__s", "whole", "__part", "cut", "extra")
