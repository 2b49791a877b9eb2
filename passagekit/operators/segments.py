"""A BM25 index that grows: immutable segments, deletions, merged statistics, compaction.

Every change writes a segment of its own: docs (doc, ord, dl, terms, gone), postings
(term, doc, tf, dl) and terms (term, df). A document's row in the latest segment
that names it counts; gone says that it was deleted there. A version is a small
file that lists the live segments and the batches they came from; it is written
last, under a number of its own, so a change that fails leaves the index as it
was, two writers can't both win, and a batch that comes again changes nothing.

load() merges: lengths and counts are summed over segments, and what dead rows
(replaced or deleted) add to a term's df is taken off by reading their postings
alone. compact() writes the live rows as one segment.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import path_of
from . import bm25


class Conflict(RuntimeError):
    """Another writer made the version that was to be made."""


def _list(spark: SparkSession, path: str) -> list[str]:
    p, fs = path_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[1:]) for n in _list(spark, f"{path}/versions") if n.startswith("v"))


def _read(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the latest version; 0 and an empty one where there is none."""
    made = _versions(spark, path)
    if not made:
        return 0, {"segments": [], "batches": []}
    text = spark.read.text(f"{path}/versions/v{made[-1]:09d}", wholetext=True).first()[0]
    return made[-1], json.loads(text)


def _write(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """The version, whole under another name first, then renamed, which fails if it is there."""
    tmp, fs = path_of(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    to, _ = path_of(spark, f"{path}/versions/v{number:09d}")
    if fs.exists(to) or not fs.rename(tmp, to):
        fs.delete(tmp, False)
        raise Conflict(f"version {number} of {path} is there already")


def _segment(rows: DataFrame, path: str) -> str:
    """A segment of (doc, ord, dl, terms, gone) rows, of those with one id the greatest; returns its name."""
    name, spark = f"s{uuid.uuid4().hex}", rows.sparkSession
    at = f"{path}/segments/{name}"
    _put(rows.select("doc", "ord", "dl", "terms", "gone"), f"{at}/docs")  # texts are tokenised once
    back = spark.read.parquet(f"{at}/docs")
    if not back.groupBy("doc").count().filter("count > 1").isEmpty():  # ids alone are shuffled, unless some come again
        once = back.groupBy("doc").agg(F.max(F.struct("ord", "dl", "terms", "gone")).alias("r"))
        _put(once.select("doc", "r.*"), f"{at}/once")
        (old, fs), (new, _) = (path_of(spark, f"{at}/{n}") for n in ("docs", "once"))
        if not (fs.delete(old, True) and fs.rename(new, old)):
            raise RuntimeError(f"{at}/docs could not be replaced")
        back = spark.read.parquet(f"{at}/docs")
    posts = back.select("doc", "dl", F.explode("terms").alias("t")).select("t.term", "doc", "t.tf", "dl")
    _put(posts.repartition("term").sortWithinPartitions("term", "doc"), f"{at}/postings")  # by hash: ranges would take a pass over all for their bounds
    _put(spark.read.parquet(f"{at}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{at}/terms")
    return name


def _put(df: DataFrame, at: str) -> None:
    df.write.option("compression", "zstd").parquet(at)


def _commit(spark: SparkSession, path: str, rows: DataFrame, batch: str | None) -> bool:
    number, now = _read(spark, path)
    if batch is not None and batch in now["batches"]:
        return False
    name = _segment(rows, path)
    _write(spark, path, number + 1, {"segments": [*now["segments"], name], "batches": [*now["batches"], *([batch] if batch is not None else [])]})
    return True


def append(spark: SparkSession, path: str, df: DataFrame, id_col: str, text: Column, ordinal: Column | None = None, batch: str | None = None, normalizer=None) -> bool:  # noqa: ANN001
    """Documents added, or put in the place of those with their ids. False if the batch of that name is in already.

    Of rows with one id one counts (the greatest ordinal, then length). Rows without an id are passed over.
    """
    rows = bm25.document_terms(df.filter(F.col(id_col).isNotNull()), id_col, text, ordinal, normalizer)
    return _commit(spark, path, rows.withColumn("gone", F.lit(False)), batch)


def delete(spark: SparkSession, path: str, ids: DataFrame, id_col: str, batch: str | None = None) -> bool:
    """Documents taken out; ids that the index hasn't change nothing."""
    _, now = _read(spark, path)
    if not now["segments"]:
        return False
    like = _table(spark, path, now["segments"][:1], "docs").schema
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    rows = ids.select(F.col(id_col).cast(like["doc"].dataType).alias("doc")).filter("doc is not null").distinct()
    rows = rows.select("doc", F.lit(None).cast(like["ord"].dataType).alias("ord"), F.lit(0).cast("long").alias("dl"), none.alias("terms"), F.lit(True).alias("gone"))
    return _commit(spark, path, rows, batch)


def _table(spark: SparkSession, path: str, segments: list[str], kind: str, only: list[int] | None = None) -> DataFrame:
    parts = [spark.read.parquet(f"{path}/segments/{s}/{kind}").withColumn("seg", F.lit(n)) for n, s in enumerate(segments) if only is None or n in only]
    return reduce(DataFrame.unionByName, parts)


def load(spark: SparkSession, path: str, version: int | None = None) -> bm25.Bm25Index:
    """The live documents as one index: the same scores as an index built of them at once. version: an earlier state."""
    if version is None:
        version, now = _read(spark, path)
    elif version in _versions(spark, path):
        now = json.loads(spark.read.text(f"{path}/versions/v{version:09d}", wholetext=True).first()[0])
    else:
        version = 0
    if not version:
        raise FileNotFoundError(f"no such index at {path}; append to it first")
    return _merged(spark, path, now["segments"])


def _merged(spark: SparkSession, path: str, names: list[str], few: int = 1_000_000) -> bm25.Bm25Index:
    """The live documents of segments. Segments without any are passed over; up to `few` dead rows are sent to the scans."""
    named = _table(spark, path, names, "docs")
    if len(names) > 1:
        places = named.select("doc", "gone", "seg")
        last = places.groupBy("doc").agg(F.max("seg").alias("last"))
        rows = places.join(last, "doc").withColumn("live", (F.col("seg") == F.col("last")) & ~F.col("gone"))
        state = {r["seg"]: (r["live"], r["dead"]) for r in rows.groupBy("seg").agg(F.count_if("live").alias("live"), F.count_if(~F.col("live") & ~F.col("gone")).alias("dead")).collect()}  # a row a segment
        living = [n for n in range(len(names)) if state.get(n, (0, 0))[0]]
        dead = rows.filter(~F.col("live") & ~F.col("gone") & F.col("seg").isin(living)).select("doc", "seg")  # replaced or deleted
        dead = F.broadcast(dead) if sum(state[n][1] for n in living) <= few else dead
        whole = [n for n in living if not state[n][1]]
    else:
        living = whole = [0]
    columns = ["doc", "ord", "dl", "terms"]
    if living:
        docs = _table(spark, path, names, "docs", living).filter("not gone")
        docs = docs.join(dead, ["doc", "seg"], "left_anti").select(*columns) if whole != living else docs.select(*columns)
        postings, terms = (_table(spark, path, names, k, living) for k in ("postings", "terms"))
        if whole != living:
            parts = _table(spark, path, names, "postings", [n for n in living if n not in whole])
            lost = parts.join(dead, ["doc", "seg"], "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"))
            terms = terms.select("term", "df").unionByName(lost)
            kept = parts.join(dead, ["doc", "seg"], "left_anti")
            postings = kept.unionByName(_table(spark, path, names, "postings", whole)) if whole else kept
    else:
        docs, postings, terms = (_table(spark, path, names[:1], k).limit(0) for k in ("docs", "postings", "terms"))
        docs = docs.select(*columns)
    terms = terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    weights, corpus = bm25.weighted(terms, bm25.lengths(docs))
    return bm25.Bm25Index(docs, postings.select("term", "doc", "tf", "dl"), weights, corpus)


def compact(spark: SparkSession, path: str) -> None:
    """The live documents as the only segment of a new version; older segments stay until vacuum().

    Postings are filtered and written as they are read, in the order of their terms within a file, so nothing is shuffled but
    counts.
    """
    number, now = _read(spark, path)
    if not number:
        raise FileNotFoundError(f"no such index at {path}; append to it first")
    index = _merged(spark, path, now["segments"])
    name = f"s{uuid.uuid4().hex}"
    at = f"{path}/segments/{name}"
    _put(index.docs.withColumn("gone", F.lit(False)), f"{at}/docs")
    _put(index.postings, f"{at}/postings")
    _put(index.terms.select("term", "df"), f"{at}/terms")
    _write(spark, path, number + 1, {"segments": [name], "batches": now["batches"]})


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes segments and versions that the latest version doesn't need (for when nobody reads earlier ones); returns the segments' names."""
    number, now = _read(spark, path)
    gone = [s for s in _list(spark, f"{path}/segments") if s not in now["segments"]]
    for at in [f"segments/{s}" for s in gone] + [f"versions/{n}" for n in _list(spark, f"{path}/versions") if n != f"v{number:09d}"]:
        p, fs = path_of(spark, f"{path}/{at}")
        fs.delete(p, True)
    return gone
