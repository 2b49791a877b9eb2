"""BM25 top-k that leaves most postings unread: spans of documents with score bounds, pruned by the k-th score found.

Documents are cut into spans of `width`, as they stand in their table. A span is
one row: its documents, and for each term the postings and how high they can
score. What a span can give a question is the sum of its terms' bounds. Two passes:

1. Of each question the spans that promise most, as many as surely hold k
   documents, are scored whole. The k-th score found is a floor.
2. Spans that promise less than the floor can't change the result and are left
   out; all others are scored.

The questions' terms go to the spans, which stay where they are: a document's
score is worked out within its row, and a task gives the k best it has found of
each question. So neither postings nor (question, document) pairs are shuffled,
in the build or in a search. Results are those of bm25.search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import Kept
from ..sinks.writers import write_index, write_stage
from ..sources.readers import read_table
from . import bm25

#: Two sums of the same parts in another order differ by less.
SLACK = 1e-6
#: Documents in a row group of stored spans: what a scan reads at once, or skips.
GROUP = 4096
#: Numbers that a task works out at once, for some spans, documents and questions.
CELLS = 1 << 19


@dataclass
class Blocks:
    """headers (span, terms, ns, bounds), blocks (headers' columns and docs, ords, dls; at, tfs), the plain index's docs and terms, corpus.

    Arrays of one length: terms, ns (a term's number of postings) and bounds, the largest share of a score that the
    term has in the span, but for its weight; docs, ords and dls (a document's length); at (the posting's document, as
    its place in docs) and tfs, term by term. corpus (one row) says with which avgdl, k1 and b shares are worked out.
    """

    headers: DataFrame
    blocks: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame


def _share(tf, dl, corpus: dict):  # noqa: ANN001, ANN202
    """Postings' share of a score: tf and dl are arrays of numbers."""
    k1, b = corpus["k1"], corpus["b"]
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / corpus["avgdl"]))


def _blocks(docs: DataFrame, corpus: DataFrame, width: int) -> DataFrame:
    """The spans of docs (doc, ord, dl, terms): documents that stand together in a task, so nothing is shuffled."""
    doc, place = (docs.schema[c].dataType.simpleString() for c in ("doc", "ord"))
    kinds = {"span": "long", "terms": "array<string>", "ns": "array<int>", "bounds": "array<double>", "docs": f"array<{doc}>", "ords": f"array<{place}>", "dls": "array<int>", "at": "array<int>", "tfs": "array<int>"}

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        done = 0
        for whole in batches:
            for i in range(0, whole.num_rows, width):
                part = whole.slice(i, width)
                facts = {c: part.column(c)[0].as_py() for c in ("avgdl", "k1", "b", "part")}
                row = np.asarray(pc.list_parent_indices(part.column("terms")))
                flat = part.column("terms").flatten()
                coded = flat.field("term").dictionary_encode()
                term = np.asarray(coded.indices)
                order = np.argsort(term, kind="stable")
                ns = np.bincount(term, minlength=len(coded.dictionary)).astype(np.int32)
                at, tf, dl = row[order].astype(np.int32), np.asarray(flat.field("tf"))[order], np.asarray(part.column("dl"))
                share = _share(tf.astype(float), dl[at].astype(float), facts) if len(at) else np.zeros(0)
                bounds = np.maximum.reduceat(share, np.cumsum(ns) - ns) if len(at) else share
                lists = [coded.dictionary, ns, bounds, part.column("doc"), part.column("ord"), dl.astype(np.int32), at, tf.astype(np.int32)]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in lists]
                yield pa.RecordBatch.from_arrays([pa.array([(facts["part"] << 32) + done], pa.int64()), *lists], list(kinds))
                done += 1

    # a partition's spans have numbers of their own, the same whenever and in whatever union they are cut again
    rows = docs.select("doc", "ord", "dl", "terms", F.spark_partition_id().alias("part")).crossJoin(F.broadcast(corpus.select("avgdl", "k1", "b")))  # one row
    return rows.mapInArrow(cut, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def _headers(blocks: DataFrame) -> DataFrame:
    return blocks.select("span", "terms", "ns", "bounds")


def _facts(docs: DataFrame, k1: float, b: float) -> DataFrame:
    return bm25.lengths(docs).select("avgdl", F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"))


def build(index: bm25.Bm25Index, width: int = 256, k1: float = bm25.K1, b: float = bm25.B) -> Blocks:
    """The blocks of a plain index."""
    corpus = _facts(index.docs, k1, b)
    rows = _blocks(index.docs, corpus, width)
    return Blocks(_headers(rows), rows, index.docs.select("doc", "ord", "dl"), index.terms, corpus)


def _write_blocks(blocks: DataFrame, path: str, width: int) -> None:
    # few rows at once, as a row is a whole span
    write_stage(blocks, f"{path}/blocks", options={"parquet.block.row.count.limit": str(max(1, GROUP // width))})


def save(index: Blocks, path: str, width: int = 256) -> None:
    """Four tables below path; terms sorted, so that scans for a few skip the rest, as scans for a few spans do. width: of a span at most."""
    write_index({"corpus": index.corpus}, path)
    _write_blocks(index.blocks, path, width)
    _save_terms(path, index.docs, index.terms)


def _save_terms(path: str, docs: DataFrame, terms: DataFrame) -> None:
    write_index({"docs": docs.select("doc", "ord", "dl"), "terms": terms.repartitionByRange("term").sortWithinPartitions("term")}, path)


def create(path: str, df: DataFrame, id_col: str, text: Column, ordinal: Column | None = None, normalizer=None, width: int = 256, k1: float = bm25.K1, b: float = bm25.B) -> Blocks:  # noqa: ANN001
    """The index of texts, without a plain one before it; counted documents and terms are written for as long as it takes."""
    spark = df.sparkSession
    with Kept() as keep:
        docs = keep(bm25.document_terms(df, id_col, text, ordinal, normalizer))
        write_index({"corpus": _facts(docs, k1, b)}, path)
        _write_blocks(_blocks(docs, read_table(spark, f"{path}/corpus"), width), path, width)
        each = read_table(spark, f"{path}/blocks").select(F.explode(F.arrays_zip("terms", "ns")).alias("t"))
        counts = keep(each.groupBy("t.terms").agg(F.sum("t.ns").alias("df")).withColumnRenamed("terms", "term"))  # read more than once
        _save_terms(path, docs, bm25.weighted(counts, bm25.lengths(docs))[0])
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Blocks:
    """The index that save() or create() wrote; FileNotFoundError where there is none."""
    blocks, docs, terms, corpus = (read_table(spark, f"{path}/{name}") for name in ("blocks", "docs", "terms", "corpus"))
    return Blocks(_headers(blocks), blocks, docs, terms, corpus)


class _Asked:
    """Questions' weighted terms, as tasks look them up. pairs: an Arrow table (qid, term, weight)."""

    def __init__(self, pairs) -> None:  # noqa: ANN001
        import numpy as np
        import pyarrow.compute as pc

        qid, term, weight = (pairs.column(c).combine_chunks() for c in range(3))
        self.qids, self.known = pc.unique(qid), pc.unique(term)
        term_of = np.asarray(pc.index_in(term, value_set=self.known))
        order = np.argsort(term_of, kind="stable")
        self.q_of, self.weight = np.asarray(pc.index_in(qid, value_set=self.qids))[order], np.asarray(weight)[order]
        self.first = np.searchsorted(term_of[order], np.arange(len(self.known) + 1))
        self.step = max(1, min(64, CELLS // max(1, len(pairs))))  # spans at once

    def of(self, batch) -> tuple:  # noqa: ANN001
        """(row, place among its terms, pair, n, bound) of each term of a span that a question has, and how many terms a row has."""
        import numpy as np
        import pyarrow.compute as pc

        lists = batch.column("terms")
        sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        term = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=self.known), -1))
        there = np.flatnonzero(term >= 0)
        many = (self.first[1:] - self.first[:-1])[term[there]]
        pair = ranges(self.first[term[there]], many)
        there = np.repeat(there, many)
        row = np.repeat(np.arange(len(sizes)), sizes)[there]
        ns, bounds = (np.asarray(batch.column(c).flatten())[there] for c in ("ns", "bounds"))
        return row, there - (np.cumsum(sizes) - sizes)[row], pair, ns, bounds

    def promises(self, rows: int, row, pair, bounds):  # noqa: ANN001, ANN201
        """What each row can give each question at most; a negative weight adds nothing at best, for the document that has not the term."""
        import numpy as np

        n_q = len(self.qids)
        return np.bincount(row * n_q + self.q_of[pair], np.maximum(self.weight[pair] * bounds, 0), rows * n_q).reshape(rows, n_q)


def ranges(start, many):  # noqa: ANN001, ANN201
    """start[0], start[0] + 1, ... many[0] numbers, then those of the next."""
    import numpy as np

    return np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _spans(index: Blocks, asked: _Asked, qid: str, kind: str) -> DataFrame:
    """(qid, span, promise, sure, n): what a span promises a question, how many documents it has of it at least, and matching postings."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n_q = len(asked.qids)
        for whole in batches:
            for i in range(0, whole.num_rows, asked.step):
                batch = whole.slice(i, asked.step)
                row, _, pair, ns, bounds = asked.of(batch)
                promise = asked.promises(batch.num_rows, row, pair, bounds)
                cell = row * n_q + asked.q_of[pair]
                n, sure = np.bincount(cell, ns, batch.num_rows * n_q), np.zeros(batch.num_rows * n_q, np.int64)
                np.maximum.at(sure, cell, ns)
                any_ = np.flatnonzero(sure)
                out = asked.qids.take(pa.array(any_ % n_q)), batch.column("span").take(pa.array(any_ // n_q)), pa.array(promise.ravel()[any_]), pa.array(sure[any_]), pa.array(n[any_].astype(np.int64))
                yield pa.RecordBatch.from_arrays(list(out), ["qid", "span", "promise", "sure", "n"])

    return index.headers.mapInArrow(run, f"qid {kind}, span long, promise double, sure long, n long").withColumnRenamed("qid", qid)


def _scored(blocks: DataFrame, asked: _Asked, corpus: dict, k: int, qid: str, kind: str, first: dict, floors=None, cells: int = CELLS) -> DataFrame:  # noqa: ANN001
    """(qid, doc, score): of each question the k best of every task, ties to the lower ordinal.

    first: {span: questions' numbers}, the pairs of the first pass. Without floors those are scored; with them, a
    number a question, all other pairs that promise as much.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        n_q = len(asked.qids)
        least = np.full(n_q, -np.inf) if floors is None else floors.copy()  # of a question: what can still be among its k best
        kept: list[tuple] = []  # (question, rounded score, score, ord, doc)

        def best() -> None:
            q, rounded, score = (np.concatenate([r[c] for r in kept]) for c in range(3))
            place, doc = (pa.concat_arrays([r[c] for r in kept]) for c in (3, 4))
            by = np.asarray(pc.sort_indices(pa.table({"q": q, "s": rounded, "o": place}), [("q", "ascending"), ("s", "descending"), ("o", "ascending")], null_placement="at_start"))
            nth = np.arange(len(by)) - np.searchsorted(q[by], q[by])
            last = by[nth == k - 1]
            least[q[last]] = np.maximum(least[q[last]], score[last])
            by = by[nth < k]
            kept[:] = [(q[by], rounded[by], score[by], place.take(pa.array(by)), doc.take(pa.array(by)))]

        def score(span, lists: dict, place, pair, ns) -> None:  # noqa: ANN001
            """span's documents for the terms at these places of its own, a pair each."""
            docs = lists["docs"]
            start = np.cumsum(lists["ns"]) - lists["ns"]
            dl, at, tf = (np.asarray(lists[c]) for c in ("dls", "at", "tfs"))
            share = _share(tf.astype(float), dl[at].astype(float), corpus)
            of, width = asked.q_of[pair], max(1, cells // max(1, len(docs)))
            for low in range(0, n_q, width):
                own = slice(None) if n_q <= width else np.flatnonzero((of >= low) & (of < low + width))
                post, n, wide = ranges(start[place[own]], ns[own]), ns[own], min(width, n_q - low)
                cell = at[post] * np.int64(wide) + np.repeat(of[own] - low, n)
                sums = np.bincount(cell, share[post] * np.repeat(asked.weight[pair[own]], n), len(docs) * wide)
                shared = np.zeros(len(docs) * wide, bool)
                shared[cell] = True
                rounded = np.where(shared, np.round(sums, 9), -np.inf).reshape(-1, wide)
                good = shared.reshape(-1, wide) & (rounded >= least[low : low + wide] - SLACK)
                if len(docs) > k:  # no worse than the k-th of this span
                    good &= rounded >= -np.partition(-rounded, k - 1, axis=0)[k - 1]
                d, q = np.nonzero(good)
                kept.append((q + low, rounded[d, q], sums.reshape(-1, wide)[d, q], lists["ords"].take(pa.array(d)), docs.take(pa.array(d))))

        for whole in batches:
            for i in range(0, whole.num_rows, asked.step):
                batch = whole.slice(i, asked.step)
                row, place, pair, ns, bounds = asked.of(batch)
                promise = asked.promises(batch.num_rows, row, pair, bounds)
                for r, span in enumerate(batch.column("span").to_pylist()):
                    before = np.zeros(n_q, bool)
                    before[first.get(span, [])] = True
                    wanted = before if floors is None else ~before & (promise[r] >= least - SLACK)
                    own = np.arange(*np.searchsorted(row, [r, r + 1]))
                    own = own[wanted[asked.q_of[pair[own]]]]
                    if len(own):
                        lists = {c: batch.column(c)[r].values for c in ("docs", "ords", "dls", "at", "tfs")} | {"ns": np.asarray(batch.column("ns")[r].values)}
                        score(span, lists, place[own], pair[own], ns[own])
                    if sum(len(x[0]) for x in kept) > 4 * k * n_q:
                        best()
        if kept:
            best()
            q, _, points, _, doc = kept[0]
            yield pa.RecordBatch.from_arrays([asked.qids.take(pa.array(q)), doc, pa.array(points)], ["qid", "doc", "score"])

    doc = blocks.schema["docs"].dataType.elementType.simpleString()
    return blocks.mapInArrow(run, f"qid {kind}, doc {doc}, score double").withColumnRenamed("qid", qid)


def _floors(first: DataFrame, k: int, qid: str) -> DataFrame:
    """(qid, floor): the k-th score of each question that has k."""
    order = Window.partitionBy(qid).orderBy(F.col("score").desc())
    kth = first.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k)
    return kth.groupBy(qid).agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("floor")).filter(F.col("c") >= k).select(qid, "floor")


def _among(blocks: DataFrame, spans: DataFrame, few: int) -> DataFrame:
    """blocks, without those that aren't among spans if these are few, so that the scan skips the rest."""
    own = spans.select("span").distinct().limit(few + 1).collect()
    return blocks if len(own) > few else blocks.filter(F.col("span").isin([r["span"] for r in own]))


def passes(index: Blocks, queries: DataFrame, text: Column, k: int, qid: str = "qid", normalizer=None, keep: Callable[[DataFrame], DataFrame] = lambda t: t, few: int = 1000, sent: int = 1_000_000) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(found: (qid, doc, score) that hold the k best; read: (qid, postings, read): matching postings, and those that were read).

    keep is applied to the table of spans' promises and to what the first pass finds, which later steps read. Up to
    `few` terms or spans go to a scan as a filter. Some `sent` (question, term) pairs go to the spans at once;
    questions that have more are taken in parts, each with scans of its own.
    """
    words = tokens(text) if normalizer is None else tokens(text, normalizer)
    asked = queries.select(qid, F.explode(words).alias("term")).groupBy(qid, "term").agg(F.count(F.lit(1)).alias("qtf"))
    parts = -(-asked.count() // sent)
    if parts < 2:
        return _passes(index, asked, k, qid, keep, few)
    both = [_passes(index, asked.filter(F.pmod(F.xxhash64(qid), F.lit(parts)) == p), k, qid, keep, few) for p in range(parts)]
    return tuple(reduce(DataFrame.unionByName, tables) for tables in zip(*both, strict=True))


def _passes(index: Blocks, asked: DataFrame, k: int, qid: str, keep: Callable[[DataFrame], DataFrame], few: int) -> tuple[DataFrame, DataFrame]:
    import numpy as np
    import pyarrow.compute as pc

    terms, own = index.terms, asked.select("term").distinct().limit(few + 1).collect()
    if len(own) <= few:
        terms = terms.filter(F.col("term").isin([r["term"] for r in own]))
    # the questions' side is bounded by `sent`, the terms of the corpus are not
    known = _Asked(terms.join(F.broadcast(asked), "term").select(qid, "term", (F.col("qtf") * F.col("idf")).alias("weight")).toArrow())
    kind, corpus = asked.schema[qid].dataType.simpleString(), index.corpus.first().asDict()
    spans = keep(_spans(index, known, qid, kind))
    before = Window.partitionBy(qid).orderBy(F.col("promise").desc(), "span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("first", F.coalesce(F.sum("sure").over(before), F.lit(0)) < k)
    pairs = spans.filter("first").select(qid, "span").toArrow()  # k a question at most
    at, span = np.asarray(pc.index_in(pairs.column(0).combine_chunks(), value_set=known.qids)), np.asarray(pairs.column(1))
    by = np.argsort(span, kind="stable")
    different, starts = np.unique(span[by], return_index=True)
    first_of = dict(zip(different.tolist(), np.split(at[by], starts[1:]), strict=True)) if len(by) else {}

    score = lambda blocks, floors=None: _scored(blocks, known, corpus, k, qid, kind, first_of, floors)
    chosen = index.blocks.filter(F.col("span").isin(list(first_of))) if len(first_of) <= few else index.blocks
    first = keep(score(chosen))
    floors = _floors(first, k, qid)
    held = floors.toArrow()
    least = np.full(len(known.qids), -np.inf)
    least[np.asarray(pc.index_in(held.column(0).combine_chunks(), value_set=known.qids))] = np.asarray(held.column(1))
    rows = spans.join(floors, qid, "left").withColumn("reached", F.col("floor").isNull() | (F.col("promise") >= F.col("floor") - SLACK))
    found = first.unionByName(score(_among(index.blocks, rows.filter("reached and not first"), few), least))
    read = rows.groupBy(qid).agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("first") | F.col("reached"), F.col("n")).otherwise(0)).alias("read"))
    return found, read


def search(index: Blocks, queries: DataFrame, text: Column, k: int = 20, qid: str = "qid", fill: bool = True, normalizer=None, keep: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:  # noqa: ANN001
    """(qid, doc, score, rank from 0), row for row what bm25.search gives."""
    found, _ = passes(index, queries, text, k, qid, normalizer, keep)
    return bm25.ranked(found, index.docs, queries, k, qid, fill)
