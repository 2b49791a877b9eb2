"""BM25 (Okapi) over an inverted index held as tables.

build() gives postings, lengths and statistics; search() answers a table of
queries with one join on terms and one rank per query. Nothing is broadcast by
hand: the query side is small or not, and Spark sees its size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_search, tokens, with_value, words_in_tasks
from ..sinks.writers import write_index
from ..sources.readers import read_table

K1, B, EPSILON = 1.5, 0.75, 0.25


@dataclass
class Bm25Index:
    """docs (doc, ord, dl, terms), postings (term, doc, tf, dl), terms (term, df, idf), corpus (n, avgdl, mean_idf): one row.

    A posting has its document's length, so that scores need no join with documents. docs has the same counts by
    document (terms: an array of (term, tf)), for questions with so many terms that most postings would be read.
    """

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"docs": self.docs, "postings": self.postings, "terms": self.terms, "corpus": self.corpus}


def counted_terms(words: Column) -> Column:
    """An array of words as an array of (term, tf), in order of the terms: counted within the row, so without a shuffle."""
    return with_value(
        F.sort_array(words),
        lambda s: with_value(
            F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (F.get(s, i - 1) != w), i)), lambda i: i.isNotNull()),
            lambda at: F.transform(at, lambda i, k: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).cast("long").alias("tf"))),
        ),
    )


def document_terms(df: DataFrame, id_col: str, text: Column, ordinal: Column | None = None, normalizer=None) -> DataFrame:  # noqa: ANN001
    """(doc, ord, dl, terms): a row a document, terms an array of (term, tf). No shuffle."""
    own = [F.col(id_col).alias("doc"), (F.col(id_col) if ordinal is None else ordinal).alias("ord")]
    return words_in_tasks(df, own, text, _counter, {"dl": "bigint", "terms": "array<struct<term:string,tf:bigint>>"}, normalizer or normalize_search)


def _counter() -> Callable:
    """counted_terms() and the number of words of many rows, within a task."""
    import pyarrow as pa

    def count(rows: Iterator) -> tuple:
        sizes, ends, terms, tfs = [], [0], [], []
        for words in rows:
            found = Counter(words)
            own = sorted(found)  # by code point, as sort_array has them
            terms += own
            tfs += map(found.__getitem__, own)
            sizes.append(len(words))
            ends.append(len(terms))
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
        return pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return count


def weighted(terms: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """terms (term, df) with idf, corpus (n, avgdl) with mean_idf. A negative idf becomes EPSILON times the mean of all, as it was."""
    rows = terms.crossJoin(F.broadcast(corpus))  # one row
    rows = rows.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = rows.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return rows.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf")), corpus.crossJoin(F.broadcast(mean))


def build(df: DataFrame, id_col: str, text: Column, ordinal: Column | None = None, normalizer=None, keep: Callable[[DataFrame], DataFrame] = lambda t: t) -> Bm25Index:  # noqa: ANN001
    """ordinal breaks ties between equal scores (the place in the corpus); the id if not given.

    Texts are tokenised once and terms counted within their row; what is
    shuffled is one row a term for the statistics, and in save() the postings,
    once, by term. Questions of many terms read documents and not postings. keep is applied to the table that later steps read more than
    once; pass session.materialized to have it written and not worked out anew.
    """
    rows = keep(document_terms(df, id_col, text, ordinal, normalizer))
    postings = _postings(rows)
    terms, corpus = weighted(keep(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))), lengths(rows))
    return Bm25Index(rows, postings, terms, corpus)


def _postings(docs: DataFrame) -> DataFrame:
    return docs.select("doc", "dl", F.explode("terms").alias("t")).select("t.term", "doc", "t.tf", "dl")


def lengths(docs: DataFrame) -> DataFrame:
    """One row: n and avgdl."""
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def term_statistics(df: DataFrame, text: Column, normalizer=None) -> DataFrame:  # noqa: ANN001
    """(term, df, idf) of texts without an index: one exchange of a row a term and task."""
    words = tokens(text) if normalizer is None else tokens(text, normalizer)
    terms = df.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return weighted(terms, df.agg(F.count(F.lit(1)).alias("n")))[0]


def save(index: Bm25Index, path: str) -> None:
    """The index as tables below path, overwritten whole; postings and terms in ranges of the term, so that a scan for a few terms skips the rest."""
    tables = index.tables()
    write_index({"docs": tables.pop("docs")}, path)
    write_index({k: _by_term(t) if k in ("postings", "terms") else t for k, t in tables.items()}, path)


def _by_term(table: DataFrame) -> DataFrame:
    return table.repartitionByRange("term").sortWithinPartitions(*(c for c in ("term", "doc") if c in table.columns))


def create(path: str, df: DataFrame, id_col: str, text: Column, ordinal: Column | None = None, normalizer=None, postings: bool = True) -> Bm25Index:  # noqa: ANN001
    """build() and save() in one: each table is written once and the next made of it. Texts are tokenised once, postings shuffled once.

    postings: False leaves them to add_postings(), for an index that answers tables of many questions, which read documents.
    """
    spark = df.sparkSession
    write_index({"docs": document_terms(df, id_col, text, ordinal, normalizer)}, path)
    docs = read_table(spark, f"{path}/docs")
    if postings:
        add_postings(spark, path)
    rows = read_table(spark, f"{path}/postings") if postings else docs.select(F.explode("terms.term").alias("term"))
    write_index({"counts": rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))}, path)  # read three times
    terms, corpus = weighted(read_table(spark, f"{path}/counts"), lengths(docs))
    write_index({"terms": _by_term(terms), "corpus": corpus}, path)
    return load(spark, path)


def add_postings(spark: SparkSession, path: str) -> None:
    """The postings of the index at path, made of its documents' counts."""
    write_index({"postings": _by_term(_postings(read_table(spark, f"{path}/docs")))}, path)


def load(spark: SparkSession, path: str) -> Bm25Index:
    """The index that save() or create() wrote; FileNotFoundError where there is none. Postings that weren't stored are read from the documents."""
    docs, terms, corpus = (read_table(spark, f"{path}/{name}") for name in ("docs", "terms", "corpus"))
    try:
        return Bm25Index(docs, read_table(spark, f"{path}/postings"), terms, corpus)
    except FileNotFoundError:
        return Bm25Index(docs, _postings(docs), terms, corpus)


def scores(index: Bm25Index, queries: DataFrame, text: Column, qid: str = "qid", k1: float = K1, b: float = B, normalizer=None, few: int = 1000, best: int | None = None, sent: int = 1_000_000) -> DataFrame:  # noqa: ANN001
    """(qid, doc, score) of documents that share a term; repeated query words count each time.

    Up to `few` different terms go to the scan of a stored index as a filter, and their postings are added up by a
    shuffle of (question, document) pairs. Of questions with more, where only the `best` documents of each are
    wanted, the (term, question) pairs go to the documents, if there are `sent` of them at most: a task gives the
    best of its own documents, and no pair is shuffled. Else postings are joined.
    """
    words = tokens(text) if normalizer is None else tokens(text, normalizer)
    asked = queries.select(qid, F.explode(words).alias("term")).groupBy(qid, "term").agg(F.count(F.lit(1)).alias("qtf"))
    terms, postings = index.terms, index.postings
    own = asked.select("term").distinct().limit(few + 1).collect()
    if len(own) <= few:
        among = F.col("term").isin([r["term"] for r in own])
        terms, postings = terms.filter(among), postings.filter(among)
    elif best is not None and "terms" in index.docs.columns:
        pairs = asked.join(terms, "term").select(qid, "term", (F.col("qtf") * F.col("idf")).alias("weight")).limit(sent + 1).toArrow()
        if 0 < pairs.num_rows <= sent:
            return _by_documents(index, pairs, queries.schema[qid].dataType.simpleString(), best, qid, k1, b)
    hits = asked.join(terms, "term").join(postings, "term").crossJoin(F.broadcast(index.corpus.select("avgdl")))  # one row
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(qid, "doc").agg(F.sum(part).alias("score"))


def _by_documents(index: Bm25Index, pairs, q_kind: str, best: int, qid: str, k1: float, b: float, cells: int = 1 << 19) -> DataFrame:  # noqa: ANN001
    """(qid, doc, score): of each question the best documents of every task, ties to the lower ordinal.

    pairs: an Arrow table (qid, term, weight). A batch of documents is scored as a matrix of documents x questions.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    qids = pc.unique(pairs.column(0).combine_chunks())
    known = pc.unique(pairs.column(1).combine_chunks())
    term_of, q_of = (np.asarray(pc.index_in(pairs.column(c).combine_chunks(), value_set=v)) for c, v in ((1, known), (0, qids)))
    order = np.argsort(term_of, kind="stable")
    q_of, weight = q_of[order], np.asarray(pairs.column(2))[order]
    first = np.searchsorted(term_of[order], np.arange(len(known) + 1))
    corpus = index.corpus.select("n", "avgdl").first()
    n_q, avgdl = len(qids), corpus["avgdl"]
    # a task has some millions of (document, question) pairs at least, as each gives the best rows of every question
    tasks = max(1, -(-corpus["n"] * n_q // (1 << 21)))

    def run(batches: Iterator) -> Iterator:
        kept: list[tuple] = []  # (question, rounded score, score, ord, doc)

        def cut() -> None:
            at, rounded, score = (np.concatenate([r[c] for r in kept]) for c in range(3))
            place, doc = (pa.concat_arrays([r[c] for r in kept]) for c in (3, 4))
            by = pc.sort_indices(pa.table({"q": at, "s": rounded, "o": place}), [("q", "ascending"), ("s", "descending"), ("o", "ascending")])
            by = np.asarray(by)
            fine = by[np.arange(len(by)) - np.searchsorted(at[by], at[by]) < best]
            kept[:] = [(at[fine], rounded[fine], score[fine], place.take(pa.array(fine)), doc.take(pa.array(fine)))]

        for whole in batches:
            step = max(1, cells // max(1, n_q))
            for i in range(0, whole.num_rows, step):
                batch = whole.slice(i, step)
                lists = batch.column(3)
                row = np.asarray(pc.list_parent_indices(lists))
                flat = lists.flatten()
                term = np.asarray(pc.fill_null(pc.index_in(flat.field("term"), value_set=known), -1))
                there = np.flatnonzero(term >= 0)
                term, row, tf = term[there], row[there], np.asarray(flat.field("tf"))[there].astype(float)
                dl = np.asarray(batch.column(2))[row]
                part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
                many = first[term + 1] - first[term]
                each = np.repeat(first[term], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                cell = np.repeat(row, many) * n_q + q_of[each]
                score = np.bincount(cell, np.repeat(part, many) * weight[each], batch.num_rows * n_q).reshape(-1, n_q)
                shared = np.zeros(batch.num_rows * n_q, bool)
                shared[cell] = True
                shared = shared.reshape(-1, n_q)
                rounded = np.where(shared, np.round(score, 9), -np.inf)
                if len(rounded) > best:  # no worse than the best-th of this batch
                    shared &= rounded >= -np.partition(-rounded, best - 1, axis=0)[best - 1]
                r, q = np.nonzero(shared)
                at = pa.array(r)
                kept.append((q, rounded[r, q], score[r, q], batch.column(1).take(at), batch.column(0).take(at)))
            if sum(len(x[0]) for x in kept) > 8 * best * n_q:
                cut()
        if kept:
            cut()
            q, _, score, _, doc = kept[0]
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), doc, pa.array(score)], ["qid", "doc", "score"])

    d_kind = index.docs.schema["doc"].dataType.simpleString()
    hits = index.docs.select("doc", "ord", "dl", "terms").coalesce(tasks).mapInArrow(run, f"qid {q_kind}, doc {d_kind}, score double")
    return hits.withColumnRenamed("qid", qid)


def search(
    index: Bm25Index,
    queries: DataFrame,
    text: Column,
    k: int = 20,
    qid: str = "qid",
    fill: bool = True,
    min_score: float | None = None,
    normalizer=None,  # noqa: ANN001
) -> DataFrame:
    """(qid, doc, score, rank from 0): best first, ties to the lower ordinal.

    fill: queries with under k matching documents are filled up with documents
    of score 0 in corpus order, taken from the first 2k of the corpus.
    """
    found = scores(index, queries, text, qid, normalizer=normalizer, best=k)
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    return ranked(found, index.docs, queries, k, qid, fill and min_score is None)


def ranked(found: DataFrame, docs: DataFrame, queries: DataFrame, k: int, qid: str, fill: bool) -> DataFrame:
    """(qid, doc, score, rank from 0): the k best of found (qid, doc, score), filled up where asked for."""
    # sums of the same parts in another order are the same score; documents join for their place once few are left
    best = F.rank().over(Window.partitionBy(qid).orderBy(F.round("score", 9).desc()))
    found = found.withColumn("rank", best).filter(F.col("rank") <= k).select(qid, "doc", "score").join(docs.select("doc", "ord"), "doc")
    order = Window.partitionBy(qid).orderBy(F.round("score", 9).desc(), "ord")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if fill:
        first = docs.orderBy("ord").limit(2 * k).select("doc", "ord")  # 2k rows
        blank = queries.select(qid).distinct().crossJoin(F.broadcast(first)).withColumn("score", F.lit(None).cast("double"))
        # a document that was found keeps its score; max passes over the nulls of the fill
        both = found.drop("rank").unionByName(blank).groupBy(qid, "doc", "ord").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
        found = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select(qid, "doc", "score", (F.col("rank") - 1).alias("rank"))
