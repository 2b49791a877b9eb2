"""The query API: hybrid retrieval, similar passages, details, processed queries, prompts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, detect_language, detect_period, first_filled, is_arabic, normalize_clean, passage_id, passage_text, point_id, query_text, trimmed
from ..operators import bm25, coverage, fusion, inverted, rerank
from ..operators.context import around, previous_next, with_context
from ..operators.vectors import embed, equality_filter, hash_embedder
from ..schema import HIT, PAYLOAD

FETCH = 20
ROOT_POOL, BM25_POOL, POOL_MAX = 20, 16, 32


def checked(limit: int = 10, chapter: int | None = None, part: int | None = None, window: int = 1, verse: int | None = None, text: str | None = None) -> None:
    """ValueError for arguments out of their ranges."""
    rules = (
        (1 <= limit <= 50, "limit must be 1 to 50"),
        (chapter is None or 1 <= chapter <= 114, "chapter must be 1 to 114"),
        (part is None or 1 <= part <= 30, "part must be 1 to 30"),
        (0 <= window <= 5, "window must be 0 to 5"),
        (verse is None or verse >= 1, "verse must be 1 or more"),
        (text is None or text.strip() != "", "the text is blank"),
    )
    for ok, why in rules:
        if not ok:
            raise ValueError(why)


def hybrid(
    dense: DataFrame,
    index: bm25.Bm25Index,
    queries: DataFrame,
    text: Column,
    attributes: DataFrame | None = None,
    filters: dict | None = None,
    k: int = 5,
    fetch: int = FETCH,
    qid: str = "qid",
    prefilter_sparse: bool = False,
    own: str | None = None,
) -> DataFrame:
    """(qid, id, score): fusion of a dense ranking (qid, id, rank; already filtered) and BM25.

    The sparse list is cut first and filtered after, so it may be shorter;
    prefilter_sparse filters before the cut instead (by filters alone).
    attributes: (id, ...) for filters. own: a column of queries and attributes
    that must agree, where the query's isn't null and filters hasn't the key.
    """
    where = equality_filter(filters, tuple(attributes.columns) if attributes is not None else ())
    own = None if own is None or (filters or {}).get(own) is not None else own
    passing = None if attributes is None or not (filters or own) else attributes.filter(where).select(F.col("id").alias("doc"), *([F.col(own).alias("__has")] if own else []))
    if passing is not None and prefilter_sparse and not own:
        index = bm25.Bm25Index(*(t.join(passing, "doc", "left_semi") for t in (index.docs, index.postings)), index.terms, index.corpus)
        passing = None
    sparse = bm25.search(index, queries, text, fetch, qid)
    if passing is not None:
        if own:
            sparse = sparse.join(passing, "doc").join(queries.select(qid, F.col(own).alias("__wants")), qid)
            sparse = sparse.filter(F.col("__wants").isNull() | (F.col("__wants") == F.col("__has"))).select(qid, "doc", "score", "rank")
        else:
            sparse = sparse.join(passing, "doc", "left_semi")
        # ranks are those of what is left, as the list is ranked after the filter
        sparse = sparse.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy("rank")) - 1)
    return fusion.rrf(dense.filter(F.col("rank") < fetch), sparse.withColumnRenamed("doc", "id"), k, keys=(qid,))


#: A dense search: questions (qid, query) and a filter of the stored rows to a ranking (qid, id, rank from 0).
Dense = Callable[[DataFrame, Column], DataFrame]


def point_vectors(records: DataFrame, make: Callable = hash_embedder) -> DataFrame:
    """What a dense index of records stores: id (chapter x 1000 + verse), vector of the passage text, and the payload."""
    rows = records.withColumnRenamed("id", "passage_id").withColumn("id", point_id("surah_number", "ayah_number"))
    return embed(rows, passage_text("text_ar_clean", "translation_fr", "translation_en"), make).select("id", "vector", *(c for c in PAYLOAD if c in records.columns and c != "id"))


def dense_over(find: Callable[[DataFrame, Column], DataFrame], make: Callable = hash_embedder) -> Dense:
    """A dense search that embeds questions for find, which ranks point ids: (qid, vector) and a filter to (qid, id, rank)."""

    def search(asked: DataFrame, where: Column) -> DataFrame:
        hits = find(embed(asked.select("qid", "query"), query_text("query"), make).select("qid", "vector"), where)
        return hits.select("qid", passage_id(F.expr("id div 1000"), F.col("id") % 1000).alias("id"), "rank")

    return search


def _dense_by(dense: Dense, asked: DataFrame, filters: dict | None, keys: tuple[str, ...], own: str | None, most: int = 64) -> DataFrame:
    """The dense rankings of all questions, filtered before their limit: a search for each value of own that questions name."""
    if own is None or (filters or {}).get(own) is not None:
        return dense(asked, equality_filter(filters, keys))
    values = [r[0] for r in asked.select(own).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"questions name more than {most} values of {own}")
    parts = [dense(asked.filter(F.col(own).eqNullSafe(F.lit(v))), equality_filter({**(filters or {}), own: v}, (*keys, own))) for v in values]
    return reduce(DataFrame.unionByName, parts) if parts else dense(asked, F.lit(True))


def retrieve(
    queries: DataFrame,
    records: DataFrame,
    index: bm25.Bm25Index,
    dense: Dense,
    filters: dict | None = None,
    own: str | None = None,
    k: int = 5,
    scorer: Callable[[Column, Column], Column] | None = None,
    passage: Column | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda t: t,
) -> DataFrame:
    """(qid, rank from 0, score, rerank_score with a scorer, and the record's columns): the k best of each question.

    queries: (qid, query, and own if given). Dense hits are filtered before
    their limit, sparse ones after it, and what passes is fused. With a scorer
    FETCH hits are re-ranked by it, question against passage (the text, or the
    clean text where that is empty), and cut to k. Ids that the records haven't
    are dropped.
    """
    asked = keep(queries.select("qid", "query", *([own] if own else [])))
    keys = tuple(c for c in records.columns if c in (filters or {}))
    ranking = _dense_by(dense, asked, filters, keys, own)
    columns = {c: records[c] for c in {*keys, *([own] if own else [])}}
    attributes = records.select("id", *columns.values()) if columns else None
    hits = hybrid(ranking, index, asked, F.col("query"), attributes, filters, FETCH if scorer else k, own=own)
    rows = hits.select("qid", "id", F.col("score").alias("score")).join(records, "id")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    rows = rows.withColumn("rank", F.row_number().over(order) - 1)
    if scorer is not None:
        text = first_filled(*(c for c in ("text_ar", "text_ar_clean") if c in records.columns)) if passage is None else passage
        pool = rows.withColumn("__passage", text).join(asked.select("qid", "query"), "qid")
        pool = rerank.rerank(pool, scorer(F.col("query"), F.col("__passage")), k, pos="rank")
        rows = pool.withColumn("rank", F.col("rerank_rank")).drop("__passage", "query", "rerank_rank")
    return rows.filter(F.col("rank") < k)


def retrieve_with_context(hits: DataFrame, records: DataFrame, chapter: str = "surah_number", verse: str = "ayah_number", window: int = 1) -> DataFrame:
    """(qid, ord, and the record's columns): the hits of each question and their neighbours, each once, ord in canonical order from 0.

    hits: (qid, id, ...) as retrieve() gives them. A neighbour is at most window places away in the hit's chapter.
    """
    found = hits.select("qid", "id").join(records.select("id", chapter, verse), "id")
    rows = records.join(around(records, found, chapter, verse, window, ("qid",)), [chapter, verse])
    order = Window.partitionBy("qid").orderBy(chapter, verse)
    return rows.select("qid", (F.row_number().over(order) - 1).alias("ord"), *records.columns)


def hit_rows(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits (qid, id, score) with what a list of them shows of their record, the score to six digits; an id that the records haven't keeps its row, with nulls."""
    shown = [c for c in HIT if c in records.columns]
    rows = hits.select("qid", "id", F.round("score", 6).alias("score")).join(records.select(*shown), "id", "left")
    return rows.select("qid", "id", "score", *(c for c in shown if c != "id"))


def api_rows(hits: DataFrame, vocalized: DataFrame) -> DataFrame:
    """Hits as an interface shows them: text_ar_tashkil from vocalized ('' where it has none) and relevance_score, the re-ranker's score where there is one.

    hits: records with score and, if they were re-ranked, rerank_score.
    """
    said = vocalized.select("surah_number", "ayah_number", F.col("text").alias("__t"))
    score = F.coalesce("rerank_score", "score") if "rerank_score" in hits.columns else F.col("score")
    rows = hits.join(said, ["surah_number", "ayah_number"], "left")
    cols = [c for c in PAYLOAD if c in hits.columns]
    return rows.select(*(c for c in hits.columns if c not in (*cols, "score", "rerank_score")), *cols, F.coalesce("__t", F.lit("")).alias("text_ar_tashkil"), score.alias("relevance_score"))


def detail(records: DataFrame, chapter: str, verse: str, id_col: str, number: tuple[int, int], window: int = 1) -> DataFrame:
    """One verse with its context and its neighbours' ids; no row if there is none."""
    own = records.filter(F.col(chapter) == number[0])
    rows = with_context(previous_next(own, chapter, verse, id_col), chapter, verse, [id_col, verse], window)
    return rows.filter(F.col(verse) == number[1])


def similar(
    queries: DataFrame,
    roots: DataFrame,
    posts: DataFrame,
    index: bm25.Bm25Index,
    docs: DataFrame,
    n: Column,
    scorer: Callable[[Column, Column], Column] | None = rerank.jaccard,
    attributes: DataFrame | None = None,
    filters: dict | None = None,
    limit: int = 10,
    floor: float = 0.25,
    min_score: float = rerank.MIN_SCORE,
    qid: str = "qid",
    keep: Callable[[DataFrame], DataFrame] = lambda t: t,
) -> DataFrame:
    """Similar passages: root candidates and BM25 hits, pooled, re-ranked, weighed by coverage, gated, cut.

    keep is applied to the small tables that later steps read more than once.

    queries: (qid, text, terms): terms is the text BM25 gets. roots: (qid, root,
    ord). posts: (root, doc). docs: (doc, passage). Without a scorer the pool is
    cut as it stands: root candidates with their coverage score, BM25 hits with 0.
    """
    checked(limit)
    weights = keep(coverage.root_weights(roots, posts, n, qid))
    by_root = coverage.candidates(weights, posts, qid)
    by_term = bm25.search(index, queries, F.col("terms"), BM25_POOL, qid).withColumn("score", F.lit(0.0))
    if attributes is not None and filters:
        passing = attributes.filter(equality_filter(filters, tuple(attributes.columns))).select(F.col("id").alias("doc"))
        by_root, by_term = (x.join(passing, "doc", "left_semi") for x in (by_root, by_term))
    first = F.row_number().over(Window.partitionBy(qid).orderBy("rank"))
    by_root = by_root.withColumn("__rn", first).filter(F.col("__rn") <= ROOT_POOL).drop("__rn")
    cols = [qid, "doc", "score", "rank"]
    pool = fusion.keep_first_union(by_root.select(*cols), by_term.select(*cols), keys=(qid,), id_col="doc", most=POOL_MAX)
    if scorer is None:
        return pool.filter(F.col("pos") < limit).select(qid, "doc", "score", F.col("pos").alias("rank"))
    # written first and joined to passages first, so that Spark sees how small it is and sends it to them, which stay where they are
    pool = keep(pool).join(docs, "doc").join(queries.select(qid, "text"), qid)
    ranked = keep(rerank.rerank(pool, scorer(F.col("text"), F.col("passage")), qid=qid).drop("text", "passage"))
    ranked = coverage.fractions(ranked, weights, posts, qid)
    ranked = rerank.full_coverage_gate(rerank.blended(ranked, floor, qid), qid=qid)
    return rerank.threshold(ranked, min_score, limit=limit, qid=qid).select(qid, "doc", F.col("rerank_score").alias("score"), "cov", "rank")


def process_queries(queries: DataFrame, roots: DataFrame | None = None, segments: DataFrame | None = None, text: str = "text", qid: str = "qid", forms: int = 8, language: Column | None = None) -> DataFrame:
    """(qid, original, normalized, language, period, expanded_terms).

    roots: (qid, root, ord) and segments: (root, form, ...) give the first
    root's first forms in code-point order, normalised, each once; only
    questions in Arabic script are expanded. language: the code of questions
    that aren't in Arabic script, from a detector (operators.langdetect has
    one); the count of common words if not given.
    """
    original = trimmed(text)
    said = detect_language(original) if language is None else F.when(is_arabic(original), "ar").otherwise(F.coalesce(language, F.lit("unknown")))
    out = queries.select(qid, original.alias("original"), F.when(is_arabic(original), normalize_clean(original)).otherwise(original).alias("normalized"), said.alias("language"), detect_period(original).alias("period"))
    none = F.array().cast("array<string>")
    if roots is None or segments is None:
        return out.withColumn("expanded_terms", none)
    wanted = out.filter(is_arabic("original")).select(qid)
    first = roots.join(wanted, qid, "left_semi").groupBy(qid).agg(F.min_by("root", "ord").alias("root"))
    # a root's first forms alone are gathered, whatever the number of its forms
    named = segments.join(first.select("root").distinct(), "root", "left_semi").select("root", "form").distinct()
    named = named.withColumn("__r", F.row_number().over(Window.partitionBy("root").orderBy("form"))).filter(F.col("__r") <= forms)
    named = named.groupBy("root").agg(F.array_sort(F.collect_list("form")).alias("forms_found"))
    first = first.join(named, "root")
    terms = F.filter(F.array_distinct(F.transform(F.slice("forms_found", 1, forms), lambda f: normalize_clean(f))), lambda f: f != "")
    out = out.join(first.select(qid, terms.alias("expanded_terms")), qid, "left")
    return out.withColumn("expanded_terms", F.when(is_arabic("original"), F.coalesce("expanded_terms", none)).otherwise(none))


def merged_filters(own: Column, detected: Column) -> Column:
    """A caller's filter before one that the text names."""
    return F.coalesce(own, detected)


def retrieval_query(question: Column, terms: Column, hypothesis: Column | None = None, most: int = 6) -> Column:
    """The question, up to `most` expansion terms and, if there is one, a hypothetical passage."""
    parts = [question, F.array_join(F.slice(terms, 1, most), " "), *([hypothesis] if hypothesis is not None else [])]
    return collapsed(F.concat_ws(" ", *parts))


def resolve_queries(queries: DataFrame, segments: DataFrame, text: str = "text", qid: str = "qid") -> DataFrame:
    """(qid, root, ord) of queries' content words over segments."""
    return inverted.content_roots(queries, segments.select("root").distinct(), inverted.resolution_map(segments, "form"), inverted.resolution_map(segments, "lemma"), text, qid)
