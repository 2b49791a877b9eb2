"""Inverted index of roots, resolution maps, and the resolution ladder."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clitic_candidates, in_steps, normalize_root, normalize_search, parsed_id, tokens, with_value, without_stop_words


def root_index(segments: DataFrame) -> DataFrame:
    """(root, forms_found, verses, count): distinct forms in code-point order, distinct verses in canonical order.

    segments: (verse_id, form, root, ...) with roots in key form. Copies are
    dropped within tasks and lists shuffled once, by root; a posting list is as long
    as the root's verses, which is what the index is.
    """
    rows = _gathered(segments.filter(F.col("root").isNotNull()).select("root", "form", "verse_id")).groupBy("root").agg(F.collect_list("forms").alias("f"), F.collect_list("verses").alias("v"))
    # parsed once a posting, next to their lists, which are sorted as values and not by a comparator
    place = lambda x: with_value(F.split(x, ":"), lambda p: F.struct(*(c.alias(n) for c, n in zip(parsed_id(p), "sa", strict=True)), x.alias("verse_id")))
    rows = rows.select("root", F.sort_array(F.array_distinct(F.flatten("f"))).alias("forms_found"), F.sort_array(F.transform(F.array_distinct(F.flatten("v")), place)).alias("v"))
    return rows.select("root", "forms_found", F.col("v.verse_id").alias("verses"), F.size("v").cast("long").alias("count"))


def _gathered(rows: DataFrame, most: int = 1 << 19) -> DataFrame:
    """(root, forms, verses) of (root, form, verse_id): different forms and verses of a root within `most` rows of a task; null forms are left out."""
    kind = rows.schema["verse_id"].dataType.simpleString()

    def lists(root, value, n_roots: int):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        coded = value.dictionary_encode("encode")
        pair = np.unique(root.astype(np.int64) * len(coded.dictionary) + np.asarray(coded.indices))
        at, code = np.divmod(pair, max(1, len(coded.dictionary)))
        ends = np.searchsorted(at, np.arange(n_roots + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(code)))

    def combined(batches: list):  # noqa: ANN202
        import numpy as np
        import pyarrow as pa

        root, form, verse = (pa.chunked_array([b.column(k) for b in batches]).combine_chunks() for k in range(3))
        roots = root.dictionary_encode()
        code, n, there = np.asarray(roots.indices), len(roots.dictionary), form.is_valid()
        return pa.RecordBatch.from_arrays([roots.dictionary, lists(code[np.asarray(there)], form.filter(there), n), lists(code, verse, n)], ["root", "forms", "verses"])

    def run(batches: Iterator) -> Iterator:
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield combined(held)
                held = []
        if sum(b.num_rows for b in held):
            yield combined(held)

    return rows.mapInArrow(run, f"root string, forms array<string>, verses array<{kind}>")


def postings(segments: DataFrame) -> DataFrame:
    """(root, verse_id) once each: the long form, which joins without gathering."""
    return segments.select("root", "verse_id").distinct()


def _key(c: Column, normalizer) -> Column:  # noqa: ANN001
    """normalizer(c); normalize_root changes nothing but Arabic script and white space, so words without any stay as they are."""
    return F.when(~F.rlike(c, F.lit(r"(?U)[\u0600-\u06ff\s]")), c).otherwise(normalizer(c)) if normalizer is normalize_root else normalizer(c)


def resolution_map(segments: DataFrame, key: str, normalizer=normalize_root, wanted: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """(key, roots): sorted distinct roots of each non-empty normalised form or lemma.

    A form is normalised once for each of its roots, not once a segment. wanted: (key), a small table of keys that
    are looked up; other keys are left out as segments are read, so that nothing of their size is shuffled.
    """
    if wanted is None:
        pairs = segments.select(F.col(key).alias("form"), "root").distinct().select(_key(F.col("form"), normalizer).alias("key"), "root")
    else:
        pairs = segments.select(_key(F.col(key), normalizer).alias("key"), "root").join(wanted, "key", "left_semi")
    pairs = pairs.filter("key <> ''").distinct()
    return pairs.groupBy("key").agg(F.array_sort(F.collect_list("root")).alias("roots"))


def passage_roots(segments: DataFrame) -> DataFrame:
    """(verse_id, roots): sorted distinct roots."""
    return segments.groupBy("verse_id").agg(F.sort_array(F.collect_set("root")).alias("roots"))


def attach_roots(records: DataFrame, roots: DataFrame, id_col: str = "id") -> DataFrame:
    """records with their roots, an empty array where there are none."""
    out = records.drop("roots").join(roots.withColumnRenamed("verse_id", id_col), id_col, "left")
    return out.withColumn("roots", F.coalesce("roots", F.array().cast("array<string>")))


def documents_of_words(docs: DataFrame) -> DataFrame:
    """(form, docs) of docs (doc, words: an array without repeats): a row a word and batch of documents, so that nothing is shuffled and no row is a single posting."""
    kind = docs.schema["doc"].dataType.simpleString()

    def turn(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            row, coded = np.asarray(pc.list_parent_indices(batch.column(1))), batch.column(1).flatten().dictionary_encode()
            code = np.asarray(coded.indices)
            ends = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))].astype(np.int32)
            own = batch.column(0).take(pa.array(row[np.argsort(code, kind="stable")]))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.ListArray.from_arrays(pa.array(ends), own)], ["form", "docs"])

    return docs.select("doc", "words").mapInArrow(turn, f"form string, docs array<{kind}>")


def stem_index(docs: DataFrame, id_col: str, words, stem, least: int = 2, shown=lambda root: root) -> DataFrame:  # noqa: ANN001
    """(root, forms_found, docs, count) of stems of every word; stems under `least` letters are passed over.

    stem: a function of a column, or several for a projection each; a word is stemmed once a batch of documents, and
    lists of documents are shuffled once, by root. shown is applied to each root once, at the end, and must keep
    different roots apart.
    """
    rows = documents_of_words(docs.select(F.col(id_col).alias("doc"), F.array_compact(F.array_distinct(words)).alias("words")))
    rows = in_steps(rows, "form", "root", stem if isinstance(stem, tuple) else (stem,))
    rows = rows.filter(F.length(F.replace(F.col("root"), F.lit("-"), F.lit(""))) >= least)
    roots = rows.groupBy("root").agg(F.collect_set("form").alias("forms"), F.collect_list("docs").alias("docs"))
    roots = roots.select("root", F.sort_array("forms").alias("forms_found"), F.array_distinct(F.flatten("docs")).alias("docs"))
    return roots.select(shown(F.col("root")).alias("root"), F.sort_array(F.array_compact("docs")).alias("docs"), F.size("docs").cast("long").alias("count"), "forms_found")


def resolve(words: DataFrame, keys: DataFrame, forms: DataFrame, lemmas: DataFrame, word: str = "word", stem=None) -> DataFrame:  # noqa: ANN001
    """words with roots: the word as a root key, then its form's roots, then its lemma's; only roots of the index.

    keys: (root); forms, lemmas: (key, roots). stem, if given, is tried for words that none of these know.
    """
    w = words.withColumn("__w", normalize_root(F.col(word)))
    known = keys.select(F.col("root").alias("__w"), F.col("root").alias("__own")).distinct()
    w = w.join(known, "__w", "left")
    w = w.join(forms.select(F.col("key").alias("__w"), F.col("roots").alias("__f")), "__w", "left")
    w = w.join(lemmas.select(F.col("key").alias("__w"), F.col("roots").alias("__l")), "__w", "left")
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(F.when(F.col("__own").isNotNull(), F.array("__own")).otherwise(none), F.coalesce("__f", none), F.coalesce("__l", none)))
    w = w.withColumn("roots", F.when(F.col("__w") == "", none).otherwise(found))
    if stem is not None:
        stemmed = normalize_root(F.replace(stem(F.col("__w")), F.lit("-"), F.lit("")))
        w = w.withColumn("__s", F.when(F.size("roots") == 0, stemmed)).join(known.select(F.col("__w").alias("__s"), F.col("__own").alias("__sr")), "__s", "left")
        w = w.withColumn("roots", F.when((F.size("roots") == 0) & F.col("__sr").isNotNull(), F.array("__sr")).otherwise(F.col("roots"))).drop("__s", "__sr")
    return w.drop("__w", "__own", "__f", "__l")


def word_tries(queries: DataFrame, text: str = "text", qid: str = "qid", stop=None, prefixes=None, suffixes=None) -> DataFrame:  # noqa: ANN001
    """(qid, pos, rank, stem): what is looked up of each query's content words, in the order of the tries."""
    words = without_stop_words(tokens(F.col(text), normalize_search), stop)
    rows = queries.select(qid, F.posexplode(words).alias("pos", "token"))
    extra = {k: v for k, v in (("prefixes", prefixes), ("suffixes", suffixes)) if v is not None}
    return rows.select(qid, "pos", F.explode(clitic_candidates(F.col("token"), **extra)).alias("t")).select(qid, "pos", "t.rank", "t.stem")


def content_roots(queries: DataFrame, keys: DataFrame, forms: DataFrame, lemmas: DataFrame, text: str = "text", qid: str = "qid", stop=None, prefixes=None, suffixes=None) -> DataFrame:  # noqa: ANN001
    """(qid, root, ord): roots of each query's content words, in order of first mention.

    A word that isn't known is tried again without each suffix, then each
    prefix, and the first stem that is known counts.
    """
    tries = word_tries(queries, text, qid, stop, prefixes, suffixes)
    hits = resolve(tries, keys, forms, lemmas, "stem").filter(F.size("roots") > 0)
    best = hits.groupBy(qid, "pos").agg(F.min_by("roots", "rank").alias("roots"))
    each = best.select(qid, "pos", F.posexplode("roots").alias("k", "root"))
    first = each.groupBy(qid, "root").agg(F.min(F.struct("pos", "k")).alias("at"))
    return first.select(qid, "root", (F.row_number().over(Window.partitionBy(qid).orderBy("at")) - 1).alias("ord"))
