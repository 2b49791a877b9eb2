"""Lookup of a word's root: a structured result and the exhaustive list with match positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import even_sample, parse_id
from .patterns import match_positions
from .sampling import even_rows, numbered


def lookup(roots: DataFrame, index: DataFrame, records: DataFrame, sample: int = 30, qid: str = "qid", id_col: str = "id") -> DataFrame:
    """(qid, root, forms, occurrences_count, verse_ids, verses): the first root of each query and an even sample of its verses.

    roots: (qid, root, ord). Queries whose root isn't known keep their row with nothing found; a query without
    any root has no row in roots and none here (word_lookup gives it one).
    """
    first = roots.groupBy(qid).agg(F.min_by("root", "ord").alias("root"))
    none = F.array().cast("array<string>")
    hit = first.join(index, "root", "left").select(qid, "root", F.coalesce("forms_found", none).alias("forms"), F.coalesce("count", F.lit(0)).alias("occurrences_count"), F.coalesce("verses", none).alias("verse_ids"))
    picked = hit.select(qid, F.posexplode(even_sample(F.col("verse_ids"), sample)).alias("k", id_col))
    found = picked.join(records, id_col).groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("k", F.struct(*records.columns).alias("v")))).alias("x"))
    out = hit.join(found.select(qid, F.transform("x", lambda x: x["v"]).alias("verses")), qid, "left")
    return out


def lookup_long(roots: DataFrame, segments: DataFrame, records: DataFrame, sample: int = 30, qid: str = "qid", id_col: str = "id") -> DataFrame:
    """(qid, root, forms, occurrences_count, verses) as lookup() has them, from segments (verse_id, form, root).

    Only places of the roots asked for are read, and of each only the sampled ones are gathered, so a root may
    have any number of places.
    """
    first = roots.groupBy(qid).agg(F.min_by("root", "ord").alias("root"))
    own = segments.join(first.select("root").distinct(), "root", "left_semi")
    s, a = parse_id("verse_id")
    places = own.select("root", "verse_id", s.alias("s"), a.alias("a")).distinct()
    picked = even_rows(places, "root", ["s", "a", "verse_id"], sample)
    forms = own.select("root", "form").distinct().groupBy("root").agg(F.array_sort(F.collect_list("form")).alias("forms"))
    counts = picked.groupBy("root").agg(F.max("n").alias("occurrences_count"))
    found = picked.select("root", "pos", F.col("verse_id").alias(id_col)).join(records, id_col)
    found = found.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*records.columns).alias("v")))).alias("x"))
    rows = first.join(forms, "root", "left").join(counts, "root", "left").join(found, "root", "left")
    none = F.array().cast("array<string>")
    return rows.select(qid, "root", F.coalesce("forms", none).alias("forms"), F.coalesce("occurrences_count", F.lit(0)).alias("occurrences_count"), F.transform("x", lambda x: x["v"]).alias("verses"))


def exhaustive(roots: DataFrame, segments: DataFrame, vocalized: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, surah_number, ayah_number, surah_name, text, match_indices): all verses of all of a query's roots, in canonical order.

    segments: (root, verse_id, form). Forms of all roots together mark the
    words, by one automaton a query. Verses without a vocalised text are left
    out. A root's verses stay rows, however many there are.
    """
    own = segments.join(roots.select("root").distinct(), "root", "left_semi")
    forms = roots.join(own.select("root", "form").distinct(), "root").groupBy(qid).agg(F.array_sort(F.collect_set("form")).alias("forms"))
    s, a = parse_id("verse_id")
    places = own.select("root", s.alias("surah_number"), a.alias("ayah_number")).distinct()
    places = roots.select(qid, "root").join(places, "root").select(qid, "surah_number", "ayah_number").distinct()
    rows = places.join(vocalized, ["surah_number", "ayah_number"])
    rows = match_positions(rows.select(qid, "surah_number", "ayah_number", "surah_name", "text"), "text", forms, [qid])
    return rows.orderBy(qid, "surah_number", "ayah_number")


def totals(roots: DataFrame, segments: DataFrame, vocalized: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, total): how many verses exhaustive() lists, without their texts."""
    s, a = parse_id("verse_id")
    keys = ["surah_number", "ayah_number"]
    places = segments.join(roots.select("root").distinct(), "root", "left_semi").select("root", s.alias(keys[0]), a.alias(keys[1])).distinct()
    places = places.join(vocalized.select(*keys), keys)
    return roots.select(qid, "root").join(places, "root").groupBy(qid, *keys).agg(F.count(F.lit(1))).groupBy(qid).agg(F.count(F.lit(1)).alias("total"))


def word_lookup(words: DataFrame, roots: DataFrame, counts: DataFrame, word: str = "word", qid: str = "qid") -> DataFrame:
    """One row per word, found or not: (qid, word, root, root_found, total): its roots joined by " / " in their order, and its verses.

    counts: the rows of totals().
    """
    named = roots.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("ord", "root"))).alias("r"))
    named = named.select(qid, F.array_join(F.transform("r", lambda x: x["root"]), " / ").alias("root"))
    rows = words.select(qid, word).join(named, qid, "left").join(counts, qid, "left")
    return rows.select(qid, word, F.coalesce("root", F.lit("")).alias("root"), F.col("root").isNotNull().alias("root_found"), F.coalesce("total", F.lit(0)).alias("total"))


def by_chapter(rows: DataFrame, chapter: str, verse: str, cols: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Found verses in their chapters' order, a row each: keys, chapter, n (the chapter's verses), pos (from 0), verse, cols.

    Verses are numbered and not gathered, so a chapter (with its keys) may have any number of them.
    """
    own = rows.select(*keys, chapter, verse, *cols).withColumn("__k", F.struct(*keys, chapter))
    return numbered(own, "__k", [verse]).select(*keys, chapter, "n", "pos", verse, *cols)
