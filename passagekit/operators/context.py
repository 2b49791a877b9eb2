"""Neighbours, previous and next, chapter lists and details: windows within a chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import numbered


def places(df: DataFrame, chapter: str, verse: str) -> DataFrame:
    """(chapter, verse, pos): each verse's place within its chapter, from 0. Keys alone are sorted, and a chapter may span tasks; rows of one verse share its place."""
    return numbered(df.select(chapter, verse).distinct(), chapter, [verse]).select(chapter, verse, "pos")


def around(df: DataFrame, hits: DataFrame, chapter: str, verse: str, window: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., chapter, verse), once each: the verses within `window` places of a hit (keys..., chapter, verse) in the same chapter.

    The band is a set of exact places, so the joins stay equi-joins.
    """
    at = places(df, chapter, verse)
    near = at.join(hits.select(*keys, chapter, verse).distinct(), [chapter, verse])
    near = near.select(*keys, chapter, F.explode(F.sequence(F.col("pos") - window, F.col("pos") + window)).alias("pos")).distinct()
    return near.join(at, [chapter, "pos"]).select(*keys, chapter, verse)


def neighbours(df: DataFrame, hits: DataFrame, chapter: str, verse: str, window: int = 1) -> DataFrame:
    """Rows of df within `window` places of a hit (chapter, verse) in the same chapter, each once, in canonical order."""
    return df.join(around(df, hits, chapter, verse, window), [chapter, verse], "left_semi").orderBy(chapter, verse)


def with_context(df: DataFrame, chapter: str, verse: str, cols: list[str], window: int = 1) -> DataFrame:
    """df with context: the rows within `window` places, in order, as an array of structs."""
    frame = Window.partitionBy(chapter).orderBy(verse).rowsBetween(-window, window)
    return df.withColumn("context", F.collect_list(F.struct(*cols)).over(frame))


def previous_next(df: DataFrame, chapter: str, verse: str, id_col: str) -> DataFrame:
    """df with prev_id and next_id within the chapter, null at its ends."""
    w = Window.partitionBy(chapter).orderBy(verse)
    return df.withColumns({"prev_id": F.lag(id_col).over(w), "next_id": F.lead(id_col).over(w)})


def chapters(df: DataFrame, chapter: str, verse: str, names: list[str]) -> DataFrame:
    """One row a chapter: names as its first verse has them, and the number of verses."""
    return df.groupBy(chapter).agg(*(F.min_by(n, verse).alias(n) for n in names), F.count(F.lit(1)).alias("verse_count")).orderBy(chapter)


def chapter(df: DataFrame, chapter_col: str, verse: str, number: int) -> DataFrame:
    """The verses of one chapter in order, with their number."""
    rows = df.filter(F.col(chapter_col) == number)
    return rows.withColumn("verse_count", F.count(F.lit(1)).over(Window.partitionBy(chapter_col))).orderBy(verse)
