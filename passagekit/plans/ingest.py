"""The ingestion pipeline: parse, normalise, enrich, translate, attach roots; and its checks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import nfc, normalize_clean, part_of, period_of
from ..operators.inverted import attach_roots, passage_roots, resolution_map, root_index
from ..sinks.writers import write_stage


def clean(records: DataFrame, profile: str = "delete") -> DataFrame:
    """text_ar composed and text_ar_clean filled."""
    rows = records.withColumn("text_ar", nfc("text_ar"))
    return rows.withColumn("text_ar_clean", normalize_clean("text_ar", profile))


def enrich(records: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """period, part and, from names (surah_number, name_en, name_fr), the chapter's names; '' where unknown."""
    rows = records.withColumns({"period": period_of("surah_number"), "juz": part_of("surah_number", "ayah_number")})
    if names is None:
        return rows
    dims = names.select("surah_number", F.col("name_en").alias("__en"), F.col("name_fr").alias("__fr"))
    rows = rows.join(dims, "surah_number", "left")
    filled = {"surah_name_en": F.coalesce("__en", F.lit("")), "surah_name_fr": F.coalesce("__fr", F.lit(""))}
    return rows.withColumns(filled).drop("__en", "__fr").select(*records.columns)


def translate(records: DataFrame, translations: DataFrame, languages: tuple[str, ...] = ("fr", "en")) -> DataFrame:
    """translation_<lang> from (lang, id, text); an empty or absent text leaves the field as it was."""
    rows = records
    wide = translations.filter("text <> ''").groupBy("id").agg(*(F.max(F.when(F.col("lang") == x, F.col("text"))).alias(f"__{x}") for x in languages))
    rows = rows.join(wide, "id", "left")
    filled = {f"translation_{x}": F.coalesce(f"__{x}", f"translation_{x}") for x in languages}
    return rows.withColumns(filled).select(*records.columns)


def coverage(records: DataFrame, languages: tuple[str, ...] = ("fr", "en")) -> DataFrame:
    """One row: verses with a translation, by language."""
    return records.agg(*(F.count_if(F.col(f"translation_{x}") != "").alias(x) for x in languages))


def quality(records: DataFrame) -> DataFrame:
    """One row of counters: rows, chapters, and what is empty."""
    return records.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("surah_number").alias("chapters"),
        F.count_if(F.coalesce("text_ar_clean", F.lit("")) == "").alias("empty_clean"),
        F.count_if(F.coalesce("period", F.lit("")) == "").alias("no_period"),
        F.count_if(F.coalesce("surah_name_en", F.lit("")) == "").alias("no_name"),
        F.count_if(F.size("roots") < 1).alias("no_roots"),
    )


def run(raw: DataFrame, segments: DataFrame, translations: DataFrame, names: DataFrame | None = None, out: str | None = None, expected: int | None = None, report: list[dict] | None = None) -> dict[str, DataFrame]:
    """All stages; the tables records, root_index, forms, lemmas. out: where they are written, each overwritten whole.

    report: a list that gets, for each table as it is written, {stage, rows, seconds}; the rows are counted by
    the write itself.

    expected: a number of records that must be met, else ValueError.
    """
    from ..sources.readers import canonical_records

    records = translate(enrich(clean(canonical_records(raw)), names), translations)
    records = attach_roots(records, passage_roots(segments))
    if expected is not None and (n := records.count()) != expected:
        raise ValueError(f"{n} records where {expected} were expected")
    tables = {"records": records, "root_index": root_index(segments), "forms": resolution_map(segments, "form"), "lemmas": resolution_map(segments, "lemma")}
    if out:
        for name, table in tables.items():
            seen, began = Observation(name), time.monotonic()
            write_stage(table.observe(seen, F.count(F.lit(1)).alias("rows")), f"{out}/{name}")
            if report is not None:
                report.append({"stage": name, "rows": seen.get["rows"], "seconds": time.monotonic() - began})
        tables = {k: records.sparkSession.read.parquet(f"{out}/{k}") for k in tables}
    return tables
