"""Sources as DataFrames. Schemas are given, never inferred; bad rows fail with their place."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.text import WHITE_SPACE, passage_id, trimmed


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _int(c: str) -> Column:
    v = F.trim(F.col(c)).try_cast("int")
    return F.when(v.isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit(f"{c} is no integer: "), F.coalesce(F.col(c), F.lit("null")), F.lit(" in "), F.col("__file"), F.lit(" line "), F.col("__line").cast("string"))).cast("int"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): the lines of text files with their numbers, from 1, however the files are split.

    A split's lines stand together in a partition, so a line's number is its distance from the split's first plus the
    lines of the file's earlier splits. Those are one row a split; lines aren't shuffled.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__id"))
    splits = lines.groupBy("file", "__at").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).select("file", "__at", "__first", "__base")
    few = splits.limit(10_001).collect()  # a row a split
    if len(few) <= 10_000:  # sent to the lines, which then stay in order
        splits = F.broadcast(spark.createDataFrame(few, splits.schema))
    rows = lines.join(splits, ["file", "__at"])
    return rows.select("value", "file", (F.col("__base") + F.col("__id") - F.col("__first") + 1).alias("line"))


def read_raw_csv(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """num_soura, num_aya (int), aya, name_soura (stripped). A byte order mark is passed over.

    A missing column raises ValueError naming it; a number that is none fails
    the job with the value, its file and line. A record is one line; files have
    one header each, alike. place: a column of that name tells where a row
    stood: its file and line.
    """
    head = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=False, escape='"').columns
    names = [c.lstrip("\ufeff").strip() for c in head]
    missing = [c for c in schema.RAW_CSV.fieldNames() if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kind = ", ".join(f"`{c}` string" for c in names)
    lines = numbered_lines(spark, path).filter((F.col("line") > 1) & (F.trim("value") != ""))
    df = lines.select(F.from_csv("value", kind, {"escape": '"'}).alias("r"), F.col("file").alias("__file"), F.col("line").alias("__line")).select("r.*", "__file", "__line")
    at = [F.struct(F.col("__file").alias("file"), F.col("__line").alias("line")).alias(place)] if place else []
    return df.select(*at, _int("num_soura").alias("num_soura"), _int("num_aya").alias("num_aya"), *(trimmed(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("aya", "name_soura")))


def canonical_records(raw: DataFrame) -> DataFrame:
    """The fifteen fields of a record, empty where the raw row has nothing to say."""
    s, a = F.col("num_soura"), F.col("num_aya")
    have = {"id": passage_id(s, a), "surah_number": s, "surah_name_ar": F.col("name_soura"), "ayah_number": a, "text_ar": F.col("aya"), "juz": F.lit(0)}
    empty = lambda t: F.array().cast(t) if isinstance(t, T.ArrayType) else F.lit("")
    return raw.select(*(have.get(f.name, empty(f.dataType)).cast(f.dataType).alias(f.name) for f in schema.PASSAGE.fields))


def keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return df.withColumn("__rn", rn).filter("__rn = 1").drop("__rn")


def read_vocalized(spark: SparkSession, path: str) -> DataFrame:
    """(surah_number, ayah_number, text, surah_name); of repeated keys the last line of the last file (by name) counts."""
    raw = read_raw_csv(spark, path, "__at")
    out = keep_last(raw, ["num_soura", "num_aya"], F.col("__at"))
    return out.select(F.col("num_soura").alias("surah_number"), F.col("num_aya").alias("ayah_number"), F.col("aya").alias("text"), F.col("name_soura").alias("surah_name"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Processed records, Parquet or JSON (an array or a line each)."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        return spark.read.schema(schema.PASSAGE).json(path, multiLine=path.endswith(".json"))
    return spark.read.schema(schema.PASSAGE).parquet(path)


def read_translations(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(lang, id, text) from one JSON object {id: text} per language; a missing file adds no rows.

    Files are read by lines, so an indented one of any size is many tasks' work: an entry stands in one line, and a
    line may hold any number of them (a compact file is one line). A line that is no part of such an object fails the job.
    """
    out = spark.createDataFrame([], "lang string, id string, text string")
    for lang, path in paths.items():
        if _exists(spark, path):
            inner = F.regexp_replace(F.regexp_replace(F.trim("value"), r"^\ufeff?\s*\{", ""), r"[\s,]*\}?\s*$", "")
            lines = spark.read.text(path).select(inner.alias("value")).filter(F.trim("value") != "")
            entries = lines.select(F.from_json(F.concat(F.lit("{"), "value", F.lit("}")), "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
            out = out.unionByName(entries.select(F.lit(lang).alias("lang"), F.explode("m").alias("id", "text")))
    return out


def read_edition(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) from a stored answer of the editions API: data.surahs[].ayahs[]."""
    kind = "data struct<surahs:array<struct<number:int,ayahs:array<struct<numberInSurah:int,text:string>>>>>"
    chapters = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("data.surahs").alias("s"))
    rows = chapters.select("s.number", F.explode("s.ayahs").alias("a"))
    return rows.select(passage_id("number", "a.numberInSurah").alias("id"), trimmed("a.text").alias("text"))


def parse_morphology(lines: DataFrame, col: str = "value") -> DataFrame:
    """Segments (verse_id, form, root, lemma) of tab-separated lines.

    Lines that are blank, have under four fields, no numeric place or no root
    are passed over; ROOT: and LEM: count anywhere among the features, the last
    of several. Fields are taken apart a batch of lines at a time.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            fields = pc.split_pattern(pc.drop_null(batch.column(0)), "\t")
            fields = fields.filter(pc.greater_equal(pc.list_value_length(fields), 4))
            place, form, features = (pc.list_element(fields, k) for k in (0, 1, 3))
            place = pc.split_pattern(pc.replace_substring(pc.replace_substring(place, "(", ""), ")", ""), ":", max_splits=2)
            root, lemma = (pc.struct_field(pc.extract_regex(features, rf"(?s)^(?:.*\|)?{key}:(?P<v>[^|]*)"), "v") for key in ("ROOT", "LEM"))
            fine = pc.and_(pc.greater_equal(pc.list_value_length(place), 2), pc.fill_null(pc.not_equal(root, ""), False))
            place = place.filter(fine)
            said = [pc.utf8_trim(c.filter(fine), WHITE_SPACE) for c in (form, root, pc.coalesce(lemma, ""))]
            yield pa.RecordBatch.from_arrays([pc.list_element(place, 0), pc.list_element(place, 1), *said], ["s", "a", "form", "root", "lemma"])

    rows = lines.select(col).mapInArrow(run, "s string, a string, form string, root string, lemma string")
    rows = rows.select(F.col("s").try_cast("int").alias("s"), F.col("a").try_cast("int").alias("a"), "form", "root", "lemma").filter("s is not null and a is not null")
    return rows.select(passage_id("s", "a").alias("verse_id"), "form", "root", "lemma")


def read_morphology(spark: SparkSession, path: str) -> DataFrame:
    return parse_morphology(spark.read.text(path))


def read_table(spark: SparkSession, path: str, columns: T.StructType | None = None) -> DataFrame:
    """An index table; FileNotFoundError where it was never built."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"no index at {path}; build it first")
    return (spark.read.schema(columns) if columns else spark.read).parquet(path)
