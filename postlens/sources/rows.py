"""Posting rows from JSON files, typed ingest and OCR token tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from postlens.constants import OCR_MIN_CONFIDENCE
from postlens.functions.text import strip
from postlens.operators.scaling import unrolled
from postlens.schemas import BANDED_POSTING, POSTING
from postlens.sources.json_array import json_elements


def read_postings_json(spark: SparkSession, path: str, schema: T.StructType = BANDED_POSTING,
                       lines: bool = False) -> DataFrame:
    """Rows of JSON files holding one object or an array of objects, or one object per line (``lines``).

    All forms are read in splits. What is not JSON gives no row, and an array cut short
    gives its whole objects; a field of another type is null.
    """
    broken = "_broken_json"
    wider = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    if lines:
        rows = spark.read.schema(wider).option("columnNameOfCorruptRecord", broken).option("mode", "PERMISSIVE").json(path)
    else:
        parsed = F.from_json("element", wider, {"columnNameOfCorruptRecord": broken, "mode": "PERMISSIVE"})
        rows = json_elements(spark, path, numbered=False).select(parsed.alias("_r")).where(F.col("_r").isNotNull()).select("_r.*")
    nothing = reduce(lambda a, b: a & b, [F.col(f.name).isNull() for f in schema.fields])
    return rows.where(~(F.col(broken).isNotNull() & nothing)).drop(broken)


def read_postings_json_or_empty(spark: SparkSession, path: str, schema: T.StructType = BANDED_POSTING) -> DataFrame:
    """As above, with no rows where the path cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        return read_postings_json(spark, path, schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def explode_json_strings(df: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep, pos, text)`` from JSON arrays of strings; other JSON raises."""
    parsed = F.from_json(F.col(column), "array<string>")
    is_list = F.ltrim(F.col(column)).startswith("[")
    checked = F.when(is_list & parsed.isNotNull(), parsed).otherwise(
        F.raise_error(F.lit("expected a JSON list of posting texts")).cast("array<string>")
    )
    return unrolled(df, keep, checked, "pos", "text")


def read_json_strings(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Posting texts from JSON: ``(file, pos, text)`` of arrays, or one JSON string per line (``lines``).

    Both forms are read in splits; a file that holds no array raises.
    """
    if lines:
        raw = spark.read.text(path).where(F.trim("value") != "")
        one = F.concat(F.lit("["), F.col("value"), F.lit("]")).alias("value")
        return explode_json_strings(raw.select(one), "value").select("text")
    one = F.when(F.col("listed"), F.concat(F.lit("["), F.col("element"), F.lit("]")))
    parsed = F.from_json(one, "array<string>")
    text = F.when(F.size(parsed) == 1, F.struct(parsed[0].alias("text"))).otherwise(
        F.raise_error(F.lit("expected a JSON list of posting texts")).cast("struct<text: string>"))
    return json_elements(spark, path).select("file", "pos", text["text"].alias("text"))


def typed_postings(raw: DataFrame, schema: T.StructType = POSTING) -> DataFrame:
    """Fields cast to the declared types and ``is_valid``: every field present."""
    typed = raw.withColumns({f.name: F.col(f.name).try_cast(f.dataType) for f in schema.fields})
    valid = None
    for f in schema.fields:
        present = F.col(f.name).isNotNull()
        valid = present if valid is None else valid & present
    return typed.withColumn("is_valid", valid)


def accepted(typed: DataFrame) -> DataFrame:
    return typed.where("is_valid").drop("is_valid")


def rejected(typed: DataFrame) -> DataFrame:
    return typed.where(~F.col("is_valid")).drop("is_valid")


def labelled_texts(texts: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``(key, text, label)`` for the texts that carry a label."""
    return texts.join(labels.select(key, F.col(label).alias("label")), key).select(key, "text", "label")


def ocr_words(tokens: DataFrame, min_confidence: int = OCR_MIN_CONFIDENCE) -> DataFrame:
    """Confident, non-blank tokens with corner boxes."""
    word = strip(F.col("text"))
    return tokens.where((F.col("conf").cast("int") > min_confidence) & (word != "")).select(
        "page_id", "pos", word.alias("word"), F.col("left").alias("x0"), F.col("top").alias("y0"),
        (F.col("left") + F.col("width")).alias("x1"), (F.col("top") + F.col("height")).alias("y1"),
    )


def layout_fields(words: Column) -> list[Column]:
    """Title, company and location from the first three words, the rest described."""
    def at(i: int, name: str) -> Column:
        return F.coalesce(F.get(words, F.lit(i)), F.lit("")).alias(name)

    rest = F.array_join(F.slice(words, 4, F.greatest(F.size(words) - 3, F.lit(0))), " ")
    return [at(0, "title"), at(1, "company"), at(2, "location"), rest.alias("description")]


def ocr_fields(words: DataFrame, key: str = "page_id") -> DataFrame:
    """One row of fields per page; a page's words are bounded by its image."""
    gathered = words.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return gathered.select(key, *layout_fields(F.transform("w", lambda p: p["word"])))
