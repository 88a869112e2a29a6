"""Declared schemas of the tables the operators read and write."""

from pyspark.sql import types as T

POSTING = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("salary", T.DoubleType()),
    T.StructField("experience", T.DoubleType()),
])

BANDED_POSTING = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("salary", T.DoubleType()),
    T.StructField("experience", T.DoubleType()),
])

CARD = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("experience", T.StringType()),
    T.StructField("description", T.StringType()),
])

OCR_TOKEN = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("conf", T.IntegerType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("top", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
])

PREDICTION = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("all_predictions", T.ArrayType(T.StructType([
        T.StructField("label", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]))),
])

DRIFT_COLUMNS = [
    "text_length", "word_count", "compression_ratio",
    "confidence", "scam_probability", "category_encoded",
]
