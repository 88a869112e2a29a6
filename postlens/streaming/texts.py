"""The row-local operators on streams of posting files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from postlens.functions import signals, text as X


def text_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scored_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned text, scam features and contacts: no state, so no watermark."""
    body = F.col(text)
    return df.withColumns({
        "clean": X.clean_text(body), "scam": signals.scam_features(body), "contact": signals.contacts(body),
    })


def run_available(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Process all files present, write parquet once and stop."""
    query = (
        plan(stream).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
