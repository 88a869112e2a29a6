"""Alignment, write-back and dictionary lookups as equi-joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def align_results(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two result tables over the same rows, side by side."""
    return left.join(right, key, "inner")


def write_back(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Results computed on complete rows only, put back; other rows keep null."""
    return rows.join(results, key, "left")


def label_lookup(df: DataFrame, column: str, mapping: Mapping, name: str) -> DataFrame:
    """Map a value through a dictionary held in the plan; unknown values give null."""
    pairs = [part for key, value in mapping.items() for part in (F.lit(key), F.lit(value))]
    return df.withColumn(name, F.try_element_at(F.create_map(*pairs), F.col(column)))


def lookup_table(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Map through a table; AQE broadcasts it when its measured size allows."""
    return df.join(dimension, key, "left")


def union_sources(sources: Mapping[str, DataFrame], column: str = "source") -> DataFrame:
    """All rows of all sources, tagged; columns a source lacks are null."""
    tagged = [frame.withColumn(column, F.lit(name)) for name, frame in sources.items()]
    out = tagged[0]
    for frame in tagged[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def append_labelled(frames: Sequence[tuple[DataFrame, str]], text: str = "text") -> DataFrame:
    """Training texts appended class by class as ``(text, label)``."""
    parts = [frame.select(F.col(text).alias("text"), F.lit(label).alias("label")) for frame, label in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
