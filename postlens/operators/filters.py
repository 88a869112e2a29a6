"""Row filters and projections over posting tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from postlens.constants import LINK_KEYWORDS


def filter_postings(df: DataFrame, category: str = "All", min_confidence: float = 0.0,
                    max_scam_probability: float = 1.0) -> DataFrame:
    kept = df if category == "All" else df.where(F.col("category") == category)
    return kept.where(
        (F.col("confidence") >= min_confidence) & (F.col("scam_probability") <= max_scam_probability)
    )


def parse_band(band: str) -> tuple[int, int]:
    """``₹15k–₹20k`` to its two amounts."""
    low, high = band.replace("₹", "").replace("k", "000").split("–")
    return int(low), int(high)


def filter_band(df: DataFrame, category: str | None = None, experience_level: str | None = None,
                salary_band: str | None = None) -> DataFrame:
    """Optional conditions joined by AND; the salary range includes both ends."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if experience_level is not None:
        df = df.where(F.col("experience_level") == experience_level)
    if salary_band is not None:
        low, high = parse_band(salary_band)
        df = df.where(F.col("salary").between(low, high))
    return df


def filter_band_label(df: DataFrame, label: str) -> DataFrame:
    return df.where(F.col("salary_band") == label)


def filter_level_salary(df: DataFrame, category: str, level: str, above: float,
                        columns: Sequence[str] | None = None) -> DataFrame:
    kept = df.where(
        (F.col("category") == category) & (F.col("level_name") == level) & (F.col("salary") > above)
    )
    return kept.select(*columns) if columns else kept


def filter_targets(df: DataFrame, categories: Sequence[str], max_scam_probability: float) -> DataFrame:
    return df.where(
        F.col("category").isin(list(categories)) & (F.col("scam_probability") <= max_scam_probability)
    )


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def rows_with_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.where(any_null(columns or df.columns))


def filter_links(links: DataFrame, keywords: Sequence[str] = LINK_KEYWORDS) -> DataFrame:
    """Links whose text or address holds one of the keywords, in any case."""
    def holds(column: str) -> Column:
        low = F.lower(F.col(column))
        return reduce(lambda a, b: a | b, [low.contains(k) for k in keywords])

    return links.where(holds("text") | holds("href"))


def classified_only(df: DataFrame) -> DataFrame:
    return df.where(F.col("category").isNotNull())


def head_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first rows along a stated order: a bounded top-n, not a full sort."""
    return df.orderBy(order).limit(n)
