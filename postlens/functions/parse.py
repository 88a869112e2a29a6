"""Salary and experience text to numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postlens.constants import NOT_MENTIONED, SALARY_CURRENCY, SALARY_PATTERNS
from postlens.functions.text import SPACE, strip

_RANGE = r"^(\d+)(?:\s*-\s*(\d+))?"


def _digits(text: Column) -> Column:
    """All digits of a text joined and read as one number."""
    return F.regexp_replace(text, "[^0-9]", "").try_cast("double")


def _midpoint(text: Column) -> Column:
    """The middle of the first one or two decimal numbers."""
    numbers = F.slice(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), 1, 2)
    low = F.get(numbers, F.lit(0)).try_cast("double")
    high = F.get(numbers, F.lit(1)).try_cast("double")
    return (low + F.coalesce(high, low)) / 2


def salary_lakh(text: Column, mode: str = "compat") -> Column:
    """Thousands from lakh or k text; anything else is 0.

    ``compat`` joins every digit ("2.5-5 Lacs" is 255 hundreds); ``clean`` takes
    the middle of the range.
    """
    low = F.lower(text)
    lakh = low.contains("lacs") | low.contains("lakh")
    if mode == "clean":
        value = F.when(lakh, _midpoint(low) * 100).when(low.rlike(r"\d\s*k\b"), _midpoint(low))
    elif mode == "compat":
        value = F.when(lakh, _digits(low) * 100).when(low.contains("k"), _digits(low))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(value, F.lit(0.0))


def experience_compact(text: Column, mode: str = "compat") -> Column:
    """Years from the first word; ``clean`` reads only its first number."""
    first = F.get(F.split(strip(text), SPACE + "+"), F.lit(0))
    if mode == "clean":
        value = F.regexp_extract(first, r"(\d+)", 1).try_cast("double")
    elif mode == "compat":
        value = _digits(first)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(value, F.lit(0.0))


def salary_midpoint(text: Column) -> Column:
    """Whole-number midpoint of a rupee range; null when nothing can be read."""
    plain = F.lower(strip(F.translate(text, "₹,", "")))
    low = F.regexp_extract(plain, _RANGE, 1).try_cast("bigint")
    high = F.regexp_extract(plain, _RANGE, 2).try_cast("bigint")
    thousands = F.replace(plain, F.lit("k"), F.lit("")).try_cast("double") * 1000
    return (
        F.when((text == "") | text.contains(NOT_MENTIONED), F.lit(None))
        .when(plain.rlike(r"^\d"), F.floor((low + F.coalesce(high, low)) / 2))
        .when(plain.contains("k"), thousands.try_cast("bigint"))
        .otherwise(plain.try_cast("bigint"))
        .cast("bigint")
    )


def experience_first(text: Column) -> Column:
    """First whole number; empty or fresher text is 0, text without a number null."""
    found = F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).when(
        text.contains("Fresher"), F.lit(0)
    ).otherwise(found).cast("bigint")


def salary_range(text: Column) -> Column:
    """Struct of lowest and highest amount, currency and period.

    The patterns are tried in order and the first that occurs anywhere wins.
    """
    low = F.lower(text)

    def amount(pattern: str, group: int) -> Column:
        found = F.nullif(F.regexp_extract(low, pattern, group), F.lit(""))
        return F.replace(found, F.lit(","), F.lit("")).try_cast("double")

    least = F.coalesce(*[amount(p, 1) for p in SALARY_PATTERNS])
    most = F.coalesce(*[amount(p, 2) for p in SALARY_PATTERNS])
    period = F.when(low.contains("year"), "year").otherwise("month")
    return F.struct(
        least.alias("min_salary"),
        most.alias("max_salary"),
        F.when(least.isNotNull(), F.lit(SALARY_CURRENCY)).alias("currency"),
        F.when(least.isNotNull(), period).alias("period"),
    )
