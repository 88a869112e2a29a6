"""Contact, skill and scam signals of a posting, and how they are shown."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from postlens import constants as C
from postlens.functions.text import strip


def email(text: Column) -> Column:
    """First address; the cheap test for the sign spares the pattern most texts."""
    found = F.regexp_extract(text, f"({C.EMAIL_PATTERN})", 1)
    return F.when(text.contains("@"), F.nullif(found, F.lit("")))


def phone(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({C.PHONE_PATTERN})", 1), F.lit(""))


def contacts(text: Column) -> Column:
    return F.struct(email(text).alias("email"), phone(text).alias("phone"))


def skills(text: Column, patterns: Sequence[str] = C.SKILL_PATTERNS) -> Column:
    """Distinct captured phrases, first occurrence first, family by family."""
    low = F.lower(text)
    found = F.concat(*[F.regexp_extract_all(low, F.lit(p), 1) for p in patterns])
    return F.array_distinct(F.transform(found, strip))


def phrase_count(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur; each counts once."""
    if not phrases:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [text.contains(p).cast("int") for p in phrases])


def scam_features(text: Column, phrases: Sequence[str] = C.SUSPICIOUS_PHRASES) -> Column:
    low = F.lower(text)
    return F.struct(
        F.length(low).alias("length"),
        (low.contains("@") & low.rlike(C.EMAIL_PATTERN)).alias("has_email"),
        low.rlike(C.TEN_DIGIT_PATTERN).alias("has_phone"),
        (low.contains("http") & low.rlike(C.URL_PATTERN)).alias("has_url"),
        phrase_count(low, phrases).alias("suspicious_word_count"),
        low.rlike(C.COMPANY_PATTERN).alias("has_company_name"),
        low.rlike(C.LOCATION_PATTERN).alias("has_location"),
    )


SCAM_FLAGS = ["has_email", "has_phone", "has_url", "suspicious_word_count", "has_company_name", "has_location"]


def suspicious_indicators(features: Column) -> Column:
    """Names of the raised features in reading form, in feature order."""
    flags = F.array(*[
        F.struct(
            F.lit(name.replace("_", " ")).alias("name"),
            (features[name].cast("int") > 0).alias("raised"),
        )
        for name in SCAM_FLAGS
    ])
    return F.transform(F.filter(flags, lambda f: f["raised"]), lambda f: F.initcap(f["name"]))


def risk_tier(probability: Column) -> Column:
    return (
        F.when(probability > C.RISK_RED, "red")
        .when(probability > C.RISK_ORANGE, "orange")
        .otherwise("green")
    )


def display_title(category: Column, confidence: Column, is_scam: Column) -> Column:
    title = F.concat(
        F.initcap(category), F.lit(" (Confidence: "),
        F.format_string("%.2f%%", confidence * 100), F.lit(")"),
    )
    return F.when(is_scam, F.concat(F.lit("⚠️ "), title, F.lit(" - Potential Scam!"))).otherwise(title)


def experience_level(years: Column) -> Column:
    return (
        F.when(years < C.ENTRY_BELOW_YEARS, "entry")
        .when(years < C.MID_BELOW_YEARS, "mid")
        .otherwise("senior")
    )


def rupee_range(low: Column, high: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(low, 0), F.lit(" - ₹"), F.format_number(high, 0))


def nested_number(json: Column, path: str) -> Column:
    """A number below a JSON text, 0 where the text or the key is missing."""
    return F.coalesce(F.get_json_object(json, path).try_cast("double"), F.lit(0.0))


def percent(share: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", share * 100)


def time_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss")
