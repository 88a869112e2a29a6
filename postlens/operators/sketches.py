"""Quantiles of columns within a stated rank error, from sketches that merge: one pass, no order.

The exact forms in ``counts`` and ``drift`` order the collapsed values. A sketch keeps a
few hundred values of a column instead; sketches of parts, days or groups merge into that
of their union, so they can be stored and combined later without the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """How far a quantile's rank may be off, as a share of all values, with 99 % confidence.

    The published fit for sketches of this kind.
    """
    return 2.296 / size ** 0.9021


def sketch_columns(df: DataFrame, columns: Sequence[str], groups: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``(groups, column, sketch)``: a sketch per group and numeric column, in one aggregate.

    Nulls and NaN take no part; a column without values has a null sketch.
    """
    def values(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.when(~F.isnan(x), x)

    sketches = [F.when(F.count(values(c)) > 0, F.kll_sketch_agg_double(values(c), F.lit(size))).alias(c) for c in columns]
    made = df.groupBy(*groups).agg(*sketches)
    return made.unpivot(list(groups), list(columns), "column", "sketch")


def merged(sketches: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The sketch of each column over all other groups than ``groups``."""
    return sketches.where(F.col("sketch").isNotNull()).groupBy(*groups, "column").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``sketches`` without the sketch, with the number of values and an array of quantiles."""
    at = F.array(*[F.lit(float(s)) for s in shares])
    keep = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*keep, F.kll_sketch_get_n_double("sketch").alias("n"),
                           F.kll_sketch_get_quantile_double("sketch", at).alias("quantiles"))


def sketch_gap(reference: DataFrame, current: DataFrame, points: int = 400) -> DataFrame:
    """``(column, gap)``: the greatest difference of two columns' distributions.

    Each side is read off ``points`` evenly spaced quantiles, so the gap is right within
    both rank errors and ``1 / points``. A column without values on one side has a null gap.
    """
    grid = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    quantiles = lambda side: F.kll_sketch_get_quantile_double(side, grid)
    both = reference.select("column", quantiles(F.col("sketch")).alias("r")).join(
        current.select("column", quantiles(F.col("sketch")).alias("c")), "column", "full")
    # quantiles rise, so how many lie at or below a point is its share times their number
    below = lambda side, x: F.size(F.filter(side, lambda q: q <= x))
    apart = F.transform(F.concat("r", "c"), lambda x: F.abs(below("r", x) - below("c", x)))
    return both.select("column", (F.array_max(apart) / points).alias("gap"))
