"""Sketches within their rank error on skewed, sorted and repeated values; parts that merge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import sketches as S

SHARES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


def off_by(values, quantile, share):
    """How far ``share`` lies outside the ranks that ``quantile`` has among ``values``."""
    low, high = (values < quantile).mean(), (values <= quantile).mean()
    return max(low - share, share - high, 0.0)


def frame(spark, values, parts=6):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(parts)


@pytest.mark.parametrize("kind", ["skewed", "sorted", "repeated"])
def test_rank_error_holds(spark, kind):
    draw = np.random.default_rng(7)
    values = {"skewed": draw.pareto(0.8, 60_000), "sorted": np.arange(60_000.0), "repeated": np.repeat([1.0, 5.0, 9.0], [50_000, 9_000, 1_000])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").coalesce(1) if kind == "sorted" else frame(spark, values)
    row = S.sketch_quantiles(S.sketch_columns(df, ["x"]), SHARES).first()
    assert row["n"] == len(values)
    assert all(off_by(values, q, s) <= 2 * S.rank_error() for q, s in zip(row["quantiles"], SHARES))


def test_sketches_of_parts_merge(spark):
    draw = np.random.default_rng(8)
    values = np.concatenate([draw.normal(size=20_000), draw.normal(size=200) + 50])
    df = frame(spark, values).withColumn("g", (F.col("x") > 20).cast("int"))
    by = S.sketch_columns(df, ["x"], ["g"])
    row = S.sketch_quantiles(S.merged(by), SHARES).first()
    assert by.count() == 2 and row["n"] == len(values)
    assert all(off_by(values, q, s) <= 2 * S.rank_error() for q, s in zip(row["quantiles"], SHARES))


def test_gap_is_that_of_the_distributions(spark):
    draw = np.random.default_rng(9)
    a, b = draw.normal(size=30_000), draw.normal(size=30_000) + 0.5
    grid = np.sort(np.concatenate([a, b]))
    exact = np.abs(np.searchsorted(np.sort(a), grid, "right") / len(a) - np.searchsorted(np.sort(b), grid, "right") / len(b)).max()
    got = S.sketch_gap(S.sketch_columns(frame(spark, a), ["x"]), S.sketch_columns(frame(spark, b), ["x"])).first()
    assert got["gap"] == pytest.approx(exact, abs=4 * S.rank_error() + 1 / 400)


def test_nulls_and_no_values(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    made = S.sketch_columns(df, ["x", "y"])
    got = {r["column"]: r for r in S.sketch_quantiles(made, [0.5]).collect()}
    assert got["x"]["quantiles"] is None and got["y"]["n"] == 2
    assert S.sketch_gap(made, made).where("column = 'x'").first()["gap"] is None
