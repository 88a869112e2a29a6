"""Exact bands against every way to cut."""

import itertools

import numpy as np
import pytest

from postlens.operators import bands, clusters


def cost(values, cuts):
    groups = np.searchsorted(np.array(cuts), values, "left")
    return sum(((values[groups == g] - values[groups == g].mean()) ** 2).sum() for g in set(groups.tolist()))


def best(values, k):
    points = sorted(set(values.tolist()))
    return min(cost(values, cuts) for cuts in itertools.combinations(points[:-1], k - 1))


def frame(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "salary double").repartition(3)


@pytest.mark.parametrize("seed, k, limit", [(0, 3, 2_000_000), (1, 3, 5), (2, 2, 5), (3, 4, 5), (4, 4, 2_000_000), (5, 1, 5)])
def test_least_cost_of_all_cuts(spark, seed, k, limit):
    draw = np.random.default_rng(seed)
    values = np.concatenate([draw.normal(size=20).round(1), draw.exponential(size=25).round(1) * 9, np.full(7, 3.0)])
    cuts = bands.band_cuts(frame(spark, values), "salary", k, limit)
    assert len(cuts) == k - 1 and cuts == sorted(cuts)
    assert cost(values, cuts) == pytest.approx(best(values, k))


def test_ranges_cut_again_agree(spark):
    draw = np.random.default_rng(9)
    values = np.concatenate([draw.normal(size=1500) * 1e5 + 1e6, draw.exponential(size=1500), [5e9]])
    df = frame(spark, values)
    one, two = (bands.band_cuts(df, "salary", 3, limit=n) for n in (2_000_000, 40))
    assert cost(values, one) == pytest.approx(cost(values, two), rel=1e-9)
    df = frame(spark, values[:-1])
    assert bands.band_cuts(df, "salary", 3) == bands.band_cuts(df, "salary", 3, limit=40)


def test_solve_equals_trying_every_cut():
    draw = np.random.default_rng(3)
    x = np.sort(draw.normal(size=300))
    w = draw.integers(1, 5, 300).astype(float)
    rows = np.stack([np.arange(1, 301), w.cumsum(), (w * x).cumsum(), (w * x * x).cumsum(), np.zeros(300)], axis=1)
    rows[:, 4] = rows[:, 3] - rows[:, 2] ** 2 / rows[:, 1]
    found, at = bands.solve(rows, rows[1:])
    for j in range(1, 300):
        tried = rows[:j, 4] + bands.stretch(*rows[:j, 1:4].T, *rows[j, 1:4])
        assert found[j - 1] == pytest.approx(tried.min()) and tried[at[j - 1] - 1] == pytest.approx(tried.min())


def test_few_values_and_odd_ones(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,), (float("nan"),), (float("inf"),), (7.0,), (5.0,)], "salary double")
    assert bands.band_cuts(df, "salary", 3) == [5.0]
    got = {(r["salary"], r["salary_band"]) for r in clusters.salary_bands(df.where("salary < 100")).collect()}
    assert got == {(5.0, "Band 0"), (7.0, "Band 1")}
    assert {r["salary_band"] for r in clusters.salary_bands(df.limit(2)).collect()} == {None}
