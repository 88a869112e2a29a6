"""Exact one-dimensional bands: the cuts of sorted values with the least squared distance to band means.

Equal values are collapsed to one row with running sums, so the cost of any stretch of
values follows from two rows. The best last cut before value j moves upwards with j. So
a layer of the dynamic programme is cut in ranges of j: the best cuts at the range ends
are found by one pass over all values, and inside a range only the cuts between those of
its ends are tried, a range per task. Ranges that would hold too many values are cut again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postlens.operators.scaling import running_totals
from postlens.session import written

ENDS = 64
RANGE_ROWS = 2_000_000
COLUMNS = ("i", "w", "s1", "s2", "d")


def stretch(w0, s10, s20, w1, s11, s21):
    """Squared distance to their mean of the values after the first place up to the second."""
    w, s = w1 - w0, s11 - s10
    return np.maximum(s21 - s20 - s * s / w, 0.0)


def solve(cuts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least cost and best cut of every end; both are sorted rows of ``COLUMNS``, costs up to the cut in ``d``.

    The middle end is tried against all cuts, which halves the cuts left for the others.
    """
    best, at = np.full(len(ends), np.inf), np.zeros(len(ends), np.int64)
    waiting = [(0, len(ends), 0, len(cuts))]
    while waiting:
        low, high, first, last = waiting.pop()
        if low >= high:
            continue
        mid = (low + high) // 2
        end = ends[mid]
        upto = first + max(1, int(np.searchsorted(cuts[first:last, 0], end[0])))
        part = cuts[first:min(upto, last)]
        with np.errstate(divide="ignore", invalid="ignore"):
            cost = np.where(part[:, 0] < end[0], part[:, 4] + stretch(*part[:, 1:4].T, *end[1:4]), np.inf)
        k = int(np.argmin(cost))
        best[mid], at[mid] = cost[k], int(part[k, 0])
        waiting += [(low, mid, first, first + k + 1), (mid + 1, high, first + k, last)]
    return best, at


def _at_ends(values: DataFrame, ends: np.ndarray) -> dict[int, tuple[float, int]]:
    """Least cost and best cut of a few ends, over all cuts: one pass, a row per task and end."""
    sent = values.sparkSession.sparkContext.broadcast(ends)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        best, at = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for batch in batches:
            part = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in COLUMNS], axis=1)
            if not len(part):
                continue
            for j, end in enumerate(rows):
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost = np.where(part[:, 0] < end[0], part[:, 4] + stretch(*part[:, 1:4].T, *end[1:4]), np.inf)
                k = int(np.argmin(cost))
                if (cost[k], part[k, 0]) < (best[j], at[j]):
                    best[j], at[j] = cost[k], int(part[k, 0])
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int64)), pa.array(best), pa.array(at)], ["j", "cost", "at"])

    found = values.select(*COLUMNS).mapInArrow(tried, "j bigint, cost double, at bigint")
    least = found.where(~F.col("cost").isin(float("inf"))).groupBy("j").agg(F.min(F.struct("cost", "at")).alias("b"))
    return {r["j"]: (r["b"]["cost"], r["b"]["at"]) for r in least.collect()}


def _rows_at(values: DataFrame, places: list[int]) -> np.ndarray:
    rows = values.where(F.col("i").isin(places)).select(*COLUMNS).collect()
    return np.array(sorted(tuple(map(float, r)) for r in rows)).reshape(-1, len(COLUMNS))


def _layer(values: DataFrame, n: int, limit: int) -> DataFrame:
    """``(i, d, cut)``: least cost of every end with one band more than in ``d`` of ``values``, and its best cut."""
    ends = sorted({max(2, round(n * k / ENDS)) for k in range(1, ENDS + 1)})
    known = _at_ends(values, _rows_at(values, ends))
    while True:
        # ranges after one end up to the next; their cuts lie between those of the two ends
        places = sorted(known)
        # rounding may let equally good cuts step back a little
        highs = np.maximum.accumulate([known[p][1] for p in places]).tolist()
        spans = list(zip([1, *places[:-1]], places, [1, *highs[:-1]], highs))
        wide = [s for s in spans if s[1] - s[0] > 1 and (s[1] - s[0]) + (s[3] - s[2]) > limit]
        if not wide:
            break
        more = sorted({(a + b) // 2 for a, b, *_ in wide})
        known |= _at_ends(values, _rows_at(values, more))
    table = np.array(spans, np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column("i").to_numpy(zero_copy_only=False)
            parts = []
            for end, low, high in ((True, table[:, 0], table[:, 1]), (False, table[:, 2] - 1, table[:, 3])):
                # the ranges that hold a place follow each other
                first, last = np.searchsorted(high, i, "left"), np.searchsorted(low, i, "left")
                count = np.maximum(last - first, 0)
                row = np.repeat(np.arange(len(i)), count)
                span = np.repeat(first, count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                picked = batch.take(pa.array(row))
                parts.append(pa.RecordBatch.from_arrays([pa.array(span), pa.array(np.full(len(row), end)), *picked.columns],
                                                        ["span", "is_end", *COLUMNS]))
            yield from parts

    def solved(rows: pa.Table) -> pa.Table:
        whole = np.stack([rows[c].to_numpy().astype(float) for c in COLUMNS], axis=1)
        is_end = rows["is_end"].to_numpy()
        order = np.argsort(whole[:, 0], kind="stable")
        whole, is_end = whole[order], is_end[order]
        own = whole[is_end]
        best, at = solve(whole[~is_end], own)
        return pa.table({"i": own[:, 0].astype(np.int64), "d": best, "cut": at})

    spread = values.select(*COLUMNS).mapInArrow(dealt, "span bigint, is_end boolean, i bigint, w double, s1 double, s2 double, d double")
    return spread.groupBy("span").applyInArrow(solved, "i bigint, d double, cut bigint")


def band_cuts(df: DataFrame, value: str, k: int, limit: int = RANGE_ROWS) -> list[float]:
    """The greatest value of every band but the last, for the best ``k`` bands; fewer if there are fewer values.

    Costs are differences of sums in double precision: cuts that differ by less than that are
    equally good. Only the cuts and the costs at a few range ends reach the driver. Nulls, infinite
    values and NaN take no part; equal values always share a band.
    """
    x = F.col(value).cast("double")
    finite = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))).select(x.alias("v"))
    counts = written(finite.groupBy("v").agg(F.count("*").alias("c")), "band_values")
    whole = counts.agg(F.count("*").alias("n"), (F.sum(F.col("c") * F.col("v")) / F.sum("c")).alias("m")).first()
    n = whole["n"]
    if n <= k:
        return [r["v"] for r in counts.orderBy("v").collect()][:-1]
    # around the mean, so that little is lost when sums are subtracted
    off, c = F.col("v") - whole["m"], F.col("c").cast("double")
    placed = running_totals(counts, "v", {"i": F.lit(1).cast("bigint"), "w": c, "s1": c * off, "s2": c * off * off})
    first: Column = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("w"), F.lit(0.0))
    values = written(placed.select("v", "i", "w", "s1", "s2", first.alias("d")), "band_sums")
    layers = []
    for _ in range(k - 2):
        layer = written(_layer(values, n, limit), "band_layer")
        layers.append(layer)
        values = values.drop("d").join(layer.select("i", "d"), "i").select("v", "i", "w", "s1", "s2", "d")
    cut = _at_ends(values, _rows_at(values, [n]))[n][1] if k > 1 else None
    cuts = [] if cut is None else [cut]
    for layer in reversed(layers):
        cuts.append(layer.where(F.col("i") == cuts[-1]).first()["cut"])
    rows = {r["i"]: r["v"] for r in values.where(F.col("i").isin(cuts)).select("i", "v").collect()}
    return [rows[i] for i in sorted(cuts)]


def band_of(value: Column, cuts: list[float]) -> Column:
    """The band's number; null for null, NaN and infinite values."""
    x = value.cast("double")
    above = [F.when(x > F.lit(float(c)), 1).otherwise(0) for c in cuts]
    number = F.lit(0)
    for one in above:
        number = number + one
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), number)
