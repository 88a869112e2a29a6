"""Drift between a reference and a current table, column by column.

All statistics start from a collapsed table: one row per distinct ``(column, value)``
with its count on either side. Numeric columns hold numbers there, categorical ones
text. A column's kind follows from its type or from an argument, never from its
values, and so does the choice between tests and distances. A side without values
gives null scores, which count as no drift.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlens.constants import DRIFT_SHARE
from postlens.functions import text as X
from postlens.operators.counts import collapsed_values, quality_block
from postlens.operators.order import category_codes, code_table
from postlens.operators.scaling import running_totals
from postlens.schemas import DRIFT_COLUMNS
from postlens.session import written

# fixed values: the limits of the monitoring report
P_VALUE_LIMIT = 0.05
DISTANCE_LIMIT = 0.1
LEAST_DEVIATION = 0.001
# both forms of the Kolmogorov series reach double precision with this many terms on their side
KS_BORDER = 1.0
KS_TERMS = 5


def drift_features(df: DataFrame, text: str = "text", codes: DataFrame | None = None,
                   ratio: Column | None = None) -> DataFrame:
    """The six numeric monitoring columns; an absent optional one is 0, null is 0.

    Pass shared ``codes`` to make category numbers comparable between tables; by
    default they are those of this table alone.
    """
    have = set(df.columns)
    optional = lambda name: F.col(name).cast("double") if name in have else F.lit(0.0)
    coded = category_codes(df, "category", codes) if "category" in have else df.withColumn("category_encoded", F.lit(0))
    features = {
        "text_length": F.length(text).cast("double"),
        "word_count": X.word_count(F.col(text)).cast("double"),
        "compression_ratio": ratio.cast("double") if ratio is not None else optional("compression_ratio"),
        "confidence": optional("confidence"),
        "scam_probability": optional("scam_probability"),
        "category_encoded": F.col("category_encoded").cast("double"),
    }
    rest = [c for c in df.columns if c not in features and c != "category" and c != text]
    return coded.select(*rest, *[c.alias(name) for name, c in features.items()]).na.fill(0.0, DRIFT_COLUMNS)


def shared_codes(reference: DataFrame, current: DataFrame) -> DataFrame:
    return code_table([reference, current], "category")


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def kinds_of(df: DataFrame, columns: Sequence[str], categorical: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """``columns`` as numeric and categorical ones: by type, or named in ``categorical``."""
    numeric = [c for c in columns if c not in categorical and is_numeric(df, c)]
    return numeric, [c for c in columns if c not in numeric]


def two_sided(reference: DataFrame, current: DataFrame, columns: Sequence[str], as_text: bool = False) -> DataFrame:
    """``(column, value, n_ref, n_cur)``; columns missing on one side are left out."""
    both = [c for c in columns if c in reference.columns and c in current.columns]
    kind = "string" if as_text else "double"
    chosen = lambda df: [F.col(c).cast(kind).alias(c) for c in both]
    sides = reference.select(*chosen(reference), F.lit(1).alias("_r")).unionByName(
        current.select(*chosen(current), F.lit(0).alias("_r")))
    return collapsed_values(sides, both, kind, n_ref=F.col("_r"), n_cur=1 - F.col("_r"))


def two_sided_by(df: DataFrame, columns: Sequence[str], is_reference: Column, as_text: bool = False) -> DataFrame:
    """The same from one table split by a condition, in one scan."""
    return collapsed_values(
        df, columns, "string" if as_text else "double",
        n_ref=is_reference.cast("int"), n_cur=(~is_reference).cast("int")
    )


def side_sizes(values: DataFrame) -> DataFrame:
    """Rows and distinct values per column; one row per monitored column, so broadcast."""
    return F.broadcast(values.groupBy("column").agg(
        F.sum("n_ref").alias("ref_rows"), F.sum("n_cur").alias("cur_rows"),
        F.count_if(F.col("n_ref") > 0).alias("ref_values"), F.count("*").alias("all_values"),
    ))


def _distribution_gap(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per distinct value: gap of the two distribution functions, next value."""
    running = running_totals(
        values, "value", {"upto_ref": F.col("n_ref"), "upto_cur": F.col("n_cur")}, ["column"], following="next_value"
    )
    gap = F.abs(F.try_divide("upto_ref", "ref_rows") - F.try_divide("upto_cur", "cur_rows"))
    return running.join(sizes, "column").withColumn("gap", gap)


def ks_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value; 1 for a statistic of 0.

    The alternating series hardly converges for small arguments, so below the border
    its dual form (by the theta function's symmetry) is summed.
    """
    lam2 = statistic * statistic * n * m / (n + m)
    lam = F.sqrt(lam2)
    tail, body = F.lit(0.0), F.lit(0.0)
    for j in range(1, KS_TERMS + 1):
        tail = tail + F.lit(2.0 * (-1) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * lam2)
        body = body + F.exp(F.try_divide(F.lit(-((2 * j - 1) ** 2) * math.pi**2 / 8), lam2))
    dual = 1 - F.try_divide(F.lit(math.sqrt(2 * math.pi)) * body, lam)
    p = F.when(lam < KS_BORDER, dual).otherwise(tail)
    return F.when(statistic == 0, F.lit(1.0)).when(statistic.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def gap_statistics(values: DataFrame) -> DataFrame:
    """``(column, ref_rows, cur_rows, statistic, area)``: largest gap and area in one pass.

    Both are null for a column that has no values on one side.
    """
    gaps = _distribution_gap(values, side_sizes(values))
    area = F.sum(F.col("gap") * (F.col("next_value") - F.col("value")))
    both = (F.col("ref_rows") > 0) & (F.col("cur_rows") > 0)
    return gaps.groupBy("column", "ref_rows", "cur_rows").agg(F.max("gap").alias("_g"), area.alias("_a")).select(
        "column", "ref_rows", "cur_rows", F.when(both, F.col("_g")).alias("statistic"),
        F.when(both, F.coalesce("_a", F.lit(0.0))).alias("area"),
    )


def _with_p(gaps: DataFrame) -> Column:
    return ks_p_value(F.col("statistic"), F.col("ref_rows").cast("double"), F.col("cur_rows").cast("double"))


def ks(values: DataFrame) -> DataFrame:
    """``(column, statistic, p_value)`` of the two-sample test."""
    gaps = gap_statistics(values)
    return gaps.select("column", "statistic", _with_p(gaps).alias("p_value"))


def wasserstein(values: DataFrame, deviations: DataFrame) -> DataFrame:
    """``(column, distance)`` in reference deviations: area between the two functions.

    ``deviations`` holds ``(column, deviation)`` of the reference.
    """
    return gap_statistics(values).join(F.broadcast(deviations), "column").select(
        "column", (F.col("area") / F.greatest("deviation", F.lit(LEAST_DEVIATION))).alias("distance")
    )


def reference_deviations(values: DataFrame) -> DataFrame:
    """``(column, deviation)``: population spread of the reference side.

    Two passes over the collapsed counts keep it exact where the mean is large.
    """
    means = values.groupBy("column").agg(
        F.try_divide(F.sum(F.col("n_ref") * F.col("value")), F.sum("n_ref")).alias("_mean"))
    d = F.col("value") - F.col("_mean")
    return values.join(F.broadcast(means), "column").groupBy("column").agg(
        F.sqrt(F.try_divide(F.sum(F.col("n_ref") * d * d), F.sum("n_ref"))).alias("deviation")
    )


def chi_square(values: DataFrame) -> DataFrame:
    """``(column, statistic, dof)`` of current counts against reference shares."""
    sizes = side_sizes(values)
    expected = F.try_divide(F.col("cur_rows") * F.col("n_ref"), F.col("ref_rows"))
    part = F.when(expected > 0, (F.col("n_cur") - expected) * (F.col("n_cur") - expected) / expected)
    return values.join(sizes, "column").groupBy("column").agg(
        F.sum(part).alias("statistic"), (F.count("*") - 1).alias("dof")
    )


def jensen_shannon(values: DataFrame) -> DataFrame:
    """``(column, distance)``: root of the divergence, natural logarithm."""
    p, q = F.try_divide("n_ref", "ref_rows"), F.try_divide("n_cur", "cur_rows")
    known = (F.col("ref_rows") > 0) & (F.col("cur_rows") > 0)
    half = lambda x: F.when(x > 0, x * F.log(2 * x / (p + q))).otherwise(F.lit(0.0))
    return values.join(side_sizes(values), "column").groupBy("column").agg(
        F.when(F.bool_and(known), F.sqrt(F.greatest((F.sum(half(p)) + F.sum(half(q))) / 2, F.lit(0.0)))).alias("distance")
    )


def _upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """Tail probability; runs on one row per column."""
    return pd.Series([
        None if pd.isna(s) or k < 1 else _upper_gamma(k / 2.0, s / 2.0) for s, k in zip(statistic, dof)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal; runs on one row per column."""
    return z.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))


def proportion_test(values: DataFrame) -> DataFrame:
    """``(column, z)`` for columns of two values: difference of the higher value's share."""
    sizes = side_sizes(values)
    top = values.groupBy("column").agg(F.max(F.struct("value", "n_ref", "n_cur")).alias("t")).join(sizes, "column")
    p1, p2 = F.try_divide("t.n_ref", "ref_rows"), F.try_divide("t.n_cur", "cur_rows")
    pooled = F.try_divide(F.col("t.n_ref") + F.col("t.n_cur"), F.col("ref_rows") + F.col("cur_rows"))
    one = F.lit(1.0)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(one, F.col("ref_rows")) + F.try_divide(one, F.col("cur_rows"))))
    return top.where("all_values <= 2").select(
        "column", F.when(spread == 0, F.lit(0.0)).otherwise(F.try_divide(p1 - p2, spread)).alias("z"))


def column_drift(numeric: DataFrame | None, categories: DataFrame | None = None, method: str = "distance",
                 p_limit: float = P_VALUE_LIMIT, distance_limit: float = DISTANCE_LIMIT) -> DataFrame:
    """``(column, method, score, drifted)`` of collapsed numeric and categorical columns.

    ``distance``: Wasserstein for numbers, Jensen-Shannon for categories, drifted at or
    above the limit. ``test``: Kolmogorov-Smirnov for numbers; for categories the
    chi-square test, or the two-proportion test where there are two values at most;
    drifted below the limit. Null scores count as no drift.
    """
    if method not in ("test", "distance"):
        raise ValueError(f"unknown method {method!r}")
    parts = []
    if numeric is not None:
        gaps = gap_statistics(numeric)
        if method == "test":
            parts.append(gaps.select("column", F.lit("ks").alias("method"), _with_p(gaps).alias("score")))
        else:
            parts.append(gaps.join(F.broadcast(reference_deviations(numeric)), "column").select(
                "column", F.lit("wasserstein").alias("method"),
                (F.col("area") / F.greatest("deviation", F.lit(LEAST_DEVIATION))).alias("score")))
    if categories is not None and method == "test":
        found = chi_square(categories).join(proportion_test(categories), "column", "left")
        few = F.col("z").isNotNull() | (F.col("dof") <= 1)
        parts.append(found.select(
            "column", F.when(few, "z_test").otherwise("chi_square").alias("method"),
            F.when(few, normal_p("z")).otherwise(chi_square_p("statistic", "dof")).alias("score")))
    elif categories is not None:
        parts.append(jensen_shannon(categories).select("column", F.lit("jensen_shannon").alias("method"), F.col("distance").alias("score")))
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    drifted = F.col("score") < p_limit if method == "test" else F.col("score") >= distance_limit
    return scored.withColumn("drifted", F.coalesce(drifted, F.lit(False)))


def dataset_drift(drift: DataFrame, share: float = DRIFT_SHARE) -> DataFrame:
    """One row: columns, drifted columns, their share and the flag."""
    return drift.agg(
        F.count("*").alias("columns"), F.count_if("drifted").alias("drifted_columns"),
        F.avg(F.col("drifted").cast("double")).alias("drift_share"),
    ).withColumn("dataset_drift", F.col("drift_share") >= share)


def drift_between(reference: DataFrame, current: DataFrame, columns: Sequence[str],
                  categorical: Sequence[str] = (), method: str = "distance") -> DataFrame:
    """Drift of columns of any type; numbers named in ``categorical`` are categories."""
    numeric, named = kinds_of(current, columns, categorical)
    return column_drift(
        two_sided(reference, current, numeric) if numeric else None,
        two_sided(reference, current, named, as_text=True) if named else None, method)


def drift_summary(current: DataFrame, reference: DataFrame | None = None, columns: Sequence[str] = DRIFT_COLUMNS,
                  method: str = "distance", categorical: Sequence[str] = ()) -> DataFrame:
    """One row per column: drift, score (drifted columns only) and data quality.

    Without a reference the current table is compared with itself: no drift.
    """
    # the text behind the features is read once, the narrow features several times
    columns = [c for c in columns if c in current.columns and (reference is None or c in reference.columns)]
    current = written(current.select(*columns), "features")
    reference = current if reference is None else written(reference.select(*columns), "features")
    drift = written(drift_between(reference, current, columns, categorical, method), "drift")
    flag = dataset_drift(drift).select("dataset_drift")
    quality = quality_block(current, reference, columns)
    return quality.join(drift, "column", "left").select(
        "column", "type", "missing", "current_rows", "reference_rows", "method",
        F.coalesce("drifted", F.lit(False)).alias("drifted"),
        F.when(F.col("drifted"), F.col("score")).alias("drift_score"),
        flag.scalar().alias("dataset_drift"),
    )


def summary_rollup(summary: DataFrame) -> DataFrame:
    """The summary as one row of lists and maps; it has one entry per column."""
    scored = F.when(F.col("drifted"), F.struct("column", "drift_score"))
    pair = lambda name: F.map_from_entries(F.collect_list(F.struct("column", name)))
    return summary.agg(
        F.bool_or("dataset_drift").alias("dataset_drift"),
        F.sort_array(F.collect_list(F.when(F.col("drifted"), F.col("column")))).alias("drift_columns"),
        F.map_from_entries(F.collect_list(scored)).alias("drift_scores"),
        F.struct(
            F.max("current_rows").alias("current_rows"), F.max("reference_rows").alias("reference_rows"),
            pair("missing").alias("missing_values"), pair("type").alias("column_types"),
        ).alias("data_quality"),
    )


def drift_scores(summary: DataFrame) -> DataFrame:
    """The data behind the drift bar chart."""
    return summary.where("drifted").select(F.col("column").alias("Column"), F.col("drift_score").alias("Drift Score"))


def drift_by_window(df: DataFrame, time: str, value: str, reference: DataFrame, width: str) -> DataFrame:
    """KS statistic of every time window against a fixed reference column.

    The window start joins the column name, so all windows share one plan and the
    reference is counted once per window through its collapsed values.
    """
    start = F.window(time, width)["start"]
    current = written(df.where(F.col(value).isNotNull()).groupBy(
        start.alias("window_start"), F.col(value).cast("double").alias("value")
    ).agg(F.count("*").alias("n_cur")), "window_values")
    fixed = written(reference.where(F.col(value).isNotNull()).groupBy(
        F.col(value).cast("double").alias("value")
    ).agg(F.count("*").alias("n_ref")), "reference_values")
    # F_ref at a value of the window: the windows bring their own values only, and a
    # reference value between two of them is seen from the last value before it
    marks = current.select("value").distinct().withColumn("_mark", F.lit(1)).join(fixed, "value", "full_outer")
    placed = running_totals(
        marks.select("value", F.coalesce("n_ref", F.lit(0)).alias("n_ref"), "_mark"),
        "value", {"ref_upto": F.col("n_ref")},
    ).where("_mark = 1").select("value", "n_ref", "ref_upto")
    sizes = current.groupBy("window_start").agg(F.sum("n_cur").alias("cur_rows"))
    whole = fixed.agg(F.sum("n_ref").alias("n")).scalar()
    running = running_totals(current, "value", {"cur_upto": F.col("n_cur")}, ["window_start"])
    both = running.join(placed, "value").join(sizes, "window_start").withColumn("ref_rows", whole)
    at = F.abs(F.col("ref_upto") / F.col("ref_rows") - F.col("cur_upto") / F.col("cur_rows"))
    # just below the value the window has not yet stepped up, the reference nearly has
    below = F.abs(
        (F.col("ref_upto") - F.col("n_ref")) / F.col("ref_rows")
        - (F.col("cur_upto") - F.col("n_cur")) / F.col("cur_rows")
    )
    return both.groupBy("window_start", "cur_rows").agg(F.max(F.greatest(at, below)).alias("statistic"))


def save_reference(df: DataFrame, path: str) -> str:
    """Replace the named reference snapshot."""
    df.write.mode("overwrite").parquet(path)
    return path


def load_reference(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_drift_report(summary: DataFrame, base: str, name: str | None = None, quality: DataFrame | None = None) -> str:
    """The summary, with the quality profile of each column where given, as a JSON folder."""
    from postlens.sinks.stores import stamp, write_json

    whole = summary if quality is None else summary.join(
        quality.select("column", F.struct(*[c for c in quality.columns if c != "column"]).alias("profile")), "column", "left")
    return write_json(whole, f"{base.rstrip('/')}/{name or 'drift_report_' + stamp()}")
