"""Counting, auditing and reporting aggregates; all combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from postlens.operators.scaling import running_totals, small_side
from postlens.session import written


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for each column, null values left out."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def by_count(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.col("column"), F.col("n").desc(), F.col("value"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column in one pass."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "missing")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def min_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def quality_block(current: DataFrame, reference: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts of both frames, and missing values and type of each column."""
    types = dict(current.dtypes)
    ref_rows = reference.agg(F.count("*").alias("reference_rows"))
    row = current.agg(
        F.count("*").alias("current_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    long = row.unpivot(["current_rows"], list(columns), "column", "missing")
    kinds = F.create_map(*[part for c in columns for part in (F.lit(c), F.lit(types[c]))])
    return long.select(
        "column", "missing", "current_rows", ref_rows.scalar().alias("reference_rows"),
        F.element_at(kinds, F.col("column")).alias("type"),
    )


def collapsed_values(df: DataFrame, columns: Sequence[str], kind: str = "double", **sides: Column) -> DataFrame:
    """Distinct ``(column, value)`` with a row count, or one count per named side.

    ``kind`` is the type in which values are told apart: wide enough for the columns.

    A value however frequent becomes one row before the shuffle ends. The table is
    written once, since ordered statistics read it several times.
    """
    measures = sides or {"n": F.lit(1)}
    keep = df.select(
        *[F.col(c).cast(kind).alias(c) for c in columns],
        *[m.cast("bigint").alias(f"_m_{name}") for name, m in measures.items()],
    )
    long = keep.unpivot([f"_m_{name}" for name in measures], list(columns), "column", "value")
    counted = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        *[F.sum(f"_m_{name}").alias(name) for name in measures]
    )
    return written(counted, "values")


def exact_quantiles(values: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles from collapsed counts: ``(column, p, quantile)``.

    Cumulative counts place the two neighbouring order statistics, so no task ever
    holds all values of a column.
    """
    sizes = values.groupBy("column").agg(F.sum("n").alias("total"))
    placed = running_totals(values, "value", {"upto": F.col("n")}, ["column"])
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")
    targets = sizes.select("column", wanted, "total").withColumn("h", (F.col("total") - 1) * F.col("p"))
    low, high = F.floor("h"), F.ceil("h")
    start = F.col("upto") - F.col("n")
    # a target table has (columns x probabilities) rows; the equi-join is on the column
    near = placed.join(F.broadcast(targets), "column").where(
        ((start <= low) & (F.col("upto") > low)) | ((start <= high) & (F.col("upto") > high))
    )
    # both order statistics lie in one value or in two neighbouring ones
    return near.groupBy("column", "p", "h").agg(
        F.min("value").cast("double").alias("a"), F.max("value").cast("double").alias("b")
    ).select("column", "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias("quantile"))


PROFILE = ["count", "missing", "distinct", "mean", "std", "min", "max", "most_common", "q25", "q50", "q75"]
EXACT = "decimal(38,0)"  # holds every integer type


def _profile_kind(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        return EXACT
    return "double" if isinstance(kind, T.NumericType) else "string"


def quality_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, distinct, mean, spread, range, quartiles and most common value of any columns.

    Values are told apart in their own type: integers exactly, other numbers as
    doubles, everything else as text. Range and most common value are given as text
    where any column is not numeric, as doubles otherwise; moments and quartiles of
    other columns are null. The smallest of equally common values is named.
    """
    groups: dict[str, list[str]] = {}
    for c in columns:
        groups.setdefault(_profile_kind(df, c), []).append(c)
    shown = "string" if "string" in groups else "double"
    parts = [_profile_of(df, own, kind, shown) for kind, own in groups.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _profile_of(df: DataFrame, columns: Sequence[str], kind: str, shown: str) -> DataFrame:
    numeric = kind != "string"
    number = lambda c: F.col(c).cast("double") if numeric else F.lit(None).cast("double")
    stats = df.agg(*[
        F.struct(
            F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("missing"),
            F.avg(number(c)).alias("mean"), F.stddev_samp(number(c)).alias("std"),
        ).alias(c)
        for c in columns
    ]).unpivot([], list(columns), "column", "s").select("column", "s.*")
    values = collapsed_values(df, columns, kind)
    shape = values.groupBy("column").agg(F.count("*").alias("distinct"), F.min("value").alias("min"), F.max("value").alias("max"), F.max("n").alias("_n"))
    common = values.join(F.broadcast(shape.select("column", "_n")), "column").where(F.col("n") == F.col("_n")).groupBy("column").agg(
        F.min("value").alias("most_common"))
    out = stats.join(shape.drop("_n"), "column", "left").join(common, "column", "left")
    if numeric:
        quartiles = exact_quantiles(values, [0.25, 0.5, 0.75]).groupBy("column").agg(*[
            F.max(F.when(F.col("p") == p, F.col("quantile").cast("double"))).alias(name)
            for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))
        ])
        out = out.join(quartiles, "column", "left")
    else:
        out = out.withColumns({q: F.lit(None).cast("double") for q in ("q25", "q50", "q75")})
    return out.withColumns({c: F.col(c).cast(shown) for c in ("min", "max", "most_common")}).select("column", *PROFILE)


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"), F.count("*").alias("support"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, f1 and support per class, then macro and weighted means.

    The class pairs are written once: scoring behind them may be costly, and every mean
    reads them again.
    """
    pairs = written(confusion(df, actual, predicted), "confusion")
    sides = pairs.select(
        F.explode(F.array(
            F.struct(F.col("actual").alias("label"), F.lit(True).alias("is_actual")),
            F.struct(F.col("predicted").alias("label"), F.lit(False).alias("is_actual")),
        )).alias("side"),
        "n", (F.col("actual") == F.col("predicted")).alias("hit"),
    ).select("side.*", "n", "hit")
    real, guessed = F.col("is_actual"), ~F.col("is_actual")
    tallies = sides.groupBy("label").agg(
        F.sum(F.when(real & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(real, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(guessed, F.col("n")).otherwise(0)).alias("guesses"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    per_class = tallies.select(
        F.col("label").cast("string").alias("label"),
        ratio(F.col("tp"), F.col("guesses")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        "support",
    ).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    measures = ["precision", "recall", "f1"]
    whole = per_class.agg(F.sum("support").alias("n")).scalar()
    weighted = per_class.withColumn("_w", F.col("support") / whole).agg(
        F.lit("weighted avg").alias("label"),
        *[F.sum(F.col(m) * F.col("_w")).alias(m) for m in measures], F.sum("support").alias("support"),
    )
    macro = per_class.agg(
        F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in measures],
        F.sum("support").alias("support"),
    )
    return per_class.select("label", *measures, "support").unionByName(macro).unionByName(weighted)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * n_c)`` from one count per class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    share = counts.agg((F.sum("n") / F.count("*")).alias("_share"))
    return counts.select(label, "n", (share.scalar() / F.col("n")).alias("weight"))


def with_class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Every labelled row with the balanced weight of its class; rows are not shuffled."""
    weights = small_side(class_weights(df, label).select(label, F.col("weight").alias(name)), "class_weights")
    return df.join(weights, label)
