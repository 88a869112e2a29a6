"""Salary and experience levels: fitted centres, assignment, bands, decision tree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from postlens.constants import LEVELS_ENTRY
from postlens.functions.signals import experience_level, rupee_range
from postlens.operators.bands import band_cuts, band_of
from postlens.operators.scaling import small_side


def fit_centres(df: DataFrame, features: Sequence[str], k: int = 3, seed: int = 42) -> list[list[float]]:
    """Centres of a distributed k-means fit on complete rows, ordered by first feature.

    Cluster numbers of a fit are arbitrary; ordering makes 0 the lowest paid. Only
    the k centres reach the driver.
    """
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in features]).na.drop()
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(complete).select("_v")
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(vectors)
    return sorted([list(map(float, c)) for c in model.clusterCenters()])


def nearest(features: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre; the lower one on ties; null for incomplete rows."""
    options = []
    for i, centre in enumerate(centres):
        distance = reduce(
            lambda a, b: a + b, [(F.col(f) - F.lit(float(x))) * (F.col(f) - F.lit(float(x))) for f, x in zip(features, centre)]
        )
        options.append(F.struct(distance.alias("d"), F.lit(i).alias("i")))
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    best = F.least(*options) if len(options) > 1 else options[0]
    return F.when(complete, best["i"])


def assign_centres(df: DataFrame, features: Sequence[str], centres: Sequence[Sequence[float]],
                   name: str = "level_cluster") -> DataFrame:
    return df.withColumn(name, nearest(features, centres))


def level_names(cluster: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), cluster)


def zscore(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Standard scores by population deviation; 0 where a column does not vary."""
    stats = df.agg(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns
    ]).select(F.struct(*columns).alias("stats"))
    out = df.withColumn("_stats", stats.scalar())
    for c in columns:
        m, s = F.col(f"_stats.{c}.m"), F.col(f"_stats.{c}.s")
        out = out.withColumn(f"{c}{suffix}", F.when(s == 0, F.lit(0.0)).otherwise((F.col(c) - m) / s))
    return out.drop("_stats")


def _enough(df: DataFrame, features: Sequence[str], k: int) -> bool:
    """Whether there are ``k`` complete rows to fit on."""
    return df.select(*features).na.drop().limit(k).count() >= k


def kmeans_levels(df: DataFrame, features: Sequence[str] = ("salary", "experience"), k: int = 3, seed: int = 42,
                  names: Sequence[str] = LEVELS_ENTRY) -> DataFrame:
    """Adds ``level_cluster`` and ``job_level``; below k complete rows the level is unknown."""
    if not _enough(df, features, k):
        return df.withColumns({"level_cluster": F.lit(None).cast("int"), "job_level": F.lit("unknown")})
    assigned = assign_centres(df, features, fit_centres(df, features, k, seed))
    return assigned.withColumn("job_level", level_names(F.col("level_cluster"), names))


def kmeans_levels_scaled(df: DataFrame, features: Sequence[str] = ("salary", "experience"), k: int = 3,
                         seed: int = 42, names: Sequence[str] = LEVELS_ENTRY) -> DataFrame:
    """The same on standard scores; below k complete rows the columns are null."""
    if not _enough(df, features, k):
        return df.withColumns({"level_cluster": F.lit(None).cast("int"), "job_level": F.lit(None).cast("string")})
    scaled = zscore(df, features)
    axes = [f"{c}_z" for c in features]
    assigned = assign_centres(scaled, axes, fit_centres(scaled, axes, k, seed)).drop(*axes)
    return assigned.withColumn("job_level", level_names(F.col("level_cluster"), names))


def cluster_writeback(df: DataFrame, features: Sequence[str], names: Sequence[str],
                      centres: Sequence[Sequence[float]] | None = None, k: int = 3, seed: int = 42) -> DataFrame:
    """Level of complete rows; rows lacking a feature keep null, all rows stay.

    The assignment depends on the row alone, so no join back is needed. Below k
    complete rows every level is null.
    """
    if centres is None and not _enough(df, features, k):
        return df.withColumns({"level": F.lit(None).cast("int"), "level_name": F.lit(None).cast("string")})
    centres = centres or fit_centres(df, features, k, seed)
    assigned = assign_centres(df, features, centres, "level")
    return assigned.withColumn("level_name", level_names(F.col("level"), names))


def cluster_ranges(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Lowest and highest value of the row's cluster and their label, on every row.

    One row per cluster is joined back, so a dominant cluster is not gathered.
    """
    ranges = df.groupBy(cluster).agg(F.min(value).alias("range_min"), F.max(value).alias("range_max"))
    labelled = ranges.withColumn("salary_range", rupee_range(F.col("range_min"), F.col("range_max")))
    return df.join(small_side(labelled, "ranges"), cluster, "left")


def salary_bands(df: DataFrame, salary: str = "salary", k: int = 3) -> DataFrame:
    """Adds ``salary_band`` (0 is the lowest) and ``salary_range``; null below k rows with a salary.

    The bands are the best ones possible, so no start or seed enters them.
    """
    if not _enough(df, [salary], k):
        return df.withColumns({"salary_band": F.lit(None).cast("string"), "salary_range": F.lit(None).cast("string")})
    banded = df.withColumn("_band", band_of(F.col(salary), band_cuts(df, salary, k)))
    named = cluster_ranges(banded, "_band", salary)
    return named.withColumn("salary_band", F.concat(F.lit("Band "), F.col("_band"))).select(
        *df.columns, "salary_band", "salary_range"
    )


def cluster_centres(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """Mean of each feature per cluster: the centres behind a scatter plot."""
    return df.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features]
    )


def fit_experience_tree(df: DataFrame, salary: str = "salary", experience: str = "experience",
                        max_depth: int = 3, seed: int = 0) -> PipelineModel:
    """A tree trained on the rule of experience levels, from the rows' salary and experience."""
    ruled = df.withColumn("_rule", experience_level(F.col(experience)))
    index = StringIndexer(inputCol="_rule", outputCol="_y", stringOrderType="alphabetAsc").fit(ruled)
    assembler = VectorAssembler(inputCols=[salary, experience], outputCol="_v")
    tree = DecisionTreeClassifier(
        maxDepth=max_depth, seed=seed, featuresCol="_v", labelCol="_y", predictionCol="_p",
        probabilityCol="_pr", rawPredictionCol="_rp",
    ).fit(assembler.transform(index.transform(ruled)).select("_v", "_y"))
    return PipelineModel([assembler, tree, IndexToString(inputCol="_p", outputCol="experience_level", labels=index.labels)])


def experience_tree(df: DataFrame, salary: str = "salary", experience: str = "experience",
                    max_depth: int = 3, seed: int = 0) -> tuple[DataFrame, str]:
    """Levels predicted by a tree trained on the rule, and the tree's rules as text."""
    model = fit_experience_tree(df, salary, experience, max_depth, seed)
    levelled = model.transform(df.withColumn("_rule", experience_level(F.col(experience))))
    return levelled.select(*df.columns, "experience_level", F.col("_rule").alias("rule_level")), model.stages[1].toDebugString
