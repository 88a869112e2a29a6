"""Operators that need the place of a row in an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from postlens.constants import STUB_CONFIDENCE, TRADE_LABELS
from postlens.operators.scaling import first_per_group, fits, small_side, with_position
from postlens.session import written


def round_robin_label(df: DataFrame, order: str, labels: Sequence[str] = TRADE_LABELS,
                      confidence: float = STUB_CONFIDENCE) -> DataFrame:
    """Label i mod n for the i-th row along a unique order column."""
    names = F.array(*[F.lit(x) for x in labels])
    placed = with_position(df, order, "_i")
    return placed.select(
        *df.columns,
        F.element_at(names, (F.col("_i") % len(labels)).cast("int") + 1).alias("category"),
        F.lit(float(confidence)).alias("confidence"),
    )


def code_table(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """Codes of the sorted distinct values over all given frames, written once."""
    values = frames[0].select(column)
    for frame in frames[1:]:
        values = values.unionByName(frame.select(column))
    distinct = written(values.where(F.col(column).isNotNull()).distinct(), "categories")
    if fits(distinct):
        code = F.row_number().over(Window.orderBy(column)).cast("bigint") - 1
        return F.broadcast(distinct.withColumn("code", code))
    return small_side(with_position(distinct, column, "code"), "codes")


def category_codes(df: DataFrame, column: str, codes: DataFrame | None = None,
                   name: str = "category_encoded") -> DataFrame:
    """Code of each value, -1 for null; pass ``codes`` to share them between frames."""
    codes = code_table([df], column) if codes is None else codes
    coded = df.join(codes, column, "left")
    return coded.select(*df.columns, F.coalesce("code", F.lit(-1)).cast("int").alias(name))


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.2, seed: int = 42,
                     cut_digits: int = 3) -> DataFrame:
    """Adds ``is_test``: exactly ``round(share * n_c)`` rows of each class.

    Rows of a class are ranked by the hash of key and seed, on the key and label alone;
    the leading hash digits cut a class into even ranges, so a dominant class is ranked
    by many tasks. The last test row of each class is a threshold the whole rows are
    compared with, so wide rows are never shuffled.
    """
    # the key breaks the practically impossible tie of two hashes
    place = F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))).alias("h"), F.col(key).alias("k"))
    labelled = df.where(F.col(label).isNotNull())
    narrow = labelled.select(label, place.alias("_order"))
    placed = with_position(narrow, "_order", "_i", [label], F.substring("_order.h", 1, cut_digits))
    sizes = narrow.groupBy(label).agg(F.round(F.count("*") * share).cast("bigint").alias("_take"))
    last = placed.join(sizes, label).where(F.col("_i") == F.col("_take") - 1).select(label, F.col("_order").alias("_last"))
    thresholds = small_side(last, "split_thresholds")
    # a class too small for a test row has no threshold
    return labelled.join(thresholds, label, "left").select(
        *df.columns, F.coalesce(place <= F.col("_last"), F.lit(False)).alias("is_test")
    )


def episode_rollup(log: DataFrame, episode: str, order: Sequence[str], reward: str, success: str,
                   extracted: str, max_steps: int | None = None) -> DataFrame:
    """Reward, steps and extractions per episode, up to its first success.

    ``success`` and ``extracted`` are boolean columns; ``order`` is unique within an
    episode. All rows of an episode count unless ``max_steps`` states a limit. The
    first successes are one aggregate and the sums another, so an episode of any
    length is combined before the shuffle.
    """
    steps = log if max_steps is None else first_per_group(log, episode, order, max_steps)
    steps = steps.withColumn("_at", F.struct(*order))
    first = steps.where(F.col(success)).groupBy(episode).agg(F.min("_at").alias("_first"))
    upto = F.col("_first").isNull() | (F.col("_at") <= F.col("_first"))
    return steps.join(first, episode, "left").where(upto).groupBy(episode).agg(
        F.sum(reward).alias("total_reward"), F.count("*").alias("steps"),
        F.count_if(F.col(extracted)).alias("extracted"), F.max(success).alias("succeeded"),
    )
