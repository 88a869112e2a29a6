"""Building blocks that keep ordered and joined work split under any skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from postlens.session import written

BROADCAST_ROWS = 100_000
HEAVY_KEYS = 2_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counting stops one row later."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` fits; else leave the join to AQE."""
    return F.broadcast(df) if fits(df, max_rows) else df


def small_side(df: DataFrame, name: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """An aggregated side of a join with a large table, written once and then checked.

    Without the check the planner would estimate the aggregate by its input and
    shuffle the large table before learning how small this side is.
    """
    return broadcast_if_small(written(df, name), max_rows)


def unrolled(df: DataFrame, keys: Sequence[str], array: Column, place: str, name: str) -> DataFrame:
    """``(keys, place, name)``: one row per array element, none for empty arrays.

    The plain form of explode makes the optimizer test the array's size first and so
    compute it twice; the outer form with a filter after it does not.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias(place, name))
    return rows.where(F.col(place).isNotNull())


def split_count(df: DataFrame) -> int:
    """How many ordered ranges to cut: the shuffle width of the session, without an upper bound."""
    return max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_of(df: DataFrame, key: Column, measures: Sequence[str]) -> DataFrame:
    """Adds ``_range``: in which of the sampled key ranges a row falls.

    The range ends are the keys with the smallest hashes: a fixed-size, repeatable
    and even sample. They only spread the work; results do not depend on them.
    """
    # asking for the measures keeps the sampled input equal to the main input, so a
    # shuffle below both is run once
    ends = (
        df.na.drop(subset=list(measures))
        .select(key.alias("_k"))
        .orderBy(F.md5(F.col("_k").cast("string")), "_k")
        .limit(split_count(df))
        .agg(F.sort_array(F.collect_set("_k")).alias("_ends"))
    )
    # halving search for the number of ends below the key
    steps = [1 << i for i in reversed(range(split_count(df).bit_length()))]
    place = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda low, s: F.when(F.get("_ends", low + s - 1) < key, low + s).otherwise(low),
    )
    return df.withColumn("_ends", ends.scalar()).withColumn("_range", F.coalesce(place, F.lit(0))).drop("_ends")


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, Column],
    groups: Sequence[str] = (),
    bucket: Column | None = None,
    following: str | None = None,
) -> DataFrame:
    """Running sums (inclusive) per group along ``order``, never one task per group.

    A group is cut into ordered ranges. Range totals (one row per group and range)
    give each range its start value, and the window runs inside a range only.
    ``order`` must be unique within a group. ``bucket`` may state a cut that grows
    with ``order``; otherwise ranges are sampled from the data. ``following`` names
    a column to hold the next ``order`` value of the group.
    """
    groups = list(groups)
    valued = df.withColumns({f"_v_{name}": value for name, value in totals.items()})
    if bucket is None:
        key = F.struct(*groups, order) if groups else F.col(order)
        cut = _range_of(valued, key, [f"_v_{name}" for name in totals])
    else:
        cut = valued.withColumn("_range", bucket)
    keys = [*groups, "_range"]

    by_range = cut.groupBy(*keys).agg(
        *[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in totals], F.min(order).alias("_first")
    )
    across = Window.partitionBy(*groups).orderBy("_range") if groups else Window.orderBy("_range")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.select(
        *keys,
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in totals],
        F.lead("_first").over(across).alias("_next_first"),
    )
    inside = Window.partitionBy(*keys).orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = {n: F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(upto) for n in totals}
    if following:
        out[following] = F.coalesce(F.lead(order).over(inside), F.col("_next_first"))
    return cut.join(starts, keys).select(*df.columns, *[c.alias(n) for n, c in out.items()])


def with_position(df: DataFrame, order: str, name: str = "position",
                  groups: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """Zero-based place of every row along ``order`` (within ``groups``)."""
    placed = running_totals(df, order, {name: F.lit(1).cast("bigint")}, groups, bucket)
    return placed.withColumn(name, F.col(name) - 1)


def join_counted(fact: DataFrame, counted: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of ``fact`` with a table of its own key counts, safe for hot keys.

    Keys holding more than 1/HEAVY_KEYS of the fact rows number below HEAVY_KEYS
    whatever the data, so that side is broadcast and hot keys are never shuffled.
    The other keys are shuffled; none of them can fill a task.
    """
    whole = counted.agg(F.sum(count).alias("_all"))
    marked = counted.withColumn("_heavy", F.col(count) * HEAVY_KEYS > whole.scalar())
    heavy = marked.where("_heavy").drop("_heavy")
    light = marked.where(~F.col("_heavy")).drop("_heavy")
    hot = fact.join(F.broadcast(heavy), key)
    cold = fact.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(cold)


def first_per_group(df: DataFrame, group: str, order: Sequence[str], n: int,
                    rank: str = "step", salts: int = 64) -> DataFrame:
    """The first ``n`` rows of each group with their rank, whatever a group's size.

    Groups are first cut by a salt and limited there, so the last ranking sees at
    most ``salts * n`` rows of a group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    part = Window.partitionBy(group, "_salt").orderBy(*order)
    kept = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n).drop("_r", "_salt")
    whole = Window.partitionBy(group).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(whole)).where(F.col(rank) <= n)
