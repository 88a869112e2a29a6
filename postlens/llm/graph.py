"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postlens.session import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (columns ``u``, ``v``, any one type).

    The component is its smallest node. Every round links all larger neighbours of a
    node to its smallest neighbour, then all smaller ones, until nothing changes; the
    number of rounds grows with the logarithm of the longest path. Only minima are
    aggregated, so a node with many neighbours fills no task, and each round is
    written to the shared folder, so lost executors repeat at most one round.
    """
    both = F.col("u") != F.col("v")
    pairs = edges.where(both).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = written(pairs, name)
    state = _state(pairs)
    for _ in range(max_rounds):
        if not state[0]:
            break
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
        large = around.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        large = large.unionByName(least.where(F.col("_m") < F.col("u")).select("u", F.col("_m").alias("v"))).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(smallest, "u").where(F.col("v") != F.col("_m")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        pairs = written(small.unionByName(smallest.select("u", F.col("_m").alias("v"))).distinct(), name)
        before, state = state, _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
