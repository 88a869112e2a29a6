"""The registered queries by key, each with its oracle SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


FEW_SPLITS = 4


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy per row, read by no fewer tasks than cores.

    A file of one row group is read by one task whatever its size. Only an input of up
    to four splits is dealt out, half a gigabyte at the usual split size; anything
    larger is never shuffled for this, however many cores there are.
    """
    df = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= min(FEW_SPLITS, cores - 1) else df
