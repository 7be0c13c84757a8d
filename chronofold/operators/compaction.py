"""Compaction of change logs before they are composed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators.neighbours import neighbour


def compact_increments(log: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """Increments of one record and field merged into one (combined before the shuffle)."""
    return log.groupBy(*by).agg(F.sum(value).alias("total"), F.count("*").alias("merged"))


def compact_overwrites(log: DataFrame) -> DataFrame:
    """Overwrites (key, epoch, ordinal, begin, count) without those that the next one of the key covers."""
    nxt = neighbour(log, "key", ["epoch", "ordinal"], F.col("begin").alias("b"), (F.col("begin") + F.col("count")).alias("e"), after=True)
    covered = (F.col("_near.b") <= F.col("begin")) & (F.col("_near.e") >= F.col("begin") + F.col("count"))
    return nxt.where(~F.coalesce(covered, F.lit(False))).select(*log.columns)


def log_sort(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """The log in ranges of keys, each sorted by key, epoch and ordinal: sorted runs for composing."""
    keys = [F.col("key"), F.col("epoch"), F.col("ordinal")]
    ranged = log.repartitionByRange(partitions, *keys) if partitions else log.repartitionByRange(*keys)
    return ranged.sortWithinPartitions("key", "epoch", "ordinal")


def log_by_storage(log: DataFrame, storage: str) -> DataFrame:
    """Per storage: log rows, keys' extent and epochs."""
    return log.groupBy(storage).agg(F.count("*").alias("n"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("epoch").alias("min_epoch"), F.max("epoch").alias("max_epoch"))
