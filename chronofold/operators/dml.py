"""Writes as pure functions of a table: what is accepted, what is rejected, and the new state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_new(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is absent."""
    return incoming.join(base.select(key), key, "left_anti")


def insert_conflicts(base: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows that an insert rejects (key already exists)."""
    return incoming.join(base.select(key), key, "left_semi")


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The table without the given keys."""
    return base.join(keys.select(key), key, "left_anti")


def delete_missing(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keys that a delete rejects (key not found)."""
    return keys.select(key).join(base.select(key), key, "left_anti")


def last_of_each(incoming: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One incoming row a key: the last by ``order``, else the one with the largest values. Combined before the shuffle."""
    rest = [c for c in incoming.columns if c != key]
    image = F.struct(*([F.col(order).alias("_order")] if order else []), *rest)
    return incoming.groupBy(key).agg(F.max(image).alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def insert_outcomes(base: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows with status OK or KEY_ALREADY_EXISTS; of rows that repeat a key the first by ``order`` is taken."""
    first = incoming.groupBy(key).agg(F.min(order).alias("_first"))
    marked = incoming.join(first, key).join(base.select(key, F.lit(True).alias("_in_base")).distinct(), key, "left")
    ok = F.col("_in_base").isNull() & (F.col(order) == F.col("_first"))
    return marked.withColumn("status", F.when(ok, "OK").otherwise("KEY_ALREADY_EXISTS")).drop("_first", "_in_base")


def insert_keys(index: DataFrame, incoming: DataFrame, *key: str) -> DataFrame:
    """Records without a payload (index entries) that an insert adds: the incoming keys that are absent, each once."""
    return incoming.select(*key).distinct().join(index.select(*key), list(key), "left_anti")


def overwrite_outcomes(base: DataFrame, incoming: DataFrame, key: str, value: str, offset: int) -> DataFrame:
    """(key, value after, status) of overwrites of a part (column ``value`` of ``incoming``) at ``offset`` bytes: OK,
    KEY_NOT_FOUND, or TOO_SHORT_PAYLOAD where the part does not fit; one row an incoming key, its last."""
    old = base.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in_base"))
    both = last_of_each(incoming.select(key, value), key).join(old, key, "left")
    fits = F.octet_length("_old") >= offset + F.octet_length(value)
    status = F.when(F.col("_in_base").isNull(), "KEY_NOT_FOUND").when(F.coalesce(fits, F.lit(False)), "OK").otherwise("TOO_SHORT_PAYLOAD")
    after = F.when(status == "OK", F.overlay("_old", value, F.lit(offset + 1))).otherwise(F.col("_old"))
    return both.select(key, after.alias(value), status.alias("status"))


def upsert(base: DataFrame, incoming: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """The table after an upsert; op tells what became of each row: insert, overwrite (same length), update, keep.
    Of incoming rows that repeat a key the last by ``order`` counts, else the largest value."""
    incoming = last_of_each(incoming.select(key, value, *([order] if order else [])), key, order)
    old = base.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in_base"))
    new = incoming.select(key, F.col(value).alias("_new"), F.lit(True).alias("_given"))
    both = old.join(new, key, "full")
    op = (
        F.when(F.col("_given").isNull(), "keep")
        .when(F.col("_in_base").isNull(), "insert")
        .when(F.octet_length(F.col("_old").cast("string")) == F.octet_length(F.col("_new").cast("string")), "overwrite")
        .otherwise("update")
    )
    return both.select(key, F.when(F.col("_given"), F.col("_new")).otherwise(F.col("_old")).alias(value), op.alias("op"))


def overwrite(base: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """The table with the values of keys that exist replaced; others are not added. Of repeated keys the largest value counts."""
    incoming = last_of_each(incoming.select(key, value), key)
    new = incoming.select(key, F.col(value).alias("_new"), F.lit(True).alias("_given"))
    return base.join(new, key, "left").withColumn(value, F.when(F.col("_given"), F.col("_new")).otherwise(F.col(value))).drop("_new", "_given")


def overwrite_part(payload: Column, offset: int, part: Column) -> Column:
    """A string payload with ``part`` written over it from ``offset`` on; where the part does not fit, as it was."""
    fits = F.octet_length(payload) >= offset + F.octet_length(part)
    return F.when(fits, F.overlay(payload, part, F.lit(offset + 1))).otherwise(payload)


def range_update(base: DataFrame, where: Column, column: str, new: Column) -> DataFrame:
    """The table with ``column`` set to ``new`` in the rows of a range."""
    return base.withColumn(column, F.when(where, new).otherwise(F.col(column)))


def range_delete(base: DataFrame, where: Column) -> DataFrame:
    """The table without the rows of a range (rows for which the predicate is unknown stay)."""
    return base.where(~F.coalesce(where, F.lit(False)))


def range_increment(base: DataFrame, where: Column, column: str, by: Column) -> DataFrame:
    """The table with ``by`` added to ``column`` in the rows of a range."""
    return range_update(base, where, column, F.col(column) + by)
