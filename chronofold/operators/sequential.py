"""Append-only tables: epoch-range scans, retention, and snapshot plus delta."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PAYLOAD = 4032


class InvalidParameter(ValueError):
    """A truncation epoch that is no epoch or precedes the first."""


def scan(table: DataFrame, begin: int | None = None, end: int | None = None, *, truncated: int | None = None, node: tuple[str, int] | None = None) -> DataFrame:
    """Rows with begin <= epoch < end, none before ``truncated``, of one node where asked."""
    low = max((x for x in (begin, truncated) if x is not None), default=None)
    if low is not None:
        table = table.where(F.col("epoch") >= low)
    if end is not None:
        table = table.where(F.col("epoch") < end)
    return table if node is None else table.where(F.col(node[0]) == node[1])


def truncate(current: int | None, new: int, earliest: int = 1) -> int:
    """The truncation epoch after ``truncate(new)``: it never goes back."""
    if new < earliest:
        raise InvalidParameter(f"epoch {new} is before {earliest}")
    return new if current is None else max(current, new)


def snapshot_and_delta(snapshot: DataFrame, delta: DataFrame, snapshot_epoch: int) -> DataFrame:
    """All rows once: the snapshot, and of the delta only what came after it."""
    return snapshot.unionByName(delta.where(F.col("epoch") > snapshot_epoch))


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table with ``rows`` added."""
    return table.unionByName(rows, allowMissingColumns=True)


def checked(rows: DataFrame, payload: str) -> tuple[DataFrame, DataFrame]:
    """Rows that may be appended, and those refused, whose status says why: payloads of MAX_PAYLOAD bytes and more."""
    long = F.coalesce(F.octet_length(payload), F.lit(0)) >= MAX_PAYLOAD
    return rows.where(~long), rows.where(long).withColumn("status", F.lit("TOO_LONG_PAYLOAD"))


def ordered(rows: DataFrame, mode: str = "none", *, node: str = "node", core: str = "core", within: str = "ordinal") -> DataFrame:
    """Rows in an order mode: none, node_first (node, core, then time) or epoch (time first); range partitions, each sorted."""
    keys = {"none": [], "node_first": [node, core, "epoch", within], "epoch": ["epoch", within, node, core]}.get(mode)
    if keys is None:
        raise InvalidParameter(f"no such order: {mode}")
    keys = [k for k in keys if k in rows.columns]
    return rows.orderBy(*keys) if keys else rows
