"""Shared pieces of the named queries: tables as change logs, fixed epochs, a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions.keys import cents, epoch_day
from chronofold.session import table

#: Daily epochs of ``events`` (2024-01-01 is 19723): the snapshot's, and a range to scan.
SNAPSHOT, BEGIN, END = 19737, 19730, 19745

#: What each type of event does to its user's record.
OPS = {"signup": "insert", "click": "update", "view": "overwrite", "purchase": "increment", "error": "delete"}

#: The same in SQL; ``base`` queries of the oracles start from it.
LOG_SQL = """
log AS (SELECT user_id AS key, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'click' THEN 'update' WHEN 'view' THEN 'overwrite' WHEN 'purchase' THEN 'increment' ELSE 'delete' END AS op,
  CAST(round(value * 100) AS BIGINT) AS value, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch, event_id AS ordinal, event_type FROM events)
"""


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a change log: key user, value in cents, epoch the day, ordinal the event's id."""
    e = table(spark, sf_dir, "events")
    op = F.lit("delete")
    for kind, name in OPS.items():
        op = F.when(F.col("event_type") == kind, name).otherwise(op)
    return e.select(F.col("user_id").alias("key"), op.alias("op"), cents(F.col("value")).alias("value"), epoch_day(F.col("ts")).alias("epoch"), F.col("event_id").alias("ordinal"), "event_type")


class Registry:
    """Queries and oracles by name."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        def add(fn):
            self.queries[name or fn.__name__] = fn
            if sql:
                self.oracles[name or fn.__name__] = sql
            return fn

        return add
