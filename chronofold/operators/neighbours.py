"""The row before or after each row of its key, without a window over all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the order's last column that one window spans, so at most so many rows where they are unique.
SPAN = 1 << 16


def neighbour(rows: DataFrame, key: str, order: list[str], *columns: Column, after: bool = False, span: int = SPAN) -> DataFrame:
    """``rows`` with a struct ``_near`` of ``columns`` of the row before (``after``: after) each one of its key, by
    ``order``, whose last column is an integer; null at the ends. Null keys are one key; ties stand in any order.

    Rows are cut in spans of the order; a span's rows share a window, and of a whole key only the spans' edges do."""
    *first, last = order
    span_of = F.struct(*(F.col(c) for c in first), F.expr(f"`{last}` div {span}").alias("_div"))
    cut = rows.withColumn("_at", F.struct(F.col(key).alias("_key"), span_of.alias("_span"))).withColumn("_row", F.struct(*columns))
    place = F.struct(*order)
    edge = (F.min_by if after else F.max_by)("_row", place)
    edges = cut.groupBy("_at").agg(edge.alias("_edge"))
    move = F.lead if after else F.lag
    beyond = edges.withColumn("_beyond", move("_edge").over(Window.partitionBy("_at._key").orderBy("_at._span"))).select("_at", "_beyond")
    near = cut.withColumn("_near", move("_row").over(Window.partitionBy("_at").orderBy(*order)))
    return near.join(beyond, "_at").withColumn("_near", F.coalesce("_near", "_beyond")).drop("_at", "_row", "_beyond")
