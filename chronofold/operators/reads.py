"""Point, batch, prefix and range reads over tables keyed by ordinary columns.

All are filters, joins and ordered limits on raw key columns, so predicates and column lists reach
the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Keys of a batch read that are shipped to every executor at most; a longer list is joined by shuffle.
BROADCAST_KEYS = 100_000
OK, NOT_FOUND, TOO_SHORT = "OK", "KEY_NOT_FOUND", "TOO_SHORT_PAYLOAD"


def point_get(table: DataFrame, key: str, value, *columns: str) -> DataFrame:
    """The record of one key, in full or some columns of it."""
    found = table.where(F.col(key) == F.lit(value))
    return found.select(*columns) if columns else found


def batch_get(table: DataFrame, key: str, values: list, *columns: str) -> DataFrame:
    """A row per requested key, in order of ``pos``; keys may repeat; missing ones have status KEY_NOT_FOUND."""
    spark = table.sparkSession
    kind = table.schema[key].dataType.simpleString()
    wanted = spark.createDataFrame(list(enumerate(values)), f"pos long, want {kind}")
    right = table.select(F.col(key).alias("want"), *columns, F.lit(True).alias("_found"))
    if len(values) <= BROADCAST_KEYS:  # the list is bounded, the table is not: it is filtered before the join
        right = right.join(F.broadcast(wanted.select("want").distinct()), "want", "left_semi")
    out = wanted.join(right, "want", "left")
    status = F.when(F.col("_found"), OK).otherwise(NOT_FOUND)
    return out.select("pos", F.col("want").alias(key), *columns, status.alias("status"))


def partial_get(table: DataFrame, key: str, payload: str, offset: int, count: int) -> DataFrame:
    """A byte range of each payload, with TOO_SHORT_PAYLOAD where it ends before."""
    enough = F.octet_length(payload) >= offset + count
    return table.select(key, F.when(enough, F.substring(payload, offset + 1, count)).alias("part"), F.when(enough, OK).otherwise(TOO_SHORT).alias("status"))


def key_range(key: str, begin=None, end=None, begin_inclusive: bool = True, end_inclusive: bool = False) -> Column:
    """The predicate of a range; a bound that is None is open."""
    found = F.lit(True)
    if begin is not None:
        found = found & (F.col(key) >= begin if begin_inclusive else F.col(key) > begin)
    if end is not None:
        found = found & (F.col(key) <= end if end_inclusive else F.col(key) < end)
    return found


def range_scan(table: DataFrame, key: str, begin=None, end=None, *, forward: bool = True, begin_inclusive: bool = True, end_inclusive: bool = False) -> DataFrame:
    """Records of a key range in key order, forward or backward."""
    rows = table.where(key_range(key, begin, end, begin_inclusive, end_inclusive))
    return rows.orderBy(F.col(key).asc() if forward else F.col(key).desc())


def prefix_scan(table: DataFrame, column: str, prefix: str) -> DataFrame:
    """Records whose key begins with ``prefix``."""
    return table.where(F.col(column).startswith(prefix))


def scan_limit(table: DataFrame, key: str, start, n: int, *columns: str) -> DataFrame:
    """At most ``n`` records from ``start`` on, in key order: a top-n, no full sort."""
    rows = table.where(F.col(key) >= start)
    return (rows.select(*columns) if columns else rows).orderBy(key).limit(n)


def page_boundaries(table: DataFrame, key: str, pages: int, accuracy: int = 1 << 14) -> DataFrame:
    """(page, low): the least key of each of ``pages`` ranges of like size; no rows for a table without keys.

    A mergeable sketch puts a bound on either side of each boundary, the keys between bounds are counted, and only those of
    ranges that hold a boundary are ordered. The sketch decides how many these are, not the result.
    """
    cuts = [max(0.0, min(1.0, i / pages + side / accuracy)) for i in range(pages) for side in (-4, 4)]
    keys = table.select(F.col(key).alias("_key")).where("_key IS NOT NULL")
    bounds = keys.agg(F.percentile_approx("_key", F.array(*map(F.lit, cuts)), accuracy).alias("_bounds"))  # one row
    below = F.expr(" + ".join(f"int(_bounds[{i}] < _key)" for i in range(len(cuts))))
    ranged = keys.crossJoin(F.broadcast(bounds)).select("_key", below.alias("_range"))
    # a row for each range, then one for each page
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    counts = counts.select("_range", "_n", F.sum("_n").over(Window.orderBy("_range")).alias("_upto"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.expr(f"greatest((page * _all + {pages - 1}) div {pages}, 1L)")
    places = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page")).withColumn("_place", rank - F.col("_upto") + F.col("_n"))
    places = places.where("_place BETWEEN 1 AND _n").select("_range", "page", "_place")
    near = ranged.join(F.broadcast(places.select("_range").distinct()), "_range", "left_semi").groupBy("_range", "_key").agg(F.count("*").alias("_n"))
    near = near.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_range").orderBy("_key")))
    return near.join(F.broadcast(places), "_range").where("_place <= _upto AND _place > _upto - _n").select("page", F.col("_key").alias("low"))
