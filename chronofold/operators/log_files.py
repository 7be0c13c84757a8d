"""Checks of log files given as tables of their entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.neighbours import neighbour

MARKER = "EPOCH_MARKER"
#: Entries of these kinds belong to no storage.
NO_STORAGE = (MARKER, "FILLER")
ALIGNMENT = 4096
#: Bytes of a file whose markers share a window.
SPAN = 1 << 24


def read_part(entries: DataFrame) -> DataFrame:
    """Entries up to the first of their file without a length, where reading stops, with ``_first``: the file's first place."""
    ends = entries.groupBy("file").agg(F.min("at").alias("_first"), F.min(F.when(_empty(), F.col("at"))).alias("_stop"))
    return entries.join(ends, "file").where(F.col("_stop").isNull() | (F.col("at") <= F.col("_stop"))).drop("_stop")


def _empty() -> Column:
    return F.coalesce("length", F.lit(0)) == 0


def _kinds(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that a row breaks, as rows; a rule that is unknown is not broken."""
    return F.explode(F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules))))


def problems(entries: DataFrame, sizes: DataFrame, codes: list[str]) -> DataFrame:
    """(file, at, kind) of each rule that an entry or file breaks.

    ``entries``: file, at (its first byte), length, code, storage and, of epoch markers, old_epoch, new_epoch and
    marker_at; ``sizes``: file, size; ``codes``: the codes that exist. A marker's old epoch is held against the new
    one of the marker before it in the file. Null files are left out."""
    rows = read_part(entries).join(sizes, "file")
    is_marker = F.coalesce(F.col("code") == MARKER, F.lit(False))
    each = rows.select("file", "at", _kinds(
        ("MISSING_LOG_LENGTH", _empty()),
        ("INCOMPLETE_ENTRY_AT_END", F.col("at") + F.col("length") > F.col("size")),
        ("MISSING_LOG_TYPE_CODE", ~F.coalesce(F.col("code").isin(*codes), F.lit(False))),
        ("MISSING_STORAGE_ID", ~F.coalesce(F.col("code").isin(*NO_STORAGE), F.lit(False)) & (F.coalesce("storage", F.lit(0)) == 0)),
        ("NO_EPOCH_MARKER_AT_BEGINNING", (F.col("at") == F.col("_first")) & ~is_marker),
        ("INVALID_OLD_EPOCH", is_marker & (F.coalesce("old_epoch", F.lit(0)) == 0)),
        ("INVALID_NEW_EPOCH", is_marker & (F.coalesce("new_epoch", F.lit(0)) == 0)),
        ("EPOCH_MARKER_INCORRECT_OFFSET", is_marker & ~F.col("marker_at").eqNullSafe(F.col("at"))),
    ).alias("kind"))
    markers = neighbour(rows.where(is_marker).select("file", "at", "old_epoch", "new_epoch"), "file", ["at"], F.col("new_epoch"), span=SPAN)
    unlike = markers.where(F.col("_near").isNotNull() & ~F.col("_near.new_epoch").eqNullSafe(F.col("old_epoch")))
    ends = sizes.where(F.col("file").isNotNull() & (F.col("size") % ALIGNMENT != 0)).select("file", F.col("size").alias("at"), F.lit("NON_ALIGNED_FILE_END").alias("kind"))
    return each.unionByName(unlike.select("file", "at", F.lit("EPOCH_MARKER_DOES_NOT_MATCH").alias("kind"))).unionByName(ends)


def first_problems(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` problems by file and place, and a row TOO_MANY_INCONSISTENCIES where there are more (the tool's own option)."""
    order = ["file", "at", "kind"]
    more = found.orderBy(*order).limit(limit + 1).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    marker = more.select(*(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("file", "at")), F.lit("TOO_MANY_INCONSISTENCIES").alias("kind"))
    return found.orderBy(*order).limit(limit).unionByName(marker)
