"""Log inspection, consistency checks, conflict analysis and experiment summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.operators.neighbours import neighbour


def log_scan(log: DataFrame, begin: int | None = None, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Log rows of epochs begin <= epoch <= end in serial order, at most ``limit`` (the tool's own option)."""
    if begin is not None:
        log = log.where(F.col("epoch") >= begin)
    if end is not None:
        log = log.where(F.col("epoch") <= end)
    return log if limit is None else log.orderBy("epoch", "ordinal").limit(limit)


def extent(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("n"), F.min("epoch").alias("min_epoch"), F.max("epoch").alias("max_epoch"), F.min("ordinal").alias("min_ordinal"), F.max("ordinal").alias("max_ordinal"))


def epoch_marks(log: DataFrame) -> DataFrame:
    """(new_epoch, old_epoch) of each epoch that the log enters; one row an epoch is left to order."""
    w = Window.orderBy("new_epoch")
    return log.groupBy(F.col("epoch").alias("new_epoch")).agg(F.count("*").alias("n")).withColumn("old_epoch", F.lag("new_epoch").over(w))


def inconsistencies(log: DataFrame, writer: str) -> DataFrame:
    """Rows of a writer that break the log's rules: time going back, an epoch skipped, a repeated ordinal, a value out of range."""
    marked = neighbour(log, writer, ["ordinal"], F.col("epoch"), F.col("ordinal"))
    marked = marked.select(*log.columns, F.col("_near.epoch").alias("_epoch"), F.col("_near.ordinal").alias("_ordinal"))
    kind = (
        F.when(F.col("epoch") < F.col("_epoch"), "EPOCH_GOES_BACK")
        .when(F.col("ordinal") == F.col("_ordinal"), "ORDINAL_REPEATS")
        .when(F.col("epoch") > F.col("_epoch") + 1, "EPOCH_SKIPPED")
        .when(F.col("value").isNull() | (F.col("value") < 0), "VALUE_OUT_OF_RANGE")
    )
    return marked.withColumn("kind", kind).where("kind is not null").drop("_epoch", "_ordinal")


def occ_conflicts(observed: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Reads whose version is no longer the current one: they would abort at commit."""
    now = current.select(key, F.col(version).alias("current_version"))
    both = observed.select(key, F.col(version).alias("observed_version")).join(now, key, "left")
    return both.where(~F.col("observed_version").eqNullSafe(F.col("current_version")))


def page_versions(log: DataFrame, key: str, page: int, version: str) -> DataFrame:
    """(page, version) of each range of ``page`` keys: the last insert or delete in it, which is what a scan of the range depends on."""
    moves = log.where(F.col("op").isin("insert", "delete"))
    return moves.groupBy(F.floor(F.col(key) / page).cast("long").alias("page")).agg(F.max(version).alias(version))


def precommit(reads: DataFrame, versions: DataFrame, scans: DataFrame, pages: DataFrame, txn: str, key: str, version: str) -> DataFrame:
    """(txn, n_stale, n_phantom, outcome, commit_version) of each transaction at commit.

    ``reads`` (txn, key, version) are checked against the current ``versions`` (key, version), and the ranges of ``scans``
    (txn, page, version; version null where a range had none) against ``pages`` (page, version): a range whose version moved
    may hold phantoms. Any such row aborts; else the commit comes after the last version seen (0: nothing was)."""

    def checked(seen: DataFrame, current: DataFrame, on: str) -> DataFrame:
        both = seen.join(current.select(on, F.col(version).alias("_now")), on, "left")
        return both.select(txn, F.col(version).alias("_seen"), (~F.col(version).eqNullSafe(F.col("_now"))).cast("long").alias("_moved"))

    none = F.lit(0).cast("long")
    every = checked(reads, versions, key).withColumn("_phantom", none).unionByName(checked(scans, pages, "page").select(txn, "_seen", none.alias("_moved"), F.col("_moved").alias("_phantom")))
    done = every.groupBy(txn).agg(F.sum("_moved").alias("n_stale"), F.sum("_phantom").alias("n_phantom"), F.coalesce(F.max("_seen"), F.lit(0)).alias("_last"))
    ok = F.col("n_stale") + F.col("n_phantom") == 0
    return done.select(txn, "n_stale", "n_phantom", F.when(ok, "OK").otherwise("RACE_ABORT").alias("outcome"), F.when(ok, F.col("_last") + 1).alias("commit_version"))


def sparse_union(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """A row for each (table, key), with the value in the table's own column and null in the others."""
    parts = [t.select(F.col(key), F.col(value).alias(name)) for name, t in sorted(tables.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def extract_results(lines: DataFrame, text: str, tags: list[str]) -> DataFrame:
    """Values of <tag>value</tag> and name=value in text lines; the column of each tag is null where it is missing."""
    def find(tag: str):
        hit = F.regexp_extract(text, rf"<{tag}>([^<]*)</{tag}>|(?:^|[\s,]){tag}=([^\s,<]*)", 0)
        inner = F.coalesce(F.nullif(F.regexp_extract(text, rf"<{tag}>([^<]*)</{tag}>", 1), F.lit("")), F.nullif(F.regexp_extract(text, rf"(?:^|[\s,]){tag}=([^\s,<]*)", 1), F.lit("")))
        return F.when(hit != "", inner).alias(tag)

    return lines.select(*(c for c in lines.columns if c != text), *(find(t) for t in tags))


def summarize(runs: DataFrame, *by: str, value: str, failed: str) -> DataFrame:
    """Runs, failed runs, mean and population deviation of the others' values."""
    good = F.when(~F.col(failed), F.col(value))
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.sum(F.col(failed).cast("long")).alias("failed_runs"), F.round(F.avg(good), 4).alias("mean"), F.round(F.stddev_pop(good), 4).alias("stdev")
    )
