"""Snapshots as directories of Parquet files with a small table of metadata, and text sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import log_fold


META = "snapshot_id long, base_epoch long, valid_until long, path string"


def write(state: DataFrame, folder: str, snapshot_id: int, base_epoch: int, valid_until: int) -> str:
    """Write one snapshot of (key, value, alive); a reader sees it once its metadata is there.

    Dead keys are kept, so that an increment after a delete finds them dead. A snapshot written again replaces its own."""
    path = f"{folder}/snapshot={snapshot_id}"
    state.write.mode("overwrite").parquet(path)
    meta = state.sparkSession.createDataFrame([(snapshot_id, base_epoch, valid_until, path)], META)
    meta.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata/id={snapshot_id}")
    return path


def latest(spark: SparkSession, folder: str) -> tuple[DataFrame, int] | None:
    """The newest snapshot and the epoch that it covers; None where the folder has none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/metadata")
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return None
    meta = spark.read.schema(META).json(f"{folder}/metadata")
    row = meta.agg(F.max_by(F.struct("path", "valid_until"), "snapshot_id").alias("r")).first()
    return (spark.read.parquet(row.r.path), row.r.valid_until) if row and row.r else None


def recover(spark: SparkSession, folder: str, log: DataFrame, durable: int) -> DataFrame:
    """State after a restart: the newest snapshot and the durable log after it."""
    found = latest(spark, folder)
    if found is None:
        return log_fold.fold(log_fold.upto(log, durable)).where("alive").select("key", "value")
    base, covered = found
    return log_fold.compose(base, log_fold.upto(log, durable, covered))


class NotDurable(ValueError):
    """A snapshot's epoch must be durable."""


class NotNewer(ValueError):
    """A snapshot's epoch must be after the previous one's."""


def due(now: float, last: float, previous: int, durable: int, *, wanted: int | None = None, every: float = 60.0) -> int | None:
    """The epoch to take a snapshot of: ``wanted`` at once, else the durable one when ``every`` seconds have passed; None: not yet."""
    if wanted is not None:
        if wanted > durable:
            raise NotDurable(f"{wanted} > {durable}")
        if wanted <= previous:
            raise NotNewer(f"{wanted} <= {previous}")
        return wanted
    return durable if now - last >= every and durable > previous else None


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A file of two numbers a line with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="x double, y double")


def read_corpus(spark: SparkSession, dictionary: str, counts: str) -> tuple[DataFrame, DataFrame]:
    """A word per line, and lines of (document, word, count)."""
    words = spark.read.text(dictionary).select(F.col("value").alias("word"))
    parts = F.split(F.trim("value"), r"\s+")
    tallies = spark.read.text(counts).select(*(parts[i].cast("long").alias(c) for i, c in enumerate(("doc", "word", "n"))))
    return words, tallies
