"""Structured Streaming forms: append with epochs, windowed counts, and a continuous fold by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronofold.functions.keys import epoch_day
from chronofold.operators import log_fold


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New files of ``folder`` as a stream with an epoch column."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("epoch", epoch_day(F.col("ts")))


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a table partitioned by epoch and batch, so epoch ranges prune directories. Exactly once: a batch that
    runs again replaces its own directories only."""

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "batch").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throughput(stream: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events by time bucket and kind; rows later than a day (the grace epoch) are dropped by the watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every).alias("bucket"), "event_type").agg(F.count("*").alias("n"))


def continuous_fold(log: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """State folded batch by batch: each trigger composes the newest state with its log rows and writes the next.

    A batch that runs again overwrites its own state, which is computed from the one before it."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = None if batch_id == 0 else spark.read.parquet(f"{folder}/state={batch_id - 1}")
        log_fold.fold(batch, base).write.mode("overwrite").parquet(f"{folder}/state={batch_id}")

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(spark: SparkSession, path: str, earliest: int) -> list[int]:
    """Retention: drops the partitions of epochs before ``earliest`` from a table that ``append_sink`` writes; returns them.

    Only folders are listed and deleted, one an epoch; what a stream appends later to an expired epoch is expired by the next call."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = []
    for entry in files.listStatus(place):
        name = entry.getPath().getName()
        if name.startswith("epoch=") and name[6:].isdigit() and int(name[6:]) < earliest:
            files.delete(entry.getPath(), True)
            gone.append(int(name[6:]))
    return sorted(gone)
