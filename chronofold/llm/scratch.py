"""Written tables that cut lineage, in the shared folder of spark.checkpoint.dir, and joins for hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in HOT_SHARE of the rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only where none is set, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="chronofold-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


class Scratch:
    """Tables of one run; ``drop`` removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/chronofold-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        """``df`` computed once, written, and read back; it survives lost executors."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        gc.collect()  # and the driver's own, after which Spark removes the shuffle files of what went before
        self.spark._jvm.System.gc()
        made = self.spark.read.schema(df.schema).parquet(path)
        made.scratch_path = path
        return made

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def join_hot(rows: DataFrame, found: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found`` (one row per key, ``count``: the rows that have it), hot keys by broadcast.

    Hot keys are those with more than total / HOT_SHARE rows; there are at most HOT_SHARE of them, so
    their side has a bound. The other keys' groups are small and go by shuffle. ``how``: inner or left."""
    hot = found.where(F.col(count) * HOT_SHARE > total)
    cold = found.where(F.col(count) * HOT_SHARE <= total)
    by_broadcast = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return by_broadcast.unionByName(rest)
