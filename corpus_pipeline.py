"""A training-data pipeline over ``documents``: toxic texts go, common lines are cut from later documents,
one document of each near-duplicate group stays, benchmark passages go, and what is left is packed.

Each stage takes (spark, docs, sf_dir), with ``docs`` what the stage before has kept; ``run`` writes
each stage's rows in the shared folder and reads them again. All but the last return the columns of
``documents``; ``n_chars`` follows the text. Null and empty texts pass every stage and are packed as their
end id; rows with a null or repeated ``doc_id`` are judged each (the second stage neither cuts nor compares
rows without an id); extra columns are kept until the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from chronofold.llm.scratch import Scratch


def _sized(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine does not reject."""
    machine = toxicity.learn(docs, toxicity.training_labels(spark, sf_dir))
    return toxicity.reject(docs, machine)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those of which nothing is left go."""
    return _sized(line_dedup.cut(docs, drop_emptied=True))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 0.8 of the shingles of five words."""
    return ngram_join.one_of_each(docs, shingle=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold much of the benchmark, and without shorter passages of it."""
    return _sized(decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in windows of near-equal fill."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("ngram_join", near_copies), ("decontamination", benchmark), ("packing", pack)]

#: SQL cannot express the stages; the tests hold ``run`` against plain versions of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
