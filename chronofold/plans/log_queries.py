"""The change log: folds, snapshots, compaction, inspection and conflicts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators import compaction, log_fold, log_tools
from chronofold.plans.common import BEGIN, END, LOG_SQL, SNAPSHOT, Registry, events_log
from chronofold.session import table
from chronofold.sources import snapshots

R = Registry()
query = R.query


def fold_sql(source: str, out: str = "state") -> str:
    """CTEs for the state (key, value, alive) after replaying the rows of ``source``."""
    return f"""
{out}_r AS (SELECT key, max(ordinal) FILTER (op IN ('insert', 'update', 'delete')) AS rs FROM {source} GROUP BY key),
{out}_o AS (SELECT l.key, any_value(rs) AS rs, max(op) FILTER (ordinal = rs) AS rop, max(value) FILTER (ordinal = rs) AS rval,
  max(ordinal) FILTER (op = 'overwrite' AND ordinal > coalesce(rs, -1)) AS os FROM {source} l JOIN {out}_r r ON l.key = r.key GROUP BY l.key),
{out} AS (SELECT o.key, any_value(coalesce(rop, '') <> 'delete') AS alive,
  CASE WHEN any_value(coalesce(rop, '')) = 'delete' THEN NULL ELSE
    CAST(coalesce(max(value) FILTER (ordinal = os), any_value(rval), 0) + coalesce(sum(value) FILTER (op = 'increment' AND ordinal > coalesce(os, rs, -1)), 0) AS BIGINT) END AS value
  FROM {source} l JOIN {out}_o o ON l.key = o.key GROUP BY o.key)"""


@query(f"WITH {LOG_SQL} SELECT key, CAST(sum(value) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM log WHERE op = 'increment' GROUP BY key")
def fold_increment(spark: SparkSession, d: str) -> DataFrame:
    return log_fold.fold_increments(events_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT key, arg_max(epoch, ordinal) AS epoch, max(ordinal) AS ordinal, arg_max(value, ordinal) AS value FROM log WHERE op = 'overwrite' GROUP BY key")
def fold_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return log_fold.fold_overwrites(events_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT key, epoch, ordinal, value AS added, CAST(sum(value) OVER (PARTITION BY key ORDER BY ordinal) AS BIGINT) AS after FROM log WHERE op = 'increment'")
def fold_increment_after(spark: SparkSession, d: str) -> DataFrame:
    return log_fold.increments_after(events_log(spark, d))


@query(f"WITH {LOG_SQL} SELECT key, arg_max(epoch, ordinal) AS epoch, max(ordinal) AS ordinal, arg_max(op, ordinal) AS op, arg_max(value, ordinal) AS value FROM log GROUP BY key")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    return log_fold.latest_version(events_log(spark, d))


@query(
    f"WITH {LOG_SQL}, x AS (SELECT * FROM log WHERE epoch > {SNAPSHOT}), "
    "r AS (SELECT key, max(ordinal) FILTER (op IN ('insert', 'update', 'delete')) AS rs, max(ordinal) FILTER (op IN ('overwrite', 'increment')) AS os FROM x GROUP BY key), "
    "s AS (SELECT r.key, rs, os, max(op) FILTER (ordinal = rs) AS rop FROM r JOIN x ON x.key = r.key GROUP BY ALL) "
    "SELECT key, key % 2 = 0 AS in_base, CASE WHEN rop IS NULL THEN '' WHEN rop = 'delete' THEN CASE WHEN key % 2 = 0 THEN 'D' ELSE '' END WHEN key % 2 = 0 THEN 'U' ELSE 'I' END "
    "|| CASE WHEN os IS NOT NULL AND coalesce(rop, '') <> 'delete' AND os > coalesce(rs, -1) THEN 'O' ELSE '' END AS form FROM s"
)
def log_normal_form(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    return log_fold.normal_form(log_fold.upto(log, after=SNAPSHOT), log.select("key").where("key % 2 = 0").distinct())


@query(f"WITH {LOG_SQL}, {fold_sql('log')} SELECT key, value FROM state WHERE alive")
def snapshot_compose(spark: SparkSession, d: str) -> DataFrame:
    """Composed twice, to the snapshot and to the end; the oracle replays once."""
    log = events_log(spark, d)
    # what is dead in the base stays dead until it is set again, so the base keeps it
    base = log_fold.fold(log_fold.upto(log, SNAPSHOT))
    return log_fold.compose(base, log_fold.upto(log, after=SNAPSHOT))


@query(f"WITH {LOG_SQL}, a AS (SELECT * FROM log WHERE op IN ('overwrite', 'increment')), {fold_sql('a')} SELECT CAST(range AS BIGINT) AS key, coalesce(value, 0) AS value FROM range((SELECT max(key) + 1 FROM a)) LEFT JOIN state ON key = range")
def snapshot_compose_array(spark: SparkSession, d: str) -> DataFrame:
    return log_fold.compose_array(None, events_log(spark, d).where(F.col("op").isin("overwrite", "increment")))


@query(f"WITH {LOG_SQL} SELECT epoch, CAST(count(*) AS BIGINT) AS n FROM log WHERE epoch > {SNAPSHOT} GROUP BY epoch")
def log_trim(spark: SparkSession, d: str) -> DataFrame:
    return log_fold.upto(events_log(spark, d), after=SNAPSHOT).groupBy("epoch").agg(F.count("*").alias("n"))


@query(f"WITH {LOG_SQL}, a AS (SELECT * FROM log WHERE epoch <= {END}), {fold_sql('a')} SELECT key, coalesce(value, -1) AS value, alive FROM state")
def recover_state(spark: SparkSession, d: str) -> DataFrame:
    """The base and the durable log after it; rows of later epochs were not durable."""
    log = log_fold.upto(events_log(spark, d), END)
    state = log_fold.fold(log_fold.upto(log, after=SNAPSHOT), log_fold.fold(log_fold.upto(log, SNAPSHOT)))
    return state.withColumn("value", F.coalesce("value", F.lit(-1)))


@query(f"WITH {LOG_SQL}, a AS (SELECT * FROM log WHERE epoch <= {SNAPSHOT}), {fold_sql('a')} SELECT key, coalesce(value, -1) AS value, alive FROM state")
def as_of_epoch(spark: SparkSession, d: str) -> DataFrame:
    """Time travel: the state at the snapshot's epoch."""
    state = log_fold.fold(log_fold.upto(events_log(spark, d), SNAPSHOT))
    return state.withColumn("value", F.coalesce("value", F.lit(-1)))


@query(f"WITH {LOG_SQL}, a AS (SELECT * FROM log WHERE epoch <= {END}), {fold_sql('a')} SELECT key, value FROM state WHERE alive")
def snapshot_write(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot written as files and read back with the log after it; the oracle replays the whole log."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="chronofold-")
    folder = f"{folder}/snapshots-{uuid.uuid4().hex}"
    log = events_log(spark, d)
    snapshots.write(log_fold.fold(log_fold.upto(log, SNAPSHOT)), folder, 1, 0, SNAPSHOT)
    return snapshots.recover(spark, folder, log, END)


_PARTS_SQL = f"{LOG_SQL}, p AS (SELECT key, ordinal, ordinal % 7 AS begin, substr(md5(CAST(ordinal AS VARCHAR)), 1, CAST(1 + ordinal % 5 AS INTEGER)) AS part FROM log WHERE op = 'overwrite'), "


@query(
    f"WITH {_PARTS_SQL} b AS (SELECT key, begin + i - 1 AS at, arg_max(substr(part, CAST(i AS INTEGER), 1), ordinal) AS c FROM (SELECT *, unnest(range(1, length(part) + 1)) AS i FROM p) GROUP BY ALL), "
    "g AS (SELECT key, unnest(range(0, 9)) AS at FROM (SELECT DISTINCT user_id AS key FROM events)) "
    "SELECT g.key, string_agg(coalesce(c, '.'), '' ORDER BY g.at) AS payload FROM g LEFT JOIN b ON b.key = g.key AND b.at = g.at GROUP BY g.key"
)
def fold_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of nine dots after overwrites of byte ranges; what reaches past the end is cut."""
    log = events_log(spark, d)
    part = F.expr("substring(md5(cast(ordinal as string)), 1, cast(1 + ordinal % 5 as int))")
    writes = log.where("op = 'overwrite'").select("key", "epoch", "ordinal", (F.col("ordinal") % 7).alias("begin"), part.alias("part"))
    return log_fold.fold_ranges(log.select("key", F.lit("." * 9).alias("payload")).distinct(), writes)


@query("SELECT user_id AS key, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS merged FROM events GROUP BY ALL")
def compact_increments(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compact_increments(events_log(spark, d), "key", "event_type")


_OVER = f"{LOG_SQL}, o AS (SELECT key, epoch, ordinal, ordinal % 7 AS begin, 1 + ordinal % 5 AS count FROM log WHERE op = 'overwrite')"


@query(f"WITH {_OVER} SELECT key, epoch, ordinal, begin, count FROM (SELECT *, lead(begin) OVER w AS b, lead(begin + count) OVER w AS e FROM o WINDOW w AS (PARTITION BY key ORDER BY ordinal)) WHERE NOT coalesce(b <= begin AND e >= begin + count, false)")
def compact_overwrites(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d).where("op = 'overwrite'")
    return compaction.compact_overwrites(log.select("key", "epoch", "ordinal", (F.col("ordinal") % 7).alias("begin"), (1 + F.col("ordinal") % 5).alias("count")))


@query(f"WITH {LOG_SQL} SELECT key, epoch, ordinal, op, value FROM log")
def log_sort(spark: SparkSession, d: str) -> DataFrame:
    return compaction.log_sort(events_log(spark, d)).select("key", "epoch", "ordinal", "op", "value")


@query(f"WITH {LOG_SQL} SELECT event_type AS storage, CAST(count(*) AS BIGINT) AS n, min(key) AS min_key, max(key) AS max_key, min(epoch) AS min_epoch, max(epoch) AS max_epoch FROM log GROUP BY event_type")
def log_by_storage(spark: SparkSession, d: str) -> DataFrame:
    return compaction.log_by_storage(events_log(spark, d).withColumnRenamed("event_type", "storage"), "storage")


@query(f"WITH {LOG_SQL} SELECT key, op, value, epoch, ordinal FROM log WHERE epoch BETWEEN {BEGIN} AND {END}")
def log_scan(spark: SparkSession, d: str) -> DataFrame:
    return log_tools.log_scan(events_log(spark, d), BEGIN, END).select("key", "op", "value", "epoch", "ordinal")


@query(f"WITH {LOG_SQL} SELECT CAST(count(*) AS BIGINT) AS n, min(epoch) AS min_epoch, max(epoch) AS max_epoch, min(ordinal) AS min_ordinal, max(ordinal) AS max_ordinal FROM log")
def log_extent(spark: SparkSession, d: str) -> DataFrame:
    return log_tools.extent(events_log(spark, d))


@query(
    f"WITH {LOG_SQL}, w AS (SELECT *, lag(epoch) OVER (PARTITION BY key ORDER BY ordinal) AS pe, lag(ordinal) OVER (PARTITION BY key ORDER BY ordinal) AS po FROM log) "
    "SELECT * FROM (SELECT key, epoch, ordinal, CASE WHEN epoch < pe THEN 'EPOCH_GOES_BACK' WHEN ordinal = po THEN 'ORDINAL_REPEATS' WHEN epoch > pe + 1 THEN 'EPOCH_SKIPPED' WHEN value IS NULL OR value < 0 THEN 'VALUE_OUT_OF_RANGE' END AS kind FROM w) WHERE kind IS NOT NULL"
)
def log_inconsistencies(spark: SparkSession, d: str) -> DataFrame:
    return log_tools.inconsistencies(events_log(spark, d), "key").select("key", "epoch", "ordinal", "kind")


@query(f"WITH {LOG_SQL} SELECT epoch AS new_epoch, CAST(count(*) AS BIGINT) AS n, coalesce(lag(epoch) OVER (ORDER BY epoch), -1) AS old_epoch FROM log GROUP BY epoch")
def log_epoch_marks(spark: SparkSession, d: str) -> DataFrame:
    return log_tools.epoch_marks(events_log(spark, d)).select("new_epoch", "n", F.coalesce("old_epoch", F.lit(-1)).alias("old_epoch"))


@query(
    f"WITH {LOG_SQL}, o AS (SELECT key, max(ordinal) AS v FROM log WHERE epoch <= {SNAPSHOT} GROUP BY key), c AS (SELECT key, max(ordinal) AS v FROM log WHERE epoch <= {SNAPSHOT + 1} GROUP BY key) "
    "SELECT o.key, o.v AS observed_version, c.v AS current_version FROM o JOIN c ON o.key = c.key WHERE o.v <> c.v"
)
def occ_conflicts(spark: SparkSession, d: str) -> DataFrame:
    log = events_log(spark, d)
    observed, current = (log_fold.latest_version(log_fold.upto(log, e)) for e in (SNAPSHOT, SNAPSHOT + 1))
    return log_tools.occ_conflicts(observed, current, "key", "ordinal")


_PAGE = 16


@query(
    f"WITH {LOG_SQL}, o AS (SELECT key, max(ordinal) AS v FROM log WHERE epoch <= {SNAPSHOT} GROUP BY key), c AS (SELECT key, max(ordinal) AS v FROM log WHERE epoch <= {SNAPSHOT + 1} GROUP BY key), "
    f"m AS (SELECT key // {_PAGE} AS page, max(ordinal) FILTER (epoch <= {SNAPSHOT}) AS v, max(ordinal) FILTER (epoch <= {SNAPSHOT + 1}) AS now FROM log WHERE op IN ('insert', 'delete') GROUP BY page) "
    f"SELECT key, CAST(stale AS BIGINT) AS n_stale, CAST(moved AS BIGINT) AS n_phantom, CASE WHEN stale + moved = 0 THEN 'OK' ELSE 'RACE_ABORT' END AS outcome, CASE WHEN stale + moved = 0 THEN greatest(seen, coalesce(page_seen, 0)) + 1 END AS commit_version "
    f"FROM (SELECT o.key, o.v AS seen, m.v AS page_seen, CASE WHEN o.v <> c.v THEN 1 ELSE 0 END AS stale, CASE WHEN m.v IS DISTINCT FROM m.now THEN 1 ELSE 0 END AS moved FROM o JOIN c ON c.key = o.key LEFT JOIN m ON m.page = o.key // {_PAGE})"
)
def precommit(spark: SparkSession, d: str) -> DataFrame:
    """A transaction for each key at the snapshot, which read it and scanned its range, and commits an epoch later."""
    log = events_log(spark, d)
    then, now = log_fold.upto(log, SNAPSHOT), log_fold.upto(log, SNAPSHOT + 1)
    seen = log_fold.latest_version(then).select("key", "ordinal")
    reads = seen.select(F.col("key").alias("txn"), "key", "ordinal")
    pages = log_tools.page_versions(then, "key", _PAGE, "ordinal")
    scans = seen.select(F.col("key").alias("txn"), F.floor(F.col("key") / _PAGE).cast("long").alias("page")).join(pages, "page", "left")
    done = log_tools.precommit(reads, log_fold.latest_version(now), scans, log_tools.page_versions(now, "key", _PAGE, "ordinal"), "txn", "key", "ordinal")
    return done.withColumnRenamed("txn", "key")


@query("SELECT s_nationkey AS k, CAST(NULL AS DOUBLE) AS customers, CAST(count(*) AS DOUBLE) AS suppliers FROM supplier GROUP BY k UNION ALL SELECT c_nationkey, CAST(count(*) AS DOUBLE), NULL FROM customer GROUP BY 1")
def tsv_sparse_union(spark: SparkSession, d: str) -> DataFrame:
    tallies = {name: table(spark, d, t).groupBy(F.col(k).alias("k")).agg(F.count("*").cast("double").alias("n")) for name, t, k in (("customers", "customer", "c_nationkey"), ("suppliers", "supplier", "s_nationkey"))}
    return log_tools.sparse_union(tallies, "k", "n")


_LINES = "SELECT event_id, '<processed>' || CAST(event_id * 3 AS VARCHAR) || '</processed> mtps=' || CAST(user_id AS VARCHAR) || ', props=' || replace(props, ' ', '') AS line FROM events"


@query(f"SELECT event_id, regexp_extract(line, '<processed>([^<]*)</processed>', 1) AS processed, regexp_extract(line, 'mtps=([^,]*)', 1) AS mtps, CAST(NULL AS VARCHAR) AS missing FROM ({_LINES})")
def summary_extract(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("<processed>"), (F.col("event_id") * 3).cast("string"), F.lit("</processed> mtps="), F.col("user_id").cast("string"), F.lit(", props="), F.replace("props", F.lit(" "), F.lit("")))
    return log_tools.extract_results(table(spark, d, "events").select("event_id", line.alias("line")), "line", ["processed", "mtps", "missing"])


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS runs, CAST(count(*) FILTER (user_id % 10 = 0) AS BIGINT) AS failed_runs, round(avg(value) FILTER (user_id % 10 <> 0), 4) AS mean, round(stddev_pop(value) FILTER (user_id % 10 <> 0), 4) AS stdev FROM events GROUP BY event_type")
def summary_stats(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").withColumn("failed", F.col("user_id") % 10 == 0)
    return log_tools.summarize(runs, "event_type", value="value", failed="failed")


@query("SELECT user_id % 8 AS worker, CAST(count(*) AS BIGINT) AS processed, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS aborted, count(*) / 2592000.0 / 1e6 AS mtps FROM events GROUP BY worker UNION ALL SELECT -1, count(*), count(*) FILTER (event_type = 'error'), count(*) / 2592000.0 / 1e6 FROM events")
def bench_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per worker and, as worker -1, in all, over the thirty days."""
    events = table(spark, d, "events").select((F.col("user_id") % 8).alias("worker"), (F.col("event_type") == "error").cast("long").alias("bad"))
    sums = events.rollup("worker").agg(F.count("*").alias("processed"), F.sum("bad").alias("aborted"), F.grouping("worker").alias("all"))
    return sums.select(F.when(F.col("all") == 1, -1).otherwise(F.col("worker")).cast("long").alias("worker"), "processed", "aborted", (F.col("processed") / 2592000.0 / 1e6).alias("mtps"))


@query("SELECT CAST(epoch(date_trunc('hour', CAST(ts AS TIMESTAMP))) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS aborted FROM events GROUP BY bucket")
def bucket_throughput(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sums = events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("aborted"))
    return sums.select(F.unix_timestamp("w.start").alias("bucket"), "n", "aborted")
