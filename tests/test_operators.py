"""Error outcomes, boundaries, plans and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from chronofold.functions import keys
from chronofold.operators import catalog, compaction, dml, log_files, log_tools, neighbours, procedures, reads, sequential
from chronofold.plans.common import events_log
from chronofold.session import table
from chronofold.sources import snapshots
from chronofold.streaming import epochs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_catalog_errors():
    schema = StructType([StructField("k", LongType())])
    c = catalog.Catalog()
    first = c.create("a", "hash", schema)
    with pytest.raises(catalog.AlreadyExists):
        c.create("a", "array", schema)
    with pytest.raises(catalog.NameEmpty):
        c.create("", "array", schema)
    with pytest.raises(catalog.NameTooLong):
        c.create("x" * 61, "array", schema)
    c.drop("a")
    assert not c.exists("a")
    with pytest.raises(catalog.NotFound):
        c.get("a")
    assert c.create("a", "hash", schema).id != first.id


@pytest.mark.parametrize("begin_in, end_in, expected", [(True, False, [3, 4]), (False, False, [4]), (True, True, [3, 4, 5]), (False, True, [4, 5])])
def test_range_bounds(spark, begin_in, end_in, expected):
    t = spark.range(10).withColumnRenamed("id", "k")
    fwd = [r.k for r in reads.range_scan(t, "k", 3, 5, begin_inclusive=begin_in, end_inclusive=end_in).collect()]
    bwd = [r.k for r in reads.range_scan(t, "k", 3, 5, forward=False, begin_inclusive=begin_in, end_inclusive=end_in).collect()]
    assert fwd == expected and bwd == expected[::-1]
    assert reads.range_scan(t, "k").count() == 10 and reads.range_scan(t, "k", 5, 5).count() == 0


def test_batch_get_order_and_duplicates(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    got = [tuple(r) for r in reads.batch_get(t, "k", [2, 9, 2, 1], "v").orderBy("pos").collect()]
    assert got == [(0, 2, "b", "OK"), (1, 9, None, "KEY_NOT_FOUND"), (2, 2, "b", "OK"), (3, 1, "a", "OK")]


def test_filters_reach_the_scan(spark, small):
    text = plan(reads.scan_limit(table(spark, small, "orders"), "o_orderkey", 500, 20, "o_orderkey"))
    assert "GreaterThanOrEqual(o_orderkey,500)" in text and "TakeOrderedAndProject" in text
    assert "ReadSchema: struct<o_orderkey:bigint>" in text


def test_dml(spark):
    base = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, None)], "k long, v string")
    new = spark.createDataFrame([(2, "cc"), (3, "x"), (4, "dd")], "k long, v string")
    got = {r.k: (r.v, r.op) for r in dml.upsert(base, new, "k", "v").collect()}
    assert got == {1: ("aa", "keep"), 2: ("cc", "overwrite"), 3: ("x", "update"), 4: ("dd", "insert")}
    assert [r.k for r in dml.insert_new(base, new, "k").collect()] == [4]
    assert sorted(r.k for r in dml.insert_conflicts(base, new, "k").collect()) == [2, 3]
    assert [r.k for r in dml.delete_keys(base, new, "k").collect()] == [1]
    assert [r.k for r in dml.delete_missing(base, new, "k").collect()] == [4]


def test_truncate_and_epochs(spark):
    assert sequential.truncate(5, 3) == 5 and sequential.truncate(5, 8) == 8
    with pytest.raises(sequential.InvalidParameter):
        sequential.truncate(None, 0)
    t = spark.createDataFrame([(e, i) for i, e in enumerate([1, 1, 2, 3, 3, 4])], "epoch long, id long")
    assert sequential.scan(t, 2, 4).count() == 3
    assert sequential.scan(t, 1, 4, truncated=3).count() == 2
    both = sequential.snapshot_and_delta(sequential.scan(t, end=3), sequential.scan(t, 2), 2)
    assert both.count() == 6
    long = spark.createDataFrame([("x" * 4032,), ("y",)], "p string")
    fine, refused = sequential.checked(long, "p")
    assert fine.count() == 1 and [r.status for r in refused.collect()] == ["TOO_LONG_PAYLOAD"] * (long.count() - 1)


def test_wrap_and_keys(spark):
    row = spark.range(1).select(
        keys.wrap(F.lit(200), 8).alias("a"), keys.wrap(F.lit(-1), 8, signed=False).alias("b"),
        keys.combine([F.lit(3), F.lit(7), F.lit(42)], [10, 3000]).alias("c"), keys.last_name(F.lit(371)).alias("d"),
    ).first()
    assert (int(row.a), int(row.b), row.c, row.d) == (-56, 255, (3 * 10 + 7) * 3000 + 42, "OUGHTCALLYPRI")


def test_compact_overwrites(spark):
    rows = [(1, 1, 1, 0, 4), (1, 1, 2, 0, 8), (1, 1, 3, 2, 2), (2, 1, 4, 0, 4), (2, 1, 5, 1, 4)]
    got = compaction.compact_overwrites(spark.createDataFrame(rows, "key long, epoch long, ordinal long, begin long, count long"))
    assert sorted(r.ordinal for r in got.collect()) == [2, 3, 4, 5]


def test_inconsistencies(spark):
    rows = [(1, 1, 1, 5), (1, 2, 2, 5), (1, 1, 3, 5), (1, 4, 4, 5), (1, 4, 4, 5), (1, 4, 5, -1)]
    got = log_tools.inconsistencies(spark.createDataFrame(rows, "w long, epoch long, ordinal long, value long"), "w")
    assert sorted(r.kind for r in got.collect()) == ["EPOCH_GOES_BACK", "EPOCH_SKIPPED", "ORDINAL_REPEATS", "VALUE_OUT_OF_RANGE"]


def test_snapshot_round_trip(spark, small, tmp_path):
    log = events_log(spark, small)
    from chronofold.operators import log_fold

    for snapshot in (19737, 19740, 19740):  # the last is written again
        snapshots.write(log_fold.fold(log_fold.upto(log, snapshot)), str(tmp_path), snapshot, 0, snapshot)
    got = {r.key: r.value for r in snapshots.recover(spark, str(tmp_path), log, 99999).collect()}
    assert got == {r.key: r.value for r in log_fold.fold(log).where("alive").collect()}
    assert snapshots.recover(spark, str(tmp_path / "none"), log, 99999).count() == len(got)
    assert spark.read.json(str(tmp_path / "metadata")).count() == 2


def test_deleted_keys_stay_dead(spark, tmp_path):
    from chronofold.operators import log_fold

    log = spark.createDataFrame([(1, "insert", 7, 1, 1), (1, "delete", 0, 2, 2), (1, "increment", 5, 4, 3)], "key long, op string, value long, epoch long, ordinal long")
    snapshots.write(log_fold.fold(log_fold.upto(log, 3)), str(tmp_path), 1, 0, 3)
    assert snapshots.recover(spark, str(tmp_path), log, 9).count() == 0


def test_snapshot_trigger():
    assert snapshots.due(100, 50, 3, 9) is None and snapshots.due(100, 40, 3, 9) == 9 and snapshots.due(100, 0, 9, 9) is None
    assert snapshots.due(0, 0, 3, 9, wanted=5) == 5
    with pytest.raises(snapshots.NotDurable):
        snapshots.due(0, 0, 3, 9, wanted=10)
    with pytest.raises(snapshots.NotNewer):
        snapshots.due(0, 0, 3, 9, wanted=3)


def test_repeated_incoming_keys(spark):
    base = spark.createDataFrame([(1, "aa")], "k long, v string")
    new = spark.createDataFrame([(1, "bb", 1), (1, "ba", 2), (2, "c", 1), (2, "d", 0)], "k long, v string, o long")
    assert {r.k: (r.v, r.op) for r in dml.upsert(base, new, "k", "v", "o").collect()} == {1: ("ba", "overwrite"), 2: ("c", "insert")}
    assert {r.k: r.v for r in dml.overwrite(base, new, "k", "v").collect()} == {1: "bb"}
    assert sorted((r.k, r.o, r.status) for r in dml.insert_outcomes(base, new, "k", "o").collect()) == [(1, 1, "KEY_ALREADY_EXISTS"), (1, 2, "KEY_ALREADY_EXISTS"), (2, 0, "OK"), (2, 1, "KEY_ALREADY_EXISTS")]
    parts = spark.createDataFrame([("abcd", "XYZ")], "p string, x string").select(dml.overwrite_part(F.col("p"), 4, F.col("x")).alias("long"), dml.overwrite_part(F.col("p"), 1, F.col("x")).alias("fits"))
    assert tuple(parts.first()) == ("abcd", "aXYZ")


def test_keys_beyond_doubles(spark):
    big = spark.createDataFrame([((1 << 53) + 1,)], "k long")
    assert tuple(big.select(*keys.extract(F.col("k"), [1])).first()) == ((1 << 53) + 1, 0)
    state = 12345
    from chronofold.functions import random as draws

    row = spark.range(1).select(F.lit(state).cast("decimal(20,0)").alias("s")).select(draws.following(F.col("s")).alias("a"), draws.following(draws.following(F.col("s"))).alias("b"), draws.drawn(F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")).alias("c")).first()
    step = lambda x: (x * 0xD04C3175 + 0x53DA9022) % (1 << 64)
    assert (int(row.a), int(row.b), row.c) == (step(state), step(step(state)), 0)


def test_log_is_sorted(spark, small):
    log = compaction.log_sort(events_log(spark, small), 5)
    rows = log.select(F.spark_partition_id().alias("run"), "key", "epoch", "ordinal").collect()
    assert [tuple(r)[1:] for r in rows] == sorted(tuple(r)[1:] for r in rows) and len({r.run for r in rows}) > 1


def test_order_modes(spark):
    rows = spark.createDataFrame([(2, 1, 5, 1), (1, 2, 9, 2), (1, 1, 7, 3), (1, 2, 3, 4)], "node long, core long, epoch long, ordinal long")
    assert [r.ordinal for r in sequential.ordered(rows, "node_first").collect()] == [3, 4, 2, 1]
    assert [r.ordinal for r in sequential.ordered(rows, "epoch").collect()] == [4, 1, 3, 2]
    with pytest.raises(sequential.InvalidParameter):
        sequential.ordered(rows, "other")


def test_procedures(spark):
    made = procedures.Procedures()
    made.register("one", lambda s, n: s.range(n))
    for name, error in (("one", procedures.ProcedureAlreadyExists), ("", procedures.ProcedureNameTooLong), ("x" * 61, procedures.ProcedureNameTooLong)):
        with pytest.raises(error):
            made.register(name, lambda s: s.range(1))
    made.start()
    with pytest.raises(procedures.RegistryStarted):
        made.register("two", lambda s: s.range(1))
    made.register_local(3, "one", lambda s, n: s.range(2 * n))
    assert made.run(spark, "one", 2).count() == 2 and made.run(spark, "one", 2, node=3).count() == 4
    with pytest.raises(procedures.ProcedureNotFound):
        made.find("none")


def test_streams_go_on(spark, tmp_path):
    """A second file after a restart, late rows, retention."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        spark.createDataFrame([(i, datetime.fromisoformat(ts), u, "view", v) for i, ts, u, v in rows], schema).coalesce(1).write.mode("append").parquet(source)
        stream = epochs.read_events(spark, source, schema)
        epochs.append_sink(stream, out, str(tmp_path / "c1")).awaitTermination()
        log = stream.select(F.col("user_id").alias("key"), F.lit("increment").alias("op"), F.col("value").cast("long").alias("value"), "epoch", F.col("event_id").alias("ordinal"))
        epochs.continuous_fold(log, str(tmp_path / "state"), str(tmp_path / "c2")).awaitTermination()
        epochs.throughput(stream).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "hours")).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()

    arrive((1, "2024-01-01 10:00:00", 1, 5.0), (2, "2024-01-05 10:00:00", 2, 7.0))
    arrive((3, "2024-01-01 11:00:00", 1, 6.0), (4, "2024-01-09 10:00:00", 2, 1.0))  # the first is later than the grace allows
    state = spark.read.parquet(str(tmp_path / "state" / "state=1"))
    assert {r.key: r.value for r in state.collect()} == {1: 11, 2: 8}
    assert spark.read.parquet(out).count() == 4
    hours = {(str(r.bucket.start), r.n) for r in spark.read.parquet(str(tmp_path / "hours")).collect()}
    assert ("2024-01-01 10:00:00", 1) in hours and not any("11:00:00" in h for h, _ in hours)
    assert epochs.expire(spark, out, 19727) == [19723] and sorted(r.event_id for r in spark.read.parquet(out).collect()) == [2, 4]


def test_text_sources(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one\ntwo\n")
    (tmp_path / "c.tsv").write_text("0 1 3\n1  0 2\n")
    (tmp_path / "x.tsv").write_text("a\tb\n1.5\t2\n")
    words, counts = snapshots.read_corpus(spark, str(tmp_path / "d.txt"), str(tmp_path / "c.tsv"))
    assert words.count() == 2 and sorted(tuple(r) for r in counts.collect()) == [(0, 1, 3), (1, 0, 2)]
    assert tuple(snapshots.read_tsv(spark, str(tmp_path / "x.tsv")).first()) == (1.5, 2.0)


def test_streams(spark, small, tmp_path):
    events = table(spark, small, "events").select("event_id", "ts", "user_id", "event_type", "value")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    stream = epochs.read_events(spark, source, events.schema)
    epochs.append_sink(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    log = stream.select(F.col("user_id").alias("key"), F.lit("increment").alias("op"), keys.cents(F.col("value")).alias("value"), "epoch", F.col("event_id").alias("ordinal"))
    epochs.continuous_fold(log, str(tmp_path / "state"), str(tmp_path / "c2")).awaitTermination()
    folder = str(tmp_path / "state" / "state=0")
    got = {r.key: r.value for r in spark.read.parquet(folder).collect()}
    sums = events.groupBy("user_id").agg(F.sum(keys.cents(F.col("value"))).alias("v"))
    assert got == {r.user_id: r.v for r in sums.collect()}
    q = epochs.throughput(stream).writeStream.format("memory").queryName("per_hour").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("per_hour").agg(F.sum("n")).first()[0] == events.count()


def test_lost_reads_conflict(spark):
    seen = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "k long, v long")
    now = spark.createDataFrame([(1, 1), (2, 2)], "k long, v long")
    assert [r.k for r in log_tools.occ_conflicts(seen, now, "k", "v").collect()] == [2]


@pytest.mark.parametrize("after", [False, True])
def test_neighbours_across_spans(spark, after):
    rows = [(k, e, o) for k, n in ((1, 40), (2, 1), (None, 9)) for e in (3, 4) for o in range(e, e + n)]
    log = spark.createDataFrame(rows, "key long, epoch long, ordinal long").repartition(5)
    got = neighbours.neighbour(log, "key", ["epoch", "ordinal"], F.col("epoch"), F.col("ordinal"), after=after, span=7)
    got = {(r.key, r.epoch, r.ordinal): r._near and (r._near.epoch, r._near.ordinal) for r in got.collect()}
    expected = {}
    for k in (1, 2, None):
        own = sorted((e, o) for key, e, o in rows if key == k)
        for i, (e, o) in enumerate(own):
            at = i + 1 if after else i - 1
            expected[k, e, o] = own[at] if 0 <= at < len(own) else None
    assert got == expected


def test_neighbours_of_few_rows(spark):
    log = spark.createDataFrame([(1, 5)], "key long, ordinal long")
    assert not neighbours.neighbour(log.where("key > 1"), "key", ["ordinal"], F.col("ordinal")).collect()
    assert neighbours.neighbour(log, "key", ["ordinal"], F.col("ordinal")).first()._near is None


def test_precommit(spark):
    reads_ = spark.createDataFrame([(1, 10, 4), (1, 11, 6), (2, 10, 4), (2, 12, 5), (3, 13, 2), (4, 11, 6)], "txn long, key long, ordinal long")
    versions = spark.createDataFrame([(10, 4), (11, 6), (12, 9), (14, 1)], "key long, ordinal long")  # 12 moved, 13 is gone
    scans = spark.createDataFrame([(1, 0, None), (4, 0, None), (4, 1, None), (5, 2, 8), (6, 9, None)], "txn long, page long, ordinal long")
    pages = spark.createDataFrame([(1, 7), (2, 8)], "page long, ordinal long")  # a key came into the empty page 1
    got = {r.txn: (r.n_stale, r.n_phantom, r.outcome, r.commit_version) for r in log_tools.precommit(reads_, versions, scans, pages, "txn", "key", "ordinal").collect()}
    assert got == {
        1: (0, 0, "OK", 7), 2: (1, 0, "RACE_ABORT", None), 3: (1, 0, "RACE_ABORT", None), 4: (0, 1, "RACE_ABORT", None), 5: (0, 0, "OK", 9), 6: (0, 0, "OK", 1),
    }


def test_key_only_inserts_and_boundaries(spark):
    index = spark.createDataFrame([(1, 1), (1, 2)], "a long, b long")
    incoming = spark.createDataFrame([(1, 2), (2, 1), (2, 1)], "a long, b long")
    assert [tuple(r) for r in dml.insert_keys(index, incoming, "a", "b").collect()] == [(2, 1)]
    assert [r.low for r in reads.page_boundaries(spark.range(1, 101), "id", 4).orderBy("page").collect()] == [1, 25, 50, 75]
    assert reads.page_boundaries(spark.range(0), "id", 4).collect() == []


def test_log_files(spark):
    schema = "file long, at long, length long, code string, storage long, old_epoch long, new_epoch long, marker_at long"
    good = [(1, 0, 64, "EPOCH_MARKER", None, 1, 2, 0), (1, 64, 64, "put", 7, None, None, None), (1, 128, 3904, "FILLER", None, None, None, None), (1, 4032, 64, "EPOCH_MARKER", None, 2, 3, 4032)]
    bad = [
        (2, 0, 64, None, 0, None, None, None), (2, 64, 64, "EPOCH_MARKER", None, 1, 2, 0), (2, 128, 64, "EPOCH_MARKER", None, 5, None, 128),
        (2, 192, 0, "put", 1, None, None, None), (2, 256, 64, "lost", 1, None, None, None),  # nothing is read after an entry without length
        (3, 0, 64, "EPOCH_MARKER", None, None, 2, 0), (3, 64, 64, "put", 1, None, None, None),
    ]
    sizes = spark.createDataFrame([(1, 4096), (2, 4096), (3, 100)], "file long, size long")
    found = log_files.problems(spark.createDataFrame(good + bad, schema), sizes, ["EPOCH_MARKER", "FILLER", "put"])
    assert sorted(map(tuple, found.collect())) == sorted([
        (2, 0, "MISSING_LOG_TYPE_CODE"), (2, 0, "MISSING_STORAGE_ID"), (2, 0, "NO_EPOCH_MARKER_AT_BEGINNING"), (2, 64, "EPOCH_MARKER_INCORRECT_OFFSET"),
        (2, 128, "EPOCH_MARKER_DOES_NOT_MATCH"), (2, 128, "INVALID_NEW_EPOCH"), (2, 192, "MISSING_LOG_LENGTH"),
        (3, 0, "INVALID_OLD_EPOCH"), (3, 64, "INCOMPLETE_ENTRY_AT_END"), (3, 100, "NON_ALIGNED_FILE_END"),
    ])
    some = log_files.first_problems(found, 3).collect()
    assert len(some) == 4 and [r.kind for r in some].count("TOO_MANY_INCONSISTENCIES") == 1
    assert log_files.first_problems(found, 10).count() == 10
    assert log_files.problems(spark.createDataFrame([], schema), sizes.limit(0), ["put"]).collect() == []
