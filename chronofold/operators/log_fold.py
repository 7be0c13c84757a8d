"""The change log and its fold: state at an epoch as a declarative function of log rows.

A log row is (key, op, value, epoch, ordinal). Rows are in serial order of (epoch, ordinal). Insert
and update set a record; delete clears it; overwrite sets it where it is alive; increment adds to
it. Overwrites and increments of a key that was never set start from 0; after a delete they are
ignored until the next insert or update.

The fold needs no window over a key's rows: the last reset and the last overwrite of a key are
aggregates that combine before the shuffle, and only increments are joined with them (one row a
key), so a key that holds a third of the log stays split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESETS = ("insert", "update", "delete")
SEQ = ("epoch", "ordinal")


def seq() -> Column:
    return F.struct(*SEQ)


def upto(log: DataFrame, epoch: int | None = None, after: int | None = None) -> DataFrame:
    """Log rows with after < epoch <= ``epoch``."""
    if after is not None:
        log = log.where(F.col("epoch") > after)
    return log if epoch is None else log.where(F.col("epoch") <= epoch)


def fold(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(key, value, alive) of every key of the log or ``base`` (key, value, alive)."""
    is_reset = F.col("op").isin(*RESETS)
    image = F.struct(*SEQ, "op", "value")
    last = log.where(F.col("op") != "increment").groupBy("key").agg(
        F.max(F.when(is_reset, image)).alias("reset"), F.max(F.when(F.col("op") == "overwrite", image)).alias("over")
    )
    last = last.withColumn("over", F.when(F.col("reset").isNull() | (seq_of("over") > seq_of("reset")), F.col("over")))
    setter = F.greatest(seq_of("reset"), seq_of("over"))
    sums = log.where(F.col("op") == "increment").join(last.select("key", setter.alias("since")), "key", "left")
    sums = sums.where(F.col("since").isNull() | (seq() > F.col("since"))).groupBy("key").agg(F.sum("value").alias("added"))
    state = last.join(sums, "key", "full")
    if base is None:
        state = state.withColumn("base_value", F.lit(None).cast("long")).withColumn("base_alive", F.lit(None).cast("boolean"))
    else:
        state = state.join(base.select("key", F.col("value").alias("base_value"), F.col("alive").alias("base_alive")), "key", "full")
    set_value = F.coalesce(F.col("over.value"), F.col("reset.value"), F.when(F.col("base_alive"), F.col("base_value")), F.lit(0))
    alive = F.when(F.col("reset").isNotNull(), F.col("reset.op") != "delete").otherwise(F.coalesce(F.col("base_alive"), F.lit(True)))
    value = F.when(alive, set_value + F.coalesce("added", F.lit(0)))
    return state.select("key", value.alias("value"), alive.alias("alive"))


def seq_of(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.struct(F.col(f"{column}.epoch").alias("epoch"), F.col(f"{column}.ordinal").alias("ordinal")))


def fold_ranges(base: DataFrame, log: DataFrame) -> DataFrame:
    """(key, payload) after overwrites of byte ranges: ``log`` has (key, begin, part, epoch, ordinal), parts being ASCII.

    Each byte has its last writer, an aggregate that combines before the shuffle; bytes past the payload's end are not written."""
    written = log.select("key", seq().alias("seq"), "begin", F.posexplode(F.split("part", "")).alias("i", "byte")).where("byte != ''")
    last = written.groupBy("key", (F.col("begin") + F.col("i")).alias("at")).agg(F.max_by("byte", "seq").alias("byte"))
    bytes_ = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("bytes"))
    old = F.transform(F.split("payload", ""), lambda c, i: F.coalesce(F.element_at("bytes", i.cast("long")), c))
    both = base.select("key", "payload").join(bytes_, "key", "left")
    return both.select("key", F.when(F.col("bytes").isNull(), F.col("payload")).otherwise(F.array_join(old, "")).alias("payload"))


def latest_version(log: DataFrame) -> DataFrame:
    """The last log row of each key."""
    return log.groupBy("key").agg(F.max(F.struct(*SEQ, "op", "value")).alias("r")).select("key", "r.epoch", "r.ordinal", "r.op", "r.value")


def fold_increments(log: DataFrame) -> DataFrame:
    """Blind increments per key: their sum."""
    return log.where(F.col("op") == "increment").groupBy("key").agg(F.sum("value").alias("total"), F.count("*").alias("n"))


def fold_overwrites(log: DataFrame) -> DataFrame:
    """The last overwrite of each key."""
    return latest_version(log.where(F.col("op") == "overwrite")).select("key", "epoch", "ordinal", "value")


def increments_after(log: DataFrame) -> DataFrame:
    """Every increment with the value after it: a running sum in serial order."""
    w = Window.partitionBy("key").orderBy(*SEQ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return log.where(F.col("op") == "increment").select("key", *SEQ, F.col("value").alias("added"), F.sum("value").over(w).alias("after"))


def normal_form(log: DataFrame, base_keys: DataFrame) -> DataFrame:
    """Per key, the least sequence of operations with the same effect: for keys of the base D or [U]O*,
    for others nothing or IO*; increments count as overwrites, and only the last of them is kept."""
    is_reset = F.col("op").isin(*RESETS)
    agg = log.groupBy("key").agg(
        F.max(F.when(is_reset, F.struct(*SEQ, "op"))).alias("reset"),
        F.max(F.when(~is_reset, F.struct(*SEQ))).alias("over"),
        F.max(F.col("op") == "insert").alias("inserted"),
    )
    agg = agg.join(base_keys.select("key", F.lit(True).alias("in_base")), "key", "left")
    in_base = F.coalesce("in_base", F.lit(False))
    head = (
        F.when(F.col("reset").isNull(), "")
        .when(F.col("reset.op") == "delete", F.when(in_base, "D").otherwise(""))
        .otherwise(F.when(in_base, "U").otherwise("I"))
    )
    alive = F.col("reset").isNull() | (F.col("reset.op") != "delete")
    follows = F.col("over").isNotNull() & alive & (F.col("reset").isNull() | (F.col("over") > seq_of("reset")))
    return agg.select("key", in_base.alias("in_base"), F.concat(head, F.when(follows, "O").otherwise("")).alias("form"))


def compose(base: DataFrame, delta: DataFrame) -> DataFrame:
    """A new snapshot: the fold of ``delta`` on ``base``; dead records are left out."""
    return fold(delta, base).where("alive").select("key", "value")


def compose_array(n: int | None, log: DataFrame) -> DataFrame:
    """The snapshot of an array storage of ``n`` records (None: up to the largest key): every offset exists, gaps are 0."""
    if n is None:
        n = (log.agg(F.max("key")).first()[0] or -1) + 1
    base = log.sparkSession.range(n).select(F.col("id").alias("key"))
    state = fold(log).select("key", "value")
    return base.join(state, "key", "left").select("key", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def normal_form_of(ops: str, in_base: bool) -> str:
    """The reduction rules on one key's sequence of letters, for short sequences and tests."""
    out: list[str] = []
    for op in ops:
        if op == "O":
            if out and out[-1] == "O":
                out.pop()
            out.append("O")
        elif op == "U":
            inserted = bool(out) and out[0] == "I"
            out = ["I"] if inserted else ["U"]
        elif op == "D":
            inserted = bool(out) and out[0] == "I"
            out = [] if inserted else ["D"]
        else:
            out = ["U"] if out == ["D"] else ["I"]
    return "".join(out)
