"""Codecs, filters, generators, write outcomes, consistency checks, procedures and the key-value mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronofold.functions import codecs, keys, random
from chronofold.operators import dml, log_files, sequential
from chronofold.operators.procedures import Procedures
from chronofold.plans.common import SNAPSHOT, Registry, events_log
from chronofold.plans.workload_queries import q_last_order
from chronofold.session import table

R = Registry()
query = R.query

_LE = " || ".join(f"substr(be, {2 * i + 1}, 2)" for i in reversed(range(8)))


@query(f"SELECT o_orderkey, be, {_LE} AS le, o_orderkey * 65537 AS back, substr(be, 13, 4) AS be2 FROM (SELECT o_orderkey, lpad(to_hex(o_orderkey * 65537), 16, '0') AS be FROM orders)")
def endian_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 65537).alias("v"))
    coded = rows.select("o_orderkey", codecs.big_endian(F.col("v")).alias("be"), codecs.little_endian(F.col("v")).alias("le"), codecs.big_endian(F.col("v"), 2).alias("be2"))
    return coded.withColumn("back", codecs.from_big_endian(F.col("be")))


@query("SELECT DISTINCT CAST(round(c_acctbal * 100) AS BIGINT) AS v, CAST(round(c_acctbal * 100) AS BIGINT) AS back FROM customer")
def denormalize_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(keys.cents(F.col("c_acctbal")).alias("v")).distinct()
    return rows.select("v", keys.denormalized(keys.normalized(F.col("v"))).alias("back"))


@query(
    "SELECT c_custkey, substr(c_name, 1, 12) AS cut, substr(substr(c_name, 1, 12) || c_mktsegment, 1, 16) AS appended, CASE WHEN c_mktsegment < c_name THEN -1 WHEN c_mktsegment = c_name THEN 0 ELSE 1 END AS compared, "
    "hex(encode(substr(c_mktsegment, 1, 8))) || CASE WHEN strlen(c_mktsegment) > 8 THEN '..' ELSE '' END AS top, replace(c_name, '0', 'oh') AS replaced FROM customer"
)
def text_helpers(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return c.select(
        "c_custkey", codecs.fixed(name, 12).alias("cut"), codecs.fixed_append(codecs.fixed(name, 12), segment, 16).alias("appended"), codecs.fixed_compare(segment, name).alias("compared"),
        codecs.top_bytes(segment, 8).alias("top"), F.replace(name, F.lit("0"), F.lit("oh")).alias("replaced"),
    )


_POSITIONS = "[" + ", ".join(f"CAST('0x' || substr(md5(CAST(k AS VARCHAR)), {3 * i + 1}, 3) AS INTEGER) % 512" for i in range(3)) + "]"


@query(
    f"WITH m AS (SELECT c_nationkey AS page, unnest({_POSITIONS}) AS bit FROM (SELECT c_nationkey, c_custkey AS k FROM customer)), f AS (SELECT page, list(DISTINCT bit) AS bits FROM m GROUP BY page), "
    f"p AS (SELECT o_orderkey, k % 25 AS page, {_POSITIONS} AS want FROM (SELECT o_orderkey, o_custkey AS k FROM orders)) "
    "SELECT o_orderkey, p.page, coalesce(list_has_all(bits, want), false) AS maybe FROM p LEFT JOIN f ON f.page = p.page"
)
def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """Which orders' customers a page's filter of 512 bits may hold; a filter has at most that many rows to gather."""
    position = lambda k: codecs.bloom_positions(F.md5(F.col(k).cast("string")))
    members = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("page"), F.explode(position("c_custkey")).alias("bit"))
    filters = members.groupBy("page").agg(F.collect_set("bit").alias("bits"))
    probes = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("page"), position("o_custkey").alias("want"))
    missing = F.size(F.array_except("want", F.coalesce("bits", F.array().cast("array<int>")))) > 0
    return probes.join(filters, "page", "left").select("o_orderkey", "page", (~missing).alias("maybe"))


@query("SELECT event_id, CASE WHEN (a - 1 + 268435456) % 268435456 = 0 THEN 268435455 ELSE (a - 1 + 268435456) % 268435456 END AS previous, (a - b + 268435456) % 268435456 - CASE WHEN a < b THEN 1 ELSE 0 END AS steps FROM (SELECT event_id, (event_id * 7919999) % 268435456 AS a, (event_id * 104729777) % 268435456 AS b FROM events)")
def epoch_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.pmod(F.col("event_id") * m, F.lit(1 << 28)) for m in (7919999, 104729777))
    return table(spark, d, "events").select("event_id", keys.epoch_previous(a).alias("previous"), keys.epoch_distance(a, b).alias("steps"))


def _next_sql(state: str) -> str:
    return f"(({state}) * {random.FACTOR}::HUGEINT + {random.INCREMENT}) % 18446744073709551616::HUGEINT"


def _drawn_sql(state: str) -> str:
    return f"xor(CAST({state} // 4294967296 AS BIGINT), CAST({state} % 4294967296 AS BIGINT))"


@query(
    f"WITH s AS (SELECT event_id, {_next_sql('event_id::HUGEINT')} AS s1 FROM events), t AS (SELECT *, {_next_sql('s1')} AS s2 FROM s) "
    f"SELECT event_id, {_drawn_sql('s1')} AS first, {_drawn_sql('s2')} AS second, 5 + {_drawn_sql('s1')} % 11 AS within, "
    f"((({_drawn_sql('s1')} % 256) | (1 + {_drawn_sql('s2')} % 3000)) + {random.C_SEED % 256}) % 3000 + 1 AS skewed FROM t"
)
def gen_uniform(spark: SparkSession, d: str) -> DataFrame:
    """The generator replayed from each event's id as seed: two draws, one within 5 to 15, and one by the non-uniform law."""
    seed = F.col("event_id").cast("decimal(20,0)")
    one = random.following(seed)
    return table(spark, d, "events").select(
        "event_id", random.drawn(one).alias("first"), random.drawn(random.following(one)).alias("second"), random.uniform(seed, 5, 15).alias("within"), random.non_uniform(seed, 255, 1, 3000).alias("skewed")
    )


_OUT = "base AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0), inc AS (SELECT o_custkey % 1000 AS c_custkey, o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN repeat('x', 30) ELSE 'XYZ' END AS c_name FROM orders)"


def _outcomes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, d, "customer").where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    part = F.when(F.col("o_custkey") % 5 == 0, "x" * 30).otherwise("XYZ")
    return base, table(spark, d, "orders").select((F.col("o_custkey") % 1000).alias("c_custkey"), "o_orderkey", part.alias("c_name"))


@query(f"WITH {_OUT} SELECT c_custkey, o_orderkey, c_name, CASE WHEN c_custkey NOT IN (SELECT c_custkey FROM base) AND o_orderkey = min(o_orderkey) OVER (PARTITION BY c_custkey) THEN 'OK' ELSE 'KEY_ALREADY_EXISTS' END AS status FROM inc")
def insert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return dml.insert_outcomes(*_outcomes(spark, d), "c_custkey", "o_orderkey")


@query(
    f"WITH {_OUT}, one AS (SELECT c_custkey, max(c_name) AS part FROM inc GROUP BY c_custkey), j AS (SELECT one.c_custkey, part, b.c_name AS old FROM one LEFT JOIN base b ON b.c_custkey = one.c_custkey) "
    "SELECT c_custkey, CASE WHEN old IS NOT NULL AND strlen(old) >= 3 + strlen(part) THEN substr(old, 1, 3) || part || substr(old, 4 + strlen(part)) ELSE old END AS c_name, "
    "CASE WHEN old IS NULL THEN 'KEY_NOT_FOUND' WHEN strlen(old) >= 3 + strlen(part) THEN 'OK' ELSE 'TOO_SHORT_PAYLOAD' END AS status FROM j"
)
def overwrite_outcomes(spark: SparkSession, d: str) -> DataFrame:
    base, incoming = _outcomes(spark, d)
    return dml.overwrite_outcomes(base, incoming.drop("o_orderkey"), "c_custkey", "c_name", 3)


@query("SELECT doc_id, CASE WHEN coalesce(strlen(text), 0) >= 4032 THEN 'TOO_LONG_PAYLOAD' ELSE 'OK' END AS status FROM documents")
def seq_refused(spark: SparkSession, d: str) -> DataFrame:
    """Appended rows and those refused, with why."""
    fine, refused = sequential.checked(table(spark, d, "documents").select("doc_id", "text"), "text")
    return sequential.append(fine.withColumn("status", F.lit("OK")), refused).drop("text")


@query("SELECT event_id, user_id % 4 AS node, CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)), event_id) AS BIGINT) AS place FROM events")
def seq_order_modes(spark: SparkSession, d: str) -> DataFrame:
    """Places within each node in the order of time; ``sequential.ordered`` sorts the rows so."""
    rows = events_log(spark, d).select(F.col("ordinal").alias("event_id"), "epoch", (F.col("key") % 4).alias("node"))
    # places follow the order in which the sorted rows lie
    placed = sequential.ordered(rows, "node_first", within="event_id").withColumn("at", F.monotonically_increasing_id())
    return placed.select("event_id", "node", F.row_number().over(Window.partitionBy("node").orderBy("at")).cast("long").alias("place"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    """A secondary index: keys only, no payload."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("i_nation"), F.col("c_name").alias("i_name"), F.col("c_custkey").alias("i_key"))


@query("SELECT c_nationkey, c_name, c_custkey, c_acctbal FROM customer WHERE c_nationkey = 7 AND c_name < 'Customer#000000500'")
def secondary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A range of the index, then the records that its keys name."""
    found = _index(spark, d).where("i_nation = 7 AND i_name < 'Customer#000000500'").select(F.col("i_key").alias("c_custkey"))
    return table(spark, d, "customer").join(found, "c_custkey").select("c_nationkey", "c_name", "c_custkey", "c_acctbal")


@query("SELECT 'without_record' AS finding, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'without_entry', 0 UNION ALL SELECT 'entries', count(*) FROM customer")
def verify_secondary(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index and the records agree: one full join, counted."""
    both = _index(spark, d).withColumn("e", F.lit(1)).join(
        table(spark, d, "customer").select(F.col("c_nationkey").alias("i_nation"), F.col("c_name").alias("i_name"), F.col("c_custkey").alias("i_key"), F.lit(1).alias("r")), ["i_nation", "i_name", "i_key"], "full"
    )
    sums = both.agg(F.count_if(F.col("r").isNull()).alias("without_record"), F.count_if(F.col("e").isNull()).alias("without_entry"), F.count("e").alias("entries"))
    return sums.unpivot([], ["without_record", "without_entry", "entries"], "finding", "n")


@query("SELECT level, CAST(sum(v) AS BIGINT) AS total, true AS agrees FROM (SELECT unnest(['account', 'branch', 'teller', 'history']) AS level, CAST(round(value * 100) AS BIGINT) AS v FROM events WHERE event_type = 'purchase') GROUP BY level")
def verify_balances(spark: SparkSession, d: str) -> DataFrame:
    """Balances kept by account, teller and branch, each folded from the log, agree with the history's sum."""
    log = events_log(spark, d).where("op = 'increment'")
    level = {"account": F.col("key"), "teller": F.col("key") % 100, "branch": F.col("key") % 10}
    history = log.agg(F.lit("history").alias("level"), F.sum("value").alias("total"))
    sums = history
    for name, k in level.items():
        kept = log.groupBy(k.alias("k")).agg(F.sum("value").alias("balance"))
        sums = sums.unionByName(kept.agg(F.lit(name).alias("level"), F.sum("balance").alias("total")))
    true = history.select(F.col("total").alias("history"))  # one row
    return sums.join(F.broadcast(true), F.col("total").eqNullSafe(F.col("history")), "left").select("level", "total", F.col("history").isNotNull().alias("agrees"))


@query("SELECT 'part' AS storage, true AS in_order, true AS in_range FROM part LIMIT 1")
def verify_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Sorted runs: within each run keys rise, and no run's keys overlap another's."""
    runs = table(spark, d, "part").select("p_partkey").repartitionByRange(8, "p_partkey").sortWithinPartitions("p_partkey")
    placed = runs.select("p_partkey", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("p_partkey").over(Window.partitionBy("run").orderBy("at"))
    inside = placed.withColumn("before", before).groupBy("run").agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"), F.bool_and(F.coalesce(F.col("p_partkey") > F.col("before"), F.lit(True))).alias("rises"))
    last = F.lag("high").over(Window.orderBy("run"))  # one row a run
    return inside.withColumn("last", last).agg(F.lit("part").alias("storage"), F.bool_and("rises").alias("in_order"), F.bool_and(F.coalesce(F.col("low") > F.col("last"), F.lit(True))).alias("in_range"))


@query("SELECT c_nationkey, CAST(count(*) + 1 AS BIGINT) AS next_oid, CAST(count(*) FILTER (o_orderkey % 100 = 7) AS BIGINT) AS rolled_back, CAST(count(*) FILTER (o_orderkey % 100 <> 7) AS BIGINT) AS committed FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey")
def q_neworder_ids(spark: SparkSession, d: str) -> DataFrame:
    """Per district the next order id; one order in a hundred is rolled back by its user, and its id stays used."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    bad = F.col("o_orderkey") % 100 == 7
    return orders.groupBy("c_nationkey").agg((F.count("*") + 1).alias("next_oid"), F.count_if(bad).alias("rolled_back"), F.count_if(~bad).alias("committed"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN substr(printf('|%d %d %d $%.2f ', c_custkey, c_nationkey % 10, o_orderkey, o_totalprice) || c_name || c_mktsegment, 1, 50) ELSE c_mktsegment END AS data FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE o_orderkey IS NOT NULL")
def q_payment_bad_credit(spark: SparkSession, d: str) -> DataFrame:
    """Customers of bad credit get the payment put before their data, which is cut at its width; the others' data stays."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"), F.max_by("o_totalprice", "o_orderkey").alias("o_totalprice"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment").join(last, "c_custkey")
    entry = F.format_string("|%d %d %d $%.2f ", "c_custkey", F.col("c_nationkey") % 10, "o_orderkey", "o_totalprice")
    longer = F.substring(F.concat(entry, "c_name", "c_mktsegment"), 1, 50)
    return c.select("c_custkey", F.when(F.col("c_acctbal") < 0, longer).otherwise(F.col("c_mktsegment")).alias("data"))


_NEXT = "queue AS (SELECT c_nationkey, o_orderkey, o_custkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O'), popped AS (SELECT c_nationkey, min(o_orderkey) AS o_orderkey, arg_min(o_custkey, o_orderkey) AS o_custkey FROM queue GROUP BY c_nationkey)"


def _popped(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    owned = orders.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return owned.groupBy("c_nationkey").agg(F.min("o_orderkey").alias("o_orderkey"), F.min_by("o_custkey", "o_orderkey").alias("o_custkey"))


@query(f"WITH {_NEXT}, a AS (SELECT o_custkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n FROM popped JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey) SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) + coalesce(amount, 0) AS balance, coalesce(n, 0) AS delivery_cnt FROM customer LEFT JOIN a ON o_custkey = c_custkey")
def q_delivery_balances(spark: SparkSession, d: str) -> DataFrame:
    """All customers after one delivery in each district: the delivered order's amount is added to its customer's balance."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), keys.cents(F.col("l_extendedprice")).alias("amount"))
    sums = _popped(spark, d).join(lines, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("amount").alias("amount"), F.count_distinct("o_orderkey").alias("n"))
    c = table(spark, d, "customer").select("c_custkey", keys.cents(F.col("c_acctbal")).alias("before"))
    return c.join(sums, "c_custkey", "left").select("c_custkey", (F.col("before") + F.coalesce("amount", F.lit(0))).alias("balance"), F.coalesce("n", F.lit(0)).alias("delivery_cnt"))


@query(f"WITH {_NEXT} SELECT c_nationkey, o_orderkey, o_custkey FROM queue WHERE o_orderkey NOT IN (SELECT o_orderkey FROM popped)")
def q_delivery_queue(spark: SparkSession, d: str) -> DataFrame:
    """The waiting orders after one delivery in each district."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    owned = orders.join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    return dml.delete_keys(owned, _popped(spark, d), "o_orderkey").select("c_nationkey", "o_orderkey", "o_custkey")


@query(f"WITH {_NEXT} SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN l_linestatus ELSE 'D' END AS l_linestatus, CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 + o_orderkey % 10 END AS carrier FROM lineitem LEFT JOIN popped ON o_orderkey = l_orderkey")
def q_delivery_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines after delivery: those of delivered orders are marked and get their carrier."""
    popped = _popped(spark, d).select(F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_orderkey") % 10).alias("by"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus").join(popped, "l_orderkey", "left")
    return lines.select("l_orderkey", "l_linenumber", F.when(F.col("by").isNull(), F.col("l_linestatus")).otherwise("D").alias("l_linestatus"), F.coalesce("by", F.lit(0)).alias("carrier"))


#: The mixes A to H as upper bounds in hundredths of insert, read, update, scan and read-modify-write.
MIXES = {"A": (0, 50, 100, 0, 0), "B": (0, 95, 100, 0, 0), "C": (0, 100, 0, 0, 0), "D": (5, 100, 0, 0, 0), "E": (5, 0, 0, 100, 0), "F": (0, 0, 0, 0, 100), "G": (0, 0, 5, 100, 0), "H": (0, 0, 0, 100, 0)}
KINDS = ("insert", "read", "update", "scan", "rmw")


def _mix_sql(mix: str) -> str:
    return "CASE " + " ".join(f"WHEN p < {bound} THEN '{kind}'" for kind, bound in zip(KINDS, MIXES[mix])) + " END"


@query(
    "WITH r AS (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 6) AS INTEGER) % 100 AS p FROM orders) "
    + "SELECT mix, op, CAST(count(*) AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS mix, {_mix_sql(m)} AS op FROM r" for m in MIXES)
    + ") GROUP BY mix, op"
)
def ycsb_mix(spark: SparkSession, d: str) -> DataFrame:
    """What each mix does with the same requests, by its shares."""
    p = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6), 16, 10).cast("int") % 100
    chosen = []
    for name, bounds in MIXES.items():
        op = F.lit(None).cast("string")
        for kind, bound in reversed(list(zip(KINDS, bounds))):
            op = F.when(p < bound, kind).otherwise(op)
        chosen.append(F.struct(F.lit(name).alias("mix"), op.alias("op")))
    return table(spark, d, "orders").select(F.inline(F.array(*chosen))).groupBy("mix", "op").agg(F.count("*").alias("n"))


@query("SELECT key, substr(md5(CAST(key AS VARCHAR) || '-0'), 1, 10) AS f0, status FROM (SELECT c_custkey AS key, 'KEPT' AS status FROM customer UNION ALL SELECT (o_orderkey % 8) * 4294967296 + o_orderkey, CASE WHEN (o_orderkey % 8) * 4294967296 + o_orderkey IN (SELECT c_custkey FROM customer) THEN 'KEY_ALREADY_EXISTS' ELSE 'OK' END FROM orders WHERE o_orderstatus = 'P')")
def ycsb_insert(spark: SparkSession, d: str) -> DataFrame:
    """The users' table and the outcome of each insert; keys are made of a worker and its counter."""
    field = F.substring(F.md5(F.concat(F.col("key").cast("string"), F.lit("-0"))), 1, 10).alias("f0")
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    made = F.shiftleft(F.col("o_orderkey") % 8, 32).bitwiseOR(F.col("o_orderkey"))
    new = table(spark, d, "orders").where("o_orderstatus = 'P'").select(made.alias("key"), F.lit(0).alias("n"))
    return base.withColumn("status", F.lit("KEPT")).unionByName(dml.insert_outcomes(base, new, "key", "n").drop("n")).select("key", field, "status")


@query("SELECT w AS word, CAST(length(w) % 4 AS BIGINT) AS topic, CAST(count(*) AS BIGINT) AS n_tw FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL")
def lda_word_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n_tw")).select("word", (F.char_length("word") % 4).cast("long").alias("topic"), "n_tw")


def procedures() -> Procedures:
    """The library's own procedures: each is (session, folder) to rows."""
    made = Procedures()
    made.register("last_order", q_last_order)
    made.register("next_oid", q_neworder_ids)
    made.start()
    return made


@query(R.oracles["q_neworder_ids"])
def procedure_run(spark: SparkSession, d: str) -> DataFrame:
    return procedures().run(spark, "next_oid", d)


@query(f"SELECT true AS balanced, CAST(8 AS BIGINT) AS runs, count(*) AS n FROM events WHERE date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) > {SNAPSHOT}")
def partition_balance(spark: SparkSession, d: str) -> DataFrame:
    """Log rows dealt to eight reducers by sampled boundaries of (key, ordinal): none has twice its share."""
    log = events_log(spark, d).where(F.col("epoch") > SNAPSHOT).repartitionByRange(8, "key", "ordinal")
    runs = log.groupBy(F.spark_partition_id().alias("run")).agg(F.count("*").alias("n"))
    return runs.agg((F.max("n") * 8 <= 2 * F.sum("n")).alias("balanced"), F.count("*").alias("runs"), F.sum("n").alias("n"))


_CODES = ["EPOCH_MARKER", "click", "view", "purchase"]


@query(
    "WITH e AS (SELECT user_id % 4 AS file, event_id * 64 AS pos, CASE WHEN user_id % 4 = 3 AND event_id % 503 = 502 THEN 0 ELSE 64 END AS length, CASE event_type WHEN 'signup' THEN 'EPOCH_MARKER' ELSE event_type END AS code, "
    "CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 + event_id % 4 END AS storage, CASE WHEN event_id % 31 = 0 THEN 0 ELSE user_id END AS new_epoch, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id - 4 END AS old_epoch, "
    "CASE WHEN event_id % 5 = 0 THEN event_id * 64 + 8 ELSE event_id * 64 END AS marker_at FROM events), "
    "z AS (SELECT file, max(pos) + CASE WHEN file = 1 THEN 32 ELSE 64 END AS size, min(pos) AS first, min(pos) FILTER (length = 0) AS stop FROM e GROUP BY file), "
    "r AS (SELECT e.*, size, first FROM e JOIN z ON z.file = e.file WHERE stop IS NULL OR pos <= stop), "
    "m AS (SELECT file, pos, old_epoch, lag(new_epoch) OVER (PARTITION BY file ORDER BY pos) AS before FROM r WHERE code = 'EPOCH_MARKER') "
    "SELECT file, pos AS \"at\", 'MISSING_LOG_LENGTH' AS kind FROM r WHERE length = 0 UNION ALL SELECT file, pos, 'INCOMPLETE_ENTRY_AT_END' FROM r WHERE pos + length > size "
    "UNION ALL SELECT file, pos, 'MISSING_LOG_TYPE_CODE' FROM r WHERE code NOT IN ('EPOCH_MARKER', 'click', 'view', 'purchase') UNION ALL SELECT file, pos, 'MISSING_STORAGE_ID' FROM r WHERE code <> 'EPOCH_MARKER' AND storage = 0 "
    "UNION ALL SELECT file, pos, 'NO_EPOCH_MARKER_AT_BEGINNING' FROM r WHERE pos = first AND code <> 'EPOCH_MARKER' UNION ALL SELECT file, pos, 'INVALID_OLD_EPOCH' FROM r WHERE code = 'EPOCH_MARKER' AND old_epoch = 0 "
    "UNION ALL SELECT file, pos, 'INVALID_NEW_EPOCH' FROM r WHERE code = 'EPOCH_MARKER' AND new_epoch = 0 UNION ALL SELECT file, pos, 'EPOCH_MARKER_INCORRECT_OFFSET' FROM r WHERE code = 'EPOCH_MARKER' AND marker_at <> pos "
    "UNION ALL SELECT file, pos, 'EPOCH_MARKER_DOES_NOT_MATCH' FROM m WHERE before <> old_epoch UNION ALL SELECT file, size, 'NON_ALIGNED_FILE_END' FROM z WHERE size % 4096 <> 0"
)
def log_file_problems(spark: SparkSession, d: str) -> DataFrame:
    """Four log files made of the events, with faults of every kind."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    number, at = F.col("event_id"), F.col("event_id") * 64
    entries = e.select(
        (F.col("user_id") % 4).alias("file"), at.alias("at"), F.when((F.col("user_id") % 4 == 3) & (number % 503 == 502), 0).otherwise(64).alias("length"),
        F.when(F.col("event_type") == "signup", log_files.MARKER).otherwise(F.col("event_type")).alias("code"), F.when(number % 97 == 0, 0).otherwise(1 + number % 4).alias("storage"),
        F.when(number % 31 == 0, 0).otherwise(F.col("user_id")).alias("new_epoch"), F.when(number % 3 == 0, 0).otherwise(F.col("user_id") - 4).alias("old_epoch"),
        F.when(number % 5 == 0, at + 8).otherwise(at).alias("marker_at"),
    )
    sizes = entries.groupBy("file").agg((F.max("at") + F.when(F.col("file") == 1, 32).otherwise(64)).alias("size"))
    return log_files.problems(entries, sizes, _CODES)
