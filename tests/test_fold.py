"""The fold against sequential replay, snapshots against one-shot folds, normal forms."""

import random

import pytest

from chronofold.operators import log_fold

SCHEMA = "key long, op string, value long, epoch long, ordinal long"


def replay(rows, state=None):
    state = dict(state or {})
    for key, op, value, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        alive, have = state.get(key, (None, 0))
        if op in ("insert", "update"):
            state[key] = (True, value)
        elif op == "delete":
            state[key] = (False, None)
        elif alive is not False:
            state[key] = (True, value if op == "overwrite" else have + value)
    return state


def random_log(seed, n=600, keys=25):
    draw = random.Random(seed)
    ops = ["insert", "update", "delete", "overwrite", "increment", "increment", "increment"]
    rows = [(draw.randrange(keys), draw.choice(ops), draw.randrange(-50, 50), 1 + i // 40, i) for i in range(n)]
    draw.shuffle(rows)
    return rows


def state_of(df):
    return {r.key: (r.alive, r.value) for r in df.collect()}


@pytest.mark.parametrize("seed", [123456, 7, 99])
def test_fold_is_replay(spark, seed):
    rows = random_log(seed)
    assert state_of(log_fold.fold(spark.createDataFrame(rows, SCHEMA))) == replay(rows)


@pytest.mark.parametrize("epoch", [0, 1, 7, 15])
def test_two_steps_equal_one(spark, epoch):
    rows = random_log(5)
    log = spark.createDataFrame(rows, SCHEMA)
    base = log_fold.fold(log_fold.upto(log, epoch))
    assert state_of(log_fold.fold(log_fold.upto(log, after=epoch), base)) == replay(rows)


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert log_fold.fold(log).count() == 0
    base = spark.createDataFrame([(1, 5, True), (2, None, False)], "key long, value long, alive boolean")
    assert state_of(log_fold.fold(log, base)) == {1: (True, 5), 2: (False, None)}
    assert [tuple(r) for r in log_fold.compose(base, log).collect()] == [(1, 5)]


def test_insert_delete_insert(spark):
    rows = [(1, "insert", 1, 1, 1), (1, "delete", 0, 1, 2), (1, "increment", 9, 1, 3), (1, "insert", 4, 1, 4), (1, "increment", 2, 2, 5)]
    assert state_of(log_fold.fold(spark.createDataFrame(rows, SCHEMA))) == {1: (True, 6)}


def test_array_gaps(spark):
    log = spark.createDataFrame([(0, "increment", 3, 1, 1), (2, "overwrite", 8, 1, 2), (2, "increment", 1, 1, 3)], SCHEMA)
    assert [r.value for r in log_fold.compose_array(4, log).orderBy("key").collect()] == [3, 0, 9, 0]


@pytest.mark.parametrize("ops, in_base, form", [("OODIOUO", True, "UO"), ("OODIOUOD", True, "D"), ("IUUDIOU", False, "I"), ("IOUODID", False, "")])
def test_normal_forms(spark, ops, in_base, form):
    assert log_fold.normal_form_of(ops, in_base) == form
    names = {"I": "insert", "U": "update", "D": "delete", "O": "overwrite"}
    log = spark.createDataFrame([(1, names[o], i, 1, i) for i, o in enumerate(ops)], SCHEMA)
    base = spark.createDataFrame([(1,)] if in_base else [], "key long")
    assert [r.form for r in log_fold.normal_form(log, base).collect()] == [form]
