"""Every named query against its SQL on the smallest tables."""

import duckdb
import pytest

from chronofold.plans import catalogue, workload_queries
from chronofold.session import TABLES


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    expected = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    assert df.columns
    df.count()


def test_ycsb_read_of_a_larger_table(spark, tmp_path):
    spark.range(19_000, 40_000).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(18_000, 39_000).selectExpr("id AS o_custkey").write.parquet(str(tmp_path / "orders.parquet"))
    larger = duckdb.connect()
    for t in ("customer", "orders"):
        larger.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = catalogue.QUERIES["ycsb_read"](spark, str(tmp_path))
    expected = larger.execute(catalogue.ORACLES["ycsb_read"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in expected.description], expected.fetchall())


@pytest.mark.parametrize(
    "keys",
    [
        "SELECT id AS o_orderkey FROM range(900000)",
        "SELECT id DIV 3 * if(id % 2 = 0, -1, 1) AS o_orderkey FROM range(300000)",
        "SELECT explode(array(9007199254740993, 9007199254740995, null, 5, 5)) AS o_orderkey",
        "SELECT if(id < 30000, 7, id) AS o_orderkey FROM range(40000)",
        "SELECT id AS o_orderkey FROM range(0)",
    ],
)
def test_page_boundaries_of_other_keys(spark, tmp_path, keys):
    spark.sql(keys).write.parquet(str(tmp_path / "orders.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    df = catalogue.QUERIES["page_boundaries"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(catalogue.ORACLES["page_boundaries"]).fetchall())


def shuffled_rows(plan):
    """Rows written by the distinct shuffles of a plan that has run."""
    seen = {}

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            seen[node.id()] = node.metrics().get("shuffleRecordsWritten").get().value()
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ResultQueryStageExec": "plan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ReusedExchangeExec": "child"}
        if kind in inner:
            return walk(getattr(node, inner[kind])())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return sum(seen.values())


def test_lda_conditional_shuffles_no_row_for_each_word_of_a_document(spark, tmp_path):
    words = " ".join(f"word{i}{'x' * (i % 5)}" for i in range(200))
    spark.createDataFrame([(i, words) for i in range(400)], "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.QUERIES["lda_conditional"](spark, str(tmp_path))
    assert len(df.collect()) == 1600
    assert 1600 <= shuffled_rows(df._jdf.queryExecution().executedPlan()) < 20_000  # of 80,000 words in documents


@pytest.mark.parametrize("frequent", [1, 8, 60, 1 << 20])
def test_lda_conditional_with_rare_words(spark, tmp_path, monkeypatch, frequent):
    monkeypatch.setattr(workload_queries, "FREQUENT", frequent)
    docs = [(i, " ".join(["The", "the", "of  ", "Ünï" * (i % 3)] * (i % 7) + [f"w{i % 11}", f"rare{i}", "l" * 65, "l" * 65])) for i in range(60)]
    docs += [(3, "the again of"), (None, "the of rare1 nowhere"), (90, None), (91, ""), (92, "   ")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES["lda_conditional"](spark, str(tmp_path))
    expected = c.execute(catalogue.ORACLES["lda_conditional"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([x[0] for x in expected.description], expected.fetchall())
