"""Cases of the third round's findings on growth: what a task holds or reads has a bound."""

from evidentia import plans
from tests.test_parity import DIR


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_not_dealt_out_by_suite(spark):
    """three suites are three tasks; the rules go to the texts instead."""
    for name in ("eval_must_answer_question", "eval_checks", "eval_release_gate"):
        joins = [x for x in _plan(plans.QUERIES[name](spark, DIR)).splitlines() if "Join" in x and "(suite#" in x]
        assert any("rightHint=(strategy=broadcast)" in x for x in joins), name


def test_dealt_documents_have_no_fixed_number_of_tasks(spark):
    """a table in one file is dealt out in parts that adaptive execution splits by size."""
    from evidentia.sources.views import Tables

    plan = _plan(Tables(spark, DIR).documents())
    assert "RebalancePartitions" in plan and "RepartitionByExpression" not in plan


def test_buckets_follow_the_rows(spark, monkeypatch):
    """a task sorts and writes one bucket, and buckets are as many as the rows ask for."""
    from evidentia.plans import stores

    made = []
    create = stores.KeyedTable.create
    monkeypatch.setattr(stores, "ROWS_A_BUCKET", 200)
    monkeypatch.setattr(stores.KeyedTable, "create", lambda *a: made.append(create(*a)) or made[-1])
    n = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    assert plans.QUERIES["stored_kpi_upserts"](spark, DIR).count() > 0
    assert made[0].buckets == -(-n // 200) > 16
    assert all(len(spark.read.parquet(f"{made[0].path}/{f}").inputFiles()) == 1 for f in sorted(made[0].files())[:5])


def test_postings_are_counted_where_texts_lie(spark):
    """texts are dealt out by id, not their tokens."""
    from evidentia.operators.retrieval import postings

    df = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a")], "chunk_id long, content string")
    index = postings(df, "chunk_id", "content")
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(chunk_id" in plan and ", token" not in plan.split("Exchange")[1].split("\n")[0]
    assert {(r.chunk_id, r.token): round(r.weight, 6) for r in index.collect()}[1, "b"] == round(2 * 2.5 / 3.5, 6)
