"""Scope guard, quantile sketches, broken rules, files that queries read."""

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from evidentia.operators import quantiles as Q
from evidentia.operators.evaluation import case_results, run_checks
from evidentia.scope import ScopeError, TenantScope, check_scope
from evidentia.sources.reports import read_manifest, read_vocabulary, write_manifests, write_vocabulary


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('chunks')}/t"
    rows = [(i, i % 3, f"c{i % 2}", ("child", "table", "parent")[i % 3 - 1], i) for i in range(60)]
    spark.createDataFrame(rows, "id long, tenant_id int, coverage_id string, chunk_type string, size int").write.partitionBy("tenant_id").parquet(path)
    return spark.read.parquet(path)


def test_a_plan_without_the_tenants_predicate_is_refused(spark, chunks):
    mine = TenantScope(1, "c0").table(chunks)
    other = spark.createDataFrame([(1, "x")], "id long, name string")
    for good in (mine, mine.groupBy("size").count(), mine.join(other, "id", "left"), chunks.join(other, "id").filter("tenant_id = 1 and size > 3"), mine.unionByName(mine), other):
        assert check_scope(good, 1) is good
    ranked = chunks.withColumn("r", F.row_number().over(Window.orderBy("size"))).filter("tenant_id = 1")
    for bad in (chunks, chunks.filter("size = 1"), chunks.filter("tenant_id = 2"), chunks.filter("tenant_id = 1 or size = 1"), mine.unionByName(chunks), mine.join(chunks.select(F.col("id")), "id"), ranked, chunks.limit(5).filter("tenant_id = 1"), chunks.groupBy("size").count()):
        with pytest.raises(ScopeError):
            check_scope(bad, 1)


def test_search_is_pushed_down_and_the_session_decides(spark, chunks):
    found = TenantScope(1, "c0").searchable(chunks, F.col("size") > 10)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(tenant_id" in plan and "EqualTo(coverage_id,c0)" in plan and "GreaterThan(size,10)" in plan
    want = {i for i in range(60) if i % 3 == 1 and i % 2 == 0 and ("child", "table", "parent")[i % 3 - 1] != "parent" and i > 10}
    assert {r.id for r in found.collect()} == want
    own = spark.newSession()
    assert TenantScope.of_session(own).table(chunks).count() == 0
    with pytest.raises(ValueError):
        TenantScope.of_session(own, "c0").searchable(chunks)
    own.conf.set("evidentia.tenant", "2")
    assert TenantScope.of_session(own).table(chunks).count() == 20


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_sketches_merge_in_any_order(spark, q):
    r = random.Random(8)
    rows = [(k, h, r.choice([-1, 1, 1, 1]) * math.exp(r.gauss(2, 3)) if r.random() < 0.97 else r.choice([0.0, None, float("nan")])) for k in ("a", "b") for h in range(6) for _ in range(r.choice([1, 40, 300]))]
    df = spark.createDataFrame(rows, "k string, h int, v double")
    hours = Q.sketch(df, ["k", "h"], "v")
    whole = Q.merge(hours, ["k"])
    halves = Q.merge(Q.merge(hours.withColumn("half", F.col("h") % 2), ["k", "half"]), ["k"])
    once = Q.sketch(df, ["k"], "v")
    found = [{x.k: x.p for x in Q.quantile(s, ["k"], q, "p").collect()} for s in (whole, halves, once)]
    assert found[0] == found[1] == found[2]
    for k in ("a", "b"):
        values = sorted(v for key, _, v in rows if key == k and v is not None and not math.isnan(v))
        exact = values[max(math.ceil(q * len(values)), 1) - 1]
        assert abs(found[0][k] - exact) <= Q.ERROR * abs(exact) * 1.0001
    assert whole.groupBy("k").count().agg(F.max("count")).first()[0] < 1200


def test_a_broken_rule_fails_its_own_check_only(spark):
    cases = spark.createDataFrame([(1, 0, "abc"), (2, 0, None), (3, 1, "abc")], "case_id long, suite int, content string")
    good = [(0, "must_contain", "B", None), (0, "must_contain_regex", "a.c", None), (1, "must_contain", "z", None)]
    schema = "suite int, kind string, arg string, num double"
    key = lambda df: {(r.case_id, r.kind, r.arg): r.passed for r in df.collect()}
    before = key(run_checks(cases, spark.createDataFrame(good, schema)))
    checks = run_checks(cases, spark.createDataFrame([*good, (0, "must_contain_regex", "([", None), (0, "citation_format", "*", None)], schema))
    after = key(checks)
    assert {k: v for k, v in after.items() if k[2] not in ("([", "*")} == before and len(after) == len(before) + 2
    errors = {r.arg: r.error for r in checks.collect() if r.case_id == 1}
    assert "Unclosed" in errors["(["] and errors["*"] and errors["a.c"] is None and not after[1, "must_contain_regex", "(["]


def test_hallucination_limits_are_per_suite(spark):
    cases = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "case_id long, suite int")
    rules = spark.createDataFrame([(1, "max_hallucinations", None, 2.0)], "suite int, kind string, arg string, num double")
    triples = spark.createDataFrame([(1, 1, 0, 3), (2, 2, 0, 3), (3, 3, 0, 3)], "case_id long, hallucinations long, paraphrases long, citations long")
    checks = spark.createDataFrame([(2, True)], "case_id long, passed boolean")
    assert {r.case_id: r.passed for r in case_results(checks, triples, cases, rules).collect()} == {1: False, 2: True, 3: False}


def test_files_written_and_read(spark, tmp_path):
    labels = spark.createDataFrame([(f"l{i}", i) for i in range(2500)], "label string, coverage_id long")
    write_manifests(labels, str(tmp_path / "m"), per_file=1000)
    assert len(list((tmp_path / "m").glob("part=*"))) == 3
    assert {(r.label, int(r.coverage_id)) for r in read_manifest(spark, str(tmp_path / "m")).collect()} == {(f"l{i}", i) for i in range(2500)}
    words = spark.createDataFrame([("mining", "ore_grade"), ("mining", "output"), ("retail", "store_count")], "industry string, kpi string")
    write_vocabulary(words, str(tmp_path / "v"))
    assert {tuple(r) for r in read_vocabulary(spark, str(tmp_path / "v")).collect()} == {("mining", "ore_grade"), ("mining", "output"), ("retail", "store_count")}
