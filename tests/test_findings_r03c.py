"""Cases of the third round's findings on growth: work that is done once, and searches that keep to where something can be."""

import random
import re

from pyspark.sql import functions as F

from evidentia import plans
from evidentia.functions import citation as C
from tests.test_parity import DIR


def test_attempts_begin_after_the_last_bracket(spark):
    """cited sentences of usual length aren't searched; attempts stay the same, also over quotation marks, brackets and line ends in odd places."""
    r = random.Random(7)
    bits = ['"', '"', '"', ":", ":", "]:", "]: ", "[", "]", "\n", "a", "bc", " ", "x" * 40, "y" * 79, "z" * 81, "[d, s]: ", "quote"]
    some = ["".join(r.choices(bits, k=r.randint(0, 16))) for _ in range(4000)]
    got = spark.createDataFrame([(t,) for t in some], "t string").select("t", C.attempts(F.col("t")).alias("a")).collect()
    assert all(row.a == re.findall(C.ATTEMPT, row.t) for row in got) and sum(len(row.a) for row in got) > 100
    text = "".join(f'\n\n{"word " * 36}[doc_1, s]: "as it was reported"' for _ in range(50))
    row = spark.createDataFrame([(text,)], "t string").select(C.attempts(F.col("t")).alias("a"), F.char_length(C.near_quotes(F.col("t"))).alias("n")).first()
    assert row.a == re.findall(C.ATTEMPT, text) and row.n < 0.3 * len(text)


def test_checks_of_a_prompt_run_once(spark):
    """one split into sentences for three checks (and one for the view's paragraphs), each check once."""
    plan = plans.QUERIES["retry_prompt"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])\\s+") == 2
    assert all(plan.count(p) == 1 for p in ("analysts\\s+predict", "presumably", C.ATTEMPT))


def test_cells_are_made_in_one_pass(spark):
    """header cells come with the first row's cells, and a table's grid and its caption read the lines once each."""
    plan = plans.QUERIES["chunk_table_render"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in x and "l_orderkey" in x for x in plan.splitlines()) == 2


def test_scans_read_small_batches(spark):
    """what a worker gets at a time doesn't grow to Spark's 64 MB with the tables' partitions."""
    from evidentia.operators import scan_search as S

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    v = spark.range(4).selectExpr("id AS chunk_id", "array(1.0D, double(id)) AS vector", "'a b' AS content")
    q = v.selectExpr("chunk_id AS query_id", "vector AS query_vector", "content AS text")
    try:
        for scan in (S.dense_scan, S.sparse_scan):
            spark.conf.set(key, str(64 << 20))
            scan(q, v, 1)
            assert spark.conf.get(key) == str(S.BATCH_BYTES) == str(4 << 20)
    finally:
        spark.conf.set(key, before)
