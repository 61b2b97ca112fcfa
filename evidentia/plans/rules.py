"""Evaluation rules, gates, workflow routing and prerequisites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.citation import coverage
from ..functions.text import word_count
from ..sources.views import Tables
from ..streaming.stateful import tasks_after
from .layout import PAGES, page_text_coverage
from .registry import query
from .texts import CLAIMS, VERDICT, cover, verdicts

CASES = f"""SELECT output_id, content, content LIKE '### Q1:%' AS starts, contains(content, '### Q2: ') AND contains(content, '### Q5: ') AS answers,
    contains(lower(content), 'not found') AS not_found, NOT contains(lower(content), 'guaranteed') AS clean, {cover(CLAIMS)} AS coverage,
    len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS words FROM v_answers"""


def _cases(spark, d):
    t = F.col("content")
    return Tables(spark, d).answers().select(
        "output_id", t.startswith("### Q1:").alias("starts"), (t.contains("### Q2: ") & t.contains("### Q5: ")).alias("answers"), F.lower(t).contains("not found").alias("not_found"),
        (~F.lower(t).contains("guaranteed")).alias("clean"), coverage(t).alias("coverage"), word_count(t).cast("long").alias("words"),
    )


@query("eval_rules", f"SELECT output_id, starts, answers, not_found, clean, coverage, words FROM ({CASES})")
def eval_rules(spark, d):
    return _cases(spark, d)


@query("eval_report_aggregate", f"SELECT count(*) AS n, avg(CASE WHEN starts AND answers AND words <= 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pass_rate, round(avg(coverage), 9) AS avg_coverage FROM ({CASES})")
def eval_report_aggregate(spark, d):
    passed = F.col("starts") & F.col("answers") & (F.col("words") <= 60)
    return _cases(spark, d).agg(F.count("*").alias("n"), F.avg(F.when(passed, 1.0).otherwise(0.0)).alias("pass_rate"), F.round(F.avg("coverage"), 9).alias("avg_coverage"))


@query("eval_gate", f"SELECT avg(coverage) >= 0.95 AS coverage_ok, avg(CASE WHEN starts AND answers THEN 1.0 ELSE 0.0 END) >= 1.0 AS pass_ok FROM ({CASES})")
def eval_gate(spark, d):
    return _cases(spark, d).agg((F.avg("coverage") >= 0.95).alias("coverage_ok"), (F.avg(F.when(F.col("starts") & F.col("answers"), 1.0).otherwise(0.0)) >= 1.0).alias("pass_ok"))


ROUTE = "CASE WHEN NOT primer THEN 'build_primer' WHEN n_filings < 3 THEN 'ask_for_filings' WHEN status = 'setup' THEN 'bull_case' WHEN status = 'active' THEN 'quarterly_update' ELSE 'done' END"
READY = """SELECT c.coverage_id, c.status, coalesce(i.primer_content IS NOT NULL, false) AS primer, coalesce(f.n, 0) AS n_filings, coalesce(f.y, 0) AS n_years
    FROM v_coverages c LEFT JOIN v_industries i ON i.industry_id = c.industry_id LEFT JOIN (SELECT coverage_id, count(*) AS n, count(DISTINCT period) AS y FROM v_filings GROUP BY 1) f ON f.coverage_id = c.coverage_id"""


def _ready(spark, d):
    t = Tables(spark, d)
    f = t.filings().groupBy("coverage_id").agg(F.count("*").alias("n"), F.count_distinct("period").alias("y"))
    i = t.industries().select("industry_id", F.col("primer_content").isNotNull().alias("primer"))
    j = t.coverages().join(i, "industry_id", "left").join(f, "coverage_id", "left")
    return j.select("coverage_id", "status", F.coalesce("primer", F.lit(False)).alias("primer"), F.coalesce("n", F.lit(0)).alias("n_filings"), F.coalesce("y", F.lit(0)).alias("n_years"))


@query("prerequisites", f"SELECT coverage_id, primer, n_filings, n_years, primer AND n_years >= 3 AS ready FROM ({READY})")
def prerequisites(spark, d):
    return _ready(spark, d).select("coverage_id", "primer", "n_filings", "n_years", (F.col("primer") & (F.col("n_years") >= 3)).alias("ready"))


@query("workflow_route", f"SELECT coverage_id, {ROUTE} AS next_step FROM ({READY})")
def workflow_route(spark, d):
    route = F.when(~F.col("primer"), "build_primer").when(F.col("n_filings") < 3, "ask_for_filings").when(F.col("status") == "setup", "bull_case").when(F.col("status") == "active", "quarterly_update").otherwise("done")
    return _ready(spark, d).select("coverage_id", route.alias("next_step"))


@query("quality_gate", f"WITH {PAGES} SELECT doc_id, CASE WHEN round(length(text) / (area / 100), 9) < 0.5 THEN 'review_needed' ELSE 'indexed' END AS ingest_status FROM pg")
def quality_gate(spark, d):
    """Pages whose text covers less than half of what their area could hold are for review."""
    return page_text_coverage(spark, d).select("doc_id", F.when(F.col("coverage") < 0.5, "review_needed").otherwise("indexed").alias("ingest_status"))


TASKS = f"vd AS ({VERDICT}), tk AS (SELECT output_id // 4 AS task_id, min(CASE WHEN status = 'approved' THEN output_id % 4 + 1 END) AS ok, max(output_id % 4 + 1) AS n, max(CASE WHEN output_id % 4 = 3 THEN cover END) AS cover FROM vd GROUP BY 1)"


def attempts(spark, d):
    """(task_id, attempt, verdict, cover): four neighbouring answers are a task's attempts, judged by the enforcer."""
    i = F.col("output_id")
    return verdicts(spark, d).select(F.floor(i / 4).alias("task_id"), (i % 4 + 1).alias("attempt"), F.col("status").alias("verdict"), "cover")


@query("retry_decision", f"WITH {TASKS} SELECT task_id, CASE WHEN ok IS NOT NULL THEN 'complete' WHEN n < 4 THEN 'waiting' WHEN cover >= 0.8 THEN 'partial' ELSE 'failed' END AS status, coalesce(ok - 1, least(n, 3)) AS retry_count FROM tk")
def retry_decision(spark, d):
    """A task's state after its attempts: three more after a rejected one, then partial or failed."""
    return tasks_after(attempts(spark, d)).select("task_id", "status", "retry_count")
