"""Evaluation of outputs by rules that are rows, the citations' triple, results and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.evaluation import case_results, run_checks, score_citations
from ..sources.views import Tables
from .registry import query
from .retrieval import CASCADE, VERBATIM, quote_status
from .texts import CITE, DIGITS, SENTENCES, cover

# The suites' rules: (suite, kind, argument, number).
RULES = [
    (0, "must_start_with", "### Q1:", None), (0, "must_answer_question", None, 1.0), (0, "must_answer_question", None, 4.0), (0, "question_not_found", None, 3.0),
    (0, "must_not_state", "gross margin", None), (0, "must_not_contain", "Guaranteed", None), (0, "must_contain", "REVENUE", None), (0, "must_contain_section", "Numbers", None),
    (0, "min_citation_coverage", None, 0.5), (0, "min_kpis_upserted", None, 3.0),
    (1, "must_start_with", "## Q1", None), (1, "must_contain_any", "Fast Grower|cyclical", None), (1, "must_contain_regex", r"Q\d+: [A-Z]", None), (1, "must_cite_section", "SRC", None),
    (1, "max_word_count", None, 200.0), (1, "min_word_count", None, 60.0), (1, "citation_format", r'\[item_[^,]+, [^\]]+\]: "[^"]{10,}"', None), (1, "min_citation_coverage", None, 0.95), (1, "must_contain_regex", "([", None), (1, "max_hallucinations", None, 1.0),
    (2, "skip_citation_checks", None, None), (2, "must_start_with", "### Q1:", None), (2, "must_contain", "revenue", None),
]
text_ = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
ROWS = ", ".join(f"({s}, '{k}', {text_(a)}, {'NULL' if n is None else f'{n}::DOUBLE'})" for s, k, a, n in RULES if (s != 2 or k == "must_start_with") and k != "max_hallucinations")
BLOCKS = r"list_filter(string_split_regex(regexp_replace(content, '(^|\n)(###\s*Q\d+:)', chr(1) || '\2', 'g'), chr(1)), lambda b: regexp_matches(b, '^###\s*Q\d+:'))"
NUMBER = r"CAST(regexp_extract(b, '^###\s*Q(\d+):', 1) AS INTEGER)"
HOLDS = {
    "must_start_with": "starts_with(trim(content, ' ' || chr(9) || chr(10)), arg)",
    "must_answer_question": f"len(list_filter({BLOCKS}, lambda b: {NUMBER} = num)) > 0",
    "question_not_found": f"len(list_filter({BLOCKS}, lambda b: {NUMBER} = num AND contains(lower(b), 'not found in uploaded documents'))) > 0",
    "must_not_state": rf"len(list_filter({SENTENCES}, lambda s: contains(lower(s), lower(arg)) AND regexp_matches(s, '\d+(?:\.\d+)?\s*%'))) = 0",
    "must_not_contain": "NOT contains(lower(content), lower(arg))",
    "must_contain": "contains(lower(content), lower(arg))",
    "must_contain_section": "contains(lower(content), lower(arg))",
    "must_contain_any": "len(list_filter(string_split(lower(arg), '|'), lambda p: contains(lower(content), p))) > 0",
    "must_contain_regex": "CASE WHEN arg = '([' THEN false ELSE regexp_matches(content, CASE WHEN arg = '([' THEN 'x' ELSE arg END) END",  # a broken pattern fails its check
    "must_cite_section": f"len(list_filter(regexp_extract_all(content, {CITE}, 2), lambda s: contains(lower(s), lower(arg)))) > 0",
    "min_citation_coverage": f"{cover(DIGITS)} >= num",
    "max_word_count": r"len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) <= num",
    "min_word_count": r"len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) >= num",
    "citation_format": r"""len(list_filter(regexp_extract_all(content, '\[?[^\[\]\n]{1,80}\]?:\s*"[^"]{5,}"'), lambda a: NOT regexp_full_match(a, arg))) = 0""",
    "min_kpis_upserted": r"coalesce(TRY_CAST(regexp_extract(content, '(\d+)\s+KPI value\(s\) upserted', 1) AS INTEGER), 0) >= num",
}
CHECKS = "chk AS (SELECT case_id, kind, arg, num, CASE " + " ".join(f"WHEN kind = '{k}' THEN {sql}" for k, sql in HOLDS.items()) + f""" END AS passed FROM v_cases JOIN (VALUES {ROWS}) AS r(s, kind, arg, num) ON r.s = suite WHERE content IS NOT NULL
    UNION ALL SELECT case_id, 'execution', NULL, NULL, false FROM v_cases WHERE content IS NULL)"""
TRIPLES = rf"""cit AS (SELECT case_id, unnest(regexp_extract_all(content, {CITE}, 1)) AS doc FROM v_cases),
    trp AS (SELECT c.case_id, count(CASE WHEN doc IS NOT NULL AND coalesce(q.status, 'hallucinated') = 'hallucinated' THEN 1 END) AS hallucinations, count(CASE WHEN q.status = 'paraphrase' THEN 1 END) AS paraphrases, count(doc) AS citations
            FROM (SELECT case_id FROM v_cases) c LEFT JOIN cit USING (case_id) LEFT JOIN qst q ON 'item_' || q.quote_id = cit.doc GROUP BY 1)"""
RESULTS = """res AS (SELECT t.case_id, coalesce(b.bad, 0) + CASE WHEN hallucinations > CASE v.suite WHEN 1 THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS n_failed FROM trp t JOIN (SELECT case_id, suite FROM v_cases) v USING (case_id) LEFT JOIN (SELECT case_id, count(*) FILTER (WHERE NOT passed) AS bad FROM chk GROUP BY 1) b USING (case_id))"""


def _rules(spark):
    return spark.createDataFrame(RULES, "suite int, kind string, arg string, num double")


def _checks(spark, d):
    return run_checks(Tables(spark, d).cases(), _rules(spark))


def _triples(spark, d, verbatim: bool = False):
    status = quote_status(spark, d, verbatim).select(F.concat(F.lit("item_"), F.col("quote_id").cast("string")).alias("doc"), "status")
    return score_citations(Tables(spark, d).cases(), status)


def _results(spark, d):
    return case_results(_checks(spark, d), _triples(spark, d), Tables(spark, d).cases(), _rules(spark))


@query("eval_checks", f"WITH {CHECKS} SELECT case_id, kind, arg, num, passed FROM chk")
def eval_checks(spark, d):
    """Every rule of every case, and the failed executions."""
    return _checks(spark, d).drop("error")


def _register(kind: str) -> None:
    @query(f"eval_{kind}", f"WITH {CHECKS} SELECT case_id, arg, num, passed FROM chk WHERE kind = '{kind}'")
    def one(spark, d):
        rules = _rules(spark).filter(F.col("kind").isin(kind, "skip_citation_checks"))
        return run_checks(Tables(spark, d).cases(), rules).filter(F.col("kind") == kind).select("case_id", "arg", "num", "passed")


for _kind in [*HOLDS, "execution"]:
    _register(_kind)


@query("eval_triples", f"WITH {VERBATIM}, {TRIPLES} SELECT case_id, hallucinations, paraphrases, citations FROM trp")
def eval_triples(spark, d):
    return _triples(spark, d, verbatim=True)


@query("eval_case_results", f"WITH {CASCADE}, {CHECKS}, {TRIPLES}, {RESULTS} SELECT case_id, n_failed = 0 AS passed, n_failed FROM res")
def eval_case_results(spark, d):
    return _results(spark, d)


@query("eval_failed_case_ids", f"WITH {CASCADE}, {CHECKS}, {TRIPLES}, {RESULTS} SELECT case_id FROM res WHERE n_failed > 0")
def eval_failed_case_ids(spark, d):
    return _results(spark, d).filter(~F.col("passed")).select("case_id")


@query("eval_summary", f"""WITH {CASCADE}, {CHECKS}, {TRIPLES}, {RESULTS}
    SELECT c.suite, count(*) AS case_count, avg(CASE WHEN n_failed = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS pass_rate, round(avg(CASE WHEN c.content IS NULL THEN 0.0::DOUBLE ELSE {cover(DIGITS).replace('content', 'c.content')} END), 9) AS avg_citation_coverage,
        coalesce(sum(hallucinations)::DOUBLE / nullif(sum(citations), 0), 0.0::DOUBLE) AS hallucination_rate, CAST(sum(paraphrases) AS BIGINT) AS total_paraphrase_warnings, round(avg(e.value), 6) AS avg_latency_ms
    FROM v_cases c JOIN res USING (case_id) JOIN trp USING (case_id) LEFT JOIN events e ON e.event_id = c.case_id GROUP BY 1""")
def eval_summary(spark, d):
    """The report's figures per suite; a case's latency is its event's measured value."""
    from ..functions.citation import coverage

    cases = Tables(spark, d).cases().select("case_id", "suite", F.coalesce(coverage(F.col("content"), verbs=False), F.lit(0.0)).alias("coverage"), F.col("content").isNull().alias("failed"))
    triples = _triples(spark, d)
    latency = Tables(spark, d).raw("events").select(F.col("event_id").alias("case_id"), F.col("value").alias("latency"))
    j = cases.join(case_results(_checks(spark, d), triples, Tables(spark, d).cases(), _rules(spark)), "case_id").join(triples, "case_id").join(latency, "case_id", "left")
    cover_ = F.when(F.col("failed"), 0.0).otherwise(F.col("coverage"))
    return j.groupBy("suite").agg(
        F.count("*").alias("case_count"), F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)).alias("pass_rate"), F.round(F.avg(cover_), 9).alias("avg_citation_coverage"),
        F.coalesce(F.try_divide(F.sum("hallucinations").cast("double"), F.sum("citations")), F.lit(0.0)).alias("hallucination_rate"), F.sum("paraphrases").alias("total_paraphrase_warnings"), F.round(F.avg("latency"), 6).alias("avg_latency_ms"),
    )


@query("eval_release_gate", f"""WITH {CASCADE}, {CHECKS}, {TRIPLES}, {RESULTS}
    SELECT c.suite, min(CASE WHEN n_failed = 0 THEN 1 ELSE 0 END) = 1 AS pass_ok, round(avg(CASE WHEN c.content IS NULL THEN 0.0::DOUBLE ELSE {cover(DIGITS).replace('content', 'c.content')} END), 9) >= 0.95 AS coverage_ok,
        coalesce(sum(hallucinations)::DOUBLE / nullif(sum(citations), 0), 0.0::DOUBLE) <= 0.005 AS hallucination_ok FROM v_cases c JOIN res USING (case_id) JOIN trp USING (case_id) GROUP BY 1""")
def eval_release_gate(spark, d):
    """All cases pass, 95 % of the claims are cited, at most 0.5 % of the citations are hallucinated."""
    s = eval_summary(spark, d)
    return s.select("suite", (F.col("pass_rate") >= 1.0).alias("pass_ok"), (F.col("avg_citation_coverage") >= 0.95).alias("coverage_ok"), (F.col("hallucination_rate") <= 0.005).alias("hallucination_ok"))
