"""Rules over outputs: cases join the rules of their suite, each rule gives one check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.citation import attempts, citations, coverage
from ..functions.markdown import NOT_FOUND, QUESTION, headed_blocks, strip
from ..functions.text import sentences, word_count

# A percentage, and the line that counts upserted KPIs.
PERCENT = r"\d+(?:\.\d+)?\s*%"
UPSERTED = r"(\d+)\s+KPI value\(s\) upserted"
SKIP, EXECUTION, MOST_HALLUCINATIONS = "skip_citation_checks", "execution", "max_hallucinations"
PATTERNS = ("must_contain_regex", "citation_format")  # rules whose argument is a pattern


def _blocks(t: Column) -> Column:
    return headed_blocks(t, QUESTION)


def _holds(t: Column, arg: Column, num: Column) -> dict[str, Column]:
    """Whether a text keeps a rule, by the rule's kind."""
    low, phrase = F.lower(t), F.lower(arg)
    upserted = F.coalesce(F.regexp_extract(t, UPSERTED, 1).try_cast("int"), F.lit(0))
    return {
        "must_start_with": F.startswith(strip(t), arg),
        "must_answer_question": F.exists(_blocks(t), lambda b: b["number"] == num),
        "question_not_found": F.exists(_blocks(t), lambda b: (b["number"] == num) & F.lower(b["body"]).contains(NOT_FOUND)),
        "must_not_state": ~F.exists(sentences(t), lambda s: F.contains(F.lower(s), phrase) & s.rlike(PERCENT)),
        "must_not_contain": ~F.contains(low, phrase),
        "must_contain": F.contains(low, phrase),
        "must_contain_section": F.contains(low, phrase),
        "must_contain_any": F.exists(F.split(phrase, r"\|"), lambda p: F.contains(low, p)),
        "must_contain_regex": F.rlike(t, arg),
        "must_cite_section": F.exists(citations(t), lambda c: F.contains(F.lower(c["section"]), phrase)),
        "min_citation_coverage": coverage(t, verbs=False) >= num,
        "max_word_count": word_count(t) <= num,
        "min_word_count": word_count(t) >= num,
        "citation_format": ~F.exists(attempts(t), lambda a: ~F.rlike(a, F.concat(F.lit("^(?:"), arg, F.lit(")$")))),
        "min_kpis_upserted": upserted >= num,
    }


def broken_patterns(rules: DataFrame) -> list[tuple[str, str]]:
    """(pattern, error) of the rules' arguments that are no pattern. The rules are a stated set; its distinct patterns are compiled once in the driver."""
    compile_ = rules.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile
    out = []
    for row in rules.filter(F.col("kind").isin(*PATTERNS) & F.col("arg").isNotNull()).select("arg").distinct().toLocalIterator():
        try:
            compile_(row.arg)
        except Exception as e:
            out.append((row.arg, str(getattr(e, "java_exception", e)).split("\n")[0]))
    return out


def run_checks(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, kind, arg, num, passed, error). cases: (case_id, suite, content); rules: (suite, kind, arg, num).

    A case without content failed to run: that is its only check. In a suite with
    SKIP only the opening is checked. A rule whose pattern is broken fails its own check, with the
    error, and no other. The rules are a stated set of unknown size to Spark, which would deal all texts out by their few suites; so they are broadcast, and a text is evaluated where it lies.
    """
    broken = rules.sparkSession.createDataFrame(broken_patterns(rules), "arg string, error string")
    rules = rules.filter(F.col("kind") != MOST_HALLUCINATIONS).join(broken.withColumnRenamed("arg", "bad"), F.col("kind").isin(*PATTERNS) & (F.col("arg") == F.col("bad")), "left").withColumn("used", F.when(F.col("bad").isNull(), F.col("arg")))
    brief = rules.groupBy("suite").agg(F.bool_or(F.col("kind") == SKIP).alias("brief"))
    wanted = rules.join(brief, "suite").filter((F.col("kind") != SKIP) & (~F.col("brief") | (F.col("kind") == "must_start_with")))
    failed = cases.filter("content is null").select("case_id", F.lit(EXECUTION).alias("kind"), F.lit(None).cast("string").alias("arg"), F.lit(None).cast("double").alias("num"), F.lit(False).alias("passed"), F.lit("the case failed to run").alias("error"))
    verdict = F.lit(None).cast("boolean")
    for kind, holds in _holds(F.col("content"), F.col("used"), F.col("num")).items():
        verdict = F.when(F.col("kind") == kind, holds).otherwise(verdict)
    ran = cases.filter("content is not null").join(F.broadcast(wanted.select("suite", "kind", "arg", "num", "used", "error")), "suite")
    return ran.select("case_id", "kind", "arg", "num", F.when(F.col("error").isNull(), verdict).otherwise(False).alias("passed"), "error").unionByName(failed)


def score_citations(cases: DataFrame, status: DataFrame) -> DataFrame:
    """(case_id, hallucinations, paraphrases, citations) per case, zeros without citations. status: (doc, status) of cited items."""
    cited = cases.filter("content is not null").select("case_id", F.explode(citations(F.col("content"))).alias("c")).select("case_id", F.col("c.doc").alias("doc"))
    counts = cited.join(status, "doc", "left").groupBy("case_id").agg(F.count_if(F.coalesce("status", F.lit("hallucinated")) == "hallucinated").alias("h"), F.count_if(F.col("status") == "paraphrase").alias("p"), F.count("*").alias("n"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return cases.select("case_id").join(counts, "case_id", "left").select("case_id", zero("h", "hallucinations"), zero("p", "paraphrases"), zero("n", "citations"))


def case_results(checks: DataFrame, triples: DataFrame, cases: DataFrame, rules: DataFrame) -> DataFrame:
    """(case_id, passed, n_failed): all checks hold, and no more citations are hallucinated than the case's suite allows (0 without such a rule)."""
    limit = rules.filter(F.col("kind") == MOST_HALLUCINATIONS).groupBy("suite").agg(F.max("num").alias("most"))
    limits = cases.select("case_id", "suite").join(F.broadcast(limit), "suite", "left").select("case_id", F.coalesce("most", F.lit(0.0)).alias("most"))
    per = checks.groupBy("case_id").agg(F.count_if(~F.col("passed")).alias("bad"))
    bad = F.coalesce("bad", F.lit(0)) + (F.col("hallucinations") > F.col("most")).cast("int")
    return triples.join(per, "case_id", "left").join(limits, "case_id").select("case_id", (bad == 0).alias("passed"), bad.cast("long").alias("n_failed"))

