"""Outputs of analysts taken apart: sections, verdicts, primers, answers, pipe tables, citations in the interface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown as M
from ..functions.citation import CITATION, coverage, has_citation
from ..functions.text import sentences, word_count
from ..operators.frames import first_per
from ..sources.views import Tables
from .registry import query
from .texts import CITE, DIGITS, SENTENCES, cover

NOT_FOUND = "contains(lower({}), 'not found in uploaded documents')"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def blocks_sql(view: str, key: str, head: str, stop: str = "") -> str:
    """(key, number, title, body) of a view's headed blocks, for the twins."""
    cut = f"regexp_replace(content, '(^|\\n)({head}{stop})', chr(1) || '\\2', 'g')"
    return f"""(SELECT {key}, CAST(regexp_extract(b, '^{head}', 1) AS INTEGER) AS number, {STRIP.format(f"regexp_extract(b, '^{head}([^\\n]+)', 2)")} AS title, {STRIP.format(f"regexp_replace(b, '^{head}[^\\n]+', '')")} AS body
        FROM (SELECT {key}, unnest(string_split({cut}, chr(1))) AS b FROM {view}) WHERE regexp_matches(b, '^{head}'))"""


SECTIONS = blocks_sql("v_reports", "output_id", r"##\s*SECTION\s*(\d+):\s*", r"|##\s*FINAL SUMMARY\s*\n")
PRIMER = blocks_sql("v_primers", "industry_id", r"##\s*(\d+)\.\s*", r"|##\s*Investor Synthesis\s*\n")
ANSWERS = blocks_sql("v_cases", "case_id", r"###\s*Q(\d+):\s*")


def _sections(spark, d):
    r = Tables(spark, d).reports()
    return r.select("output_id", F.explode(M.headed_blocks(F.col("content"), M.SECTION, r"##\s*FINAL SUMMARY")).alias("s")).select("output_id", "s.*")


@query("report_sections", f"SELECT output_id, number, title, md5(body) AS body FROM {SECTIONS}")
def report_sections(spark, d):
    return _sections(spark, d).select("output_id", "number", "title", F.md5("body").alias("body"))


@query("report_verdicts", r"""WITH v AS (SELECT output_id, nullif(regexp_extract(content, '(?i)Execution vs expectations:\s*(Improving|Stable|Deteriorating)', 1), '') AS execution, nullif(regexp_extract(content, '(?i)Management credibility:\s*(Strong|Mixed|Weak)', 1), '') AS credibility,
    nullif(regexp_extract(content, '(?i)Business momentum(?:\s*vs\s*last\s*year)?:\s*(Better|Same|Worse)', 1), '') AS momentum FROM v_reports) SELECT *, execution IS NOT NULL AND credibility IS NOT NULL AND momentum IS NOT NULL AS complete FROM v""")
def report_verdicts(spark, d):
    """The three verdicts of a final summary; a report that lacks one is refused."""
    t = F.col("content")
    has = F.rlike(t, F.lit(M.FINAL_SUMMARY))
    v = Tables(spark, d).reports().select("output_id", M.first_group(t, M.EXECUTION).alias("execution"), M.first_group(t, M.CREDIBILITY).alias("credibility"), M.first_group(t, M.MOMENTUM).alias("momentum"), has.alias("has"))
    return v.select("output_id", "execution", "credibility", "momentum", (F.col("has") & F.col("execution").isNotNull() & F.col("credibility").isNotNull() & F.col("momentum").isNotNull()).alias("complete"))


@query("report_section_rule", f"SELECT output_id, number, NOT (body <> '' AND NOT regexp_matches(body, {CITE}) AND NOT {NOT_FOUND.format('body')}) AS accepted FROM {SECTIONS}")
def report_section_rule(spark, d):
    """A section with content must cite, or say that nothing was found."""
    bad = (F.col("body") != "") & ~has_citation(F.col("body")) & ~F.lower("body").contains(M.NOT_FOUND)
    return _sections(spark, d).select("output_id", "number", (~bad).alias("accepted"))


@query("qblock_bodies", f"SELECT case_id, number, title, length(body) AS n_chars, md5(body) AS body FROM {ANSWERS}")
def qblock_bodies(spark, d):
    b = Tables(spark, d).cases().select("case_id", F.explode(M.headed_blocks(F.col("content"), M.QUESTION)).alias("b")).select("case_id", "b.*")
    return b.select("case_id", "number", "title", F.char_length("body").cast("long").alias("n_chars"), F.md5("body").alias("body"))


@query("answer_rules", f"""WITH a AS (SELECT case_id, number, body, regexp_matches(body, '\\d') AS claims FROM {ANSWERS}),
    x AS (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE body <> '' AND {cover(DIGITS).replace('content', 'body')} < 0.5 AND NOT {NOT_FOUND.format('body')}) AS rejected FROM a GROUP BY 1)
    SELECT x.case_id, n, rejected, n = 8 AND rejected = 0 AND {cover(DIGITS)} >= 0.9 AS valid FROM x JOIN v_cases c ON c.case_id = x.case_id""")
def answer_rules(spark, d):
    """Each answer cites half of its claims or says that nothing was found; a pitch has eight answers and cites 90 % over all."""
    c = Tables(spark, d).cases().filter("content is not null")
    blocks = M.headed_blocks(F.col("content"), M.QUESTION)
    bad = F.size(F.filter(blocks, lambda b: (b["body"] != "") & (coverage(b["body"], verbs=False) < 0.5) & ~F.lower(b["body"]).contains(M.NOT_FOUND))).cast("long")
    out = c.select("case_id", F.size(blocks).cast("long").alias("n"), bad.alias("rejected"), coverage(F.col("content"), verbs=False).alias("c"))
    return out.select("case_id", "n", "rejected", ((F.col("n") == 8) & (F.col("rejected") == 0) & (F.col("c") >= 0.9)).alias("valid"))


BULLETS = r"list_transform(regexp_extract_all(regexp_extract(content, '(?s)\n## Investor Synthesis\s*\n(.*)$', 1), '(?m)^-\s*(.+)$', 1), lambda b: trim(b))"
TOPICS = ("core_economic_engine", "primary_growth_lever", "structural_constraint", "key_risk", "winning_companies")


def _bullets(t):
    return F.regexp_extract_all(F.regexp_extract(t, r"(?s)\n## Investor Synthesis\s*\n(.*)$", 1), F.lit(r"(?m)^-\s*(.+)$"), F.lit(1))


@query("primer_structure", rf"""WITH n AS (SELECT industry_id, count(*) AS n_sections FROM {PRIMER} GROUP BY 1),
    x AS (SELECT p.industry_id, n_sections, len({BULLETS}) AS n_bullets, len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) AS n_words FROM v_primers p JOIN n ON n.industry_id = p.industry_id)
    SELECT *, n_sections = 6 AND n_bullets = 5 AND n_words BETWEEN 1200 AND 2000 AS valid FROM x""")
def primer_structure(spark, d):
    """Six sections, five bullets, 1200 to 2000 words."""
    t = F.col("content")
    p = Tables(spark, d).primers().select("industry_id", F.size(M.headed_blocks(t, M.PRIMER_SECTION, r"##\s*Investor Synthesis")).cast("long").alias("n_sections"), F.size(_bullets(t)).cast("long").alias("n_bullets"), word_count(t).cast("long").alias("n_words"))
    return p.select("*", ((F.col("n_sections") == 6) & (F.col("n_bullets") == 5) & F.col("n_words").between(1200, 2000)).alias("valid"))


@query("primer_synthesis", f"SELECT industry_id, [{', '.join(repr(t) for t in TOPICS)}][i] AS topic, ({BULLETS})[i] AS bullet FROM (SELECT *, unnest(range(1, least(len({BULLETS}), 5) + 1)) AS i FROM v_primers)")
def primer_synthesis(spark, d):
    b = Tables(spark, d).primers().select("industry_id", F.posexplode(_bullets(F.col("content"))).alias("i", "bullet")).filter(F.col("i") < len(TOPICS))
    return b.select("industry_id", F.get(F.array(*[F.lit(t) for t in TOPICS]), F.col("i")).alias("topic"), F.trim("bullet").alias("bullet"))


@query("primer_confidence", rf"WITH p AS (SELECT industry_id, list_filter(string_split(content, chr(10) || chr(10)), lambda p: trim(p) <> '') AS ps FROM v_primers) SELECT industry_id, round(len(list_filter(ps, lambda p: regexp_matches(p, {CITE})))::DOUBLE / greatest(len(ps), 1), 9) AS confidence FROM p")
def primer_confidence(spark, d):
    parts = F.filter(F.split("content", "\n\n", -1), lambda p: M.strip(p) != "")
    return Tables(spark, d).primers().select("industry_id", F.round(F.size(F.filter(parts, has_citation)) / F.greatest(F.size(parts), F.lit(1)), 9).alias("confidence"))


LATEST = "lr AS (SELECT coverage_id, arg_max(content, output_id) AS content, count(*) AS quarters FROM v_reports GROUP BY 1)"


def _latest(spark, d):
    """A coverage's latest report and how many it has."""
    r = Tables(spark, d).reports()
    latest = first_per(r, ["coverage_id"], F.desc("output_id")).select("coverage_id", "content")
    return latest.join(r.groupBy("coverage_id").agg(F.count("*").alias("quarters")), "coverage_id")


@query("credibility_read", rf"WITH {LATEST}, m AS (SELECT coverage_id, quarters, lower(regexp_extract(content, '(?i)management\s+credibility[:\s]+(strong|mixed|weak)', 1)) AS s FROM lr) SELECT coverage_id, upper(left(s, 1)) || substr(s, 2) AS score, quarters AS quarters_tracked FROM m WHERE s <> ''")
def credibility_read(spark, d):
    m = _latest(spark, d).select("coverage_id", F.initcap(F.regexp_extract("content", M.CREDIBILITY_READ, 1)).alias("score"), F.col("quarters").alias("quarters_tracked"))
    return m.filter("score <> ''")


FIRST_REVENUE = f"list_filter({SENTENCES}, lambda s: contains(lower(s), 'revenue'))[1]"
POSITIVE = r"'(?i)\b(?:grow(?:th|ing)?|increas(?:e|ed|ing)|expand(?:ed|ing)?|record|strong|improv(?:e|ed|ing)|accelerat(?:e|ed|ing))\b'"


@query("narrative_sentence", f"SELECT output_id, {FIRST_REVENUE} AS sentence, coalesce(regexp_matches({FIRST_REVENUE}, {POSITIVE}), false) AS positive FROM v_reports")
def narrative_sentence(spark, d):
    """The first sentence that names the KPI, and whether it sounds positive."""
    s = F.get(F.filter(sentences(F.col("content")), lambda x: F.lower(x).contains("revenue")), F.lit(0))
    return Tables(spark, d).reports().select("output_id", s.alias("sentence")).withColumn("positive", F.coalesce(F.rlike("sentence", F.lit(M.POSITIVE)), F.lit(False)))


@query("kpi_narrative_divergence", f"""WITH {LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY coverage_id ORDER BY extracted_at DESC, obs DESC) AS rn FROM v_kpis WHERE kpi_name = 'revenue'),
    f AS (SELECT coverage_id, count(*) AS n, arg_min(value, (extracted_at, obs)) AS first_value, arg_max(value, (extracted_at, obs)) AS last_value FROM r WHERE rn <= 6 GROUP BY 1)
    SELECT f.coverage_id, first_value, last_value, n >= 2 AND last_value < first_value AND coalesce(regexp_matches({FIRST_REVENUE}, {POSITIVE}), false) AS diverges FROM f JOIN lr ON lr.coverage_id = f.coverage_id""")
def kpi_narrative_divergence(spark, d):
    """The latest report praises a KPI whose last six observations fell."""
    k = Tables(spark, d).kpis().filter("kpi_name = 'revenue'")
    at = F.struct("extracted_at", "obs")
    f = first_per(k, ["coverage_id"], F.desc("extracted_at"), F.desc("obs"), n=6).groupBy("coverage_id").agg(F.count("*").alias("n"), F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))
    s = F.get(F.filter(sentences(F.col("content")), lambda x: F.lower(x).contains("revenue")), F.lit(0))
    said = _latest(spark, d).select("coverage_id", F.coalesce(F.rlike(s, F.lit(M.POSITIVE)), F.lit(False)).alias("positive"))
    return f.join(said, "coverage_id").select("coverage_id", "first_value", "last_value", ((F.col("n") >= 2) & (F.col("last_value") < F.col("first_value")) & F.col("positive")).alias("diverges"))


NOTE = """(SELECT l_orderkey AS output_id, 'Order ' || l_orderkey || chr(10) || '| Line | Flag |' || chr(10) || '| --- | :--: |' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || l_returnflag || ' |', chr(10) ORDER BY l_linenumber, l_returnflag) || chr(10) || 'End' || chr(10) || '  | a |' AS content FROM lineitem GROUP BY 1)"""


@query("pipe_tables", rf"""SELECT output_id, i AS number, array_to_string(list_transform(list_filter(string_split(bs[i], chr(10)), lambda l: trim(l) <> '' AND NOT regexp_matches(trim(l), '^\|?\s*:?-{{2,}}:?\s*(\|\s*:?-{{2,}}:?\s*)*\|?$')),
    lambda l: array_to_string(list_transform(string_split(trim(trim(l), '|'), '|'), lambda c: trim(c)), ';')), '/') AS cells
    FROM (SELECT output_id, bs, unnest(range(1, len(bs) + 1)) AS i FROM (SELECT output_id, regexp_extract_all(content, '(?m)(?:^[ \t]*\|.*\|[ \t]*$\n?)+') AS bs FROM {NOTE}))""")
def pipe_tables(spark, d):
    """The pipe tables of a text, without their ruling lines."""
    line = F.format_string("| %s | %s |", F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", line.alias("line"))))
    notes = Tables(spark, d).raw("lineitem").groupBy(F.col("l_orderkey").alias("output_id")).agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("rows"))
    content = F.concat(F.lit("Order "), F.col("output_id").cast("string"), F.lit("\n| Line | Flag |\n| --- | :--: |\n"), "rows", F.lit("\nEnd\n  | a |"))
    t = notes.select("output_id", F.posexplode(M.pipe_tables(content)).alias("i", "t"))
    return t.select("output_id", (F.col("i") + 1).cast("long").alias("number"), F.array_join(F.transform("t", lambda r: F.array_join(r, ";")), "/").alias("cells"))


TITLED = r"""\[([^\],]+),\s*([^\]]+)\]:\s*"([^"]{10,})\""""


@query("citations_first_comma", rf"""SELECT output_id, unnest(regexp_extract_all(content, '{TITLED}', 1)) AS doc, unnest(regexp_extract_all(content, '{TITLED}', 2)) AS section FROM (SELECT output_id, replace(content, ', ', ', part, ') AS content FROM v_reports)""")
def citations_first_comma(spark, d):
    """The interface's reading: the first comma in the brackets parts document and section, where the enforcer takes the last."""
    t = F.replace("content", F.lit(", "), F.lit(", part, "))
    part = lambda g: F.regexp_extract_all(t, F.lit(TITLED), F.lit(g))
    c = Tables(spark, d).reports().select("output_id", F.explode(F.arrays_zip(part(1).alias("doc"), part(2).alias("section"))).alias("c"))
    return c.select("output_id", "c.doc", "c.section")


@query("citation_insert", "SELECT item_id, '[doc_' || item_id || ', benchmark]: \"' || text || '\" ' AS inserted FROM benchmark")
def citation_insert(spark, d):
    return Tables(spark, d).raw("benchmark").select("item_id", F.format_string('[%s, %s]: "%s" ', F.concat(F.lit("doc_"), F.col("item_id").cast("string")), F.lit("benchmark"), "text").alias("inserted"))


@query("stream_first_citations", f"""WITH c AS (SELECT output_id, coverage_id, unnest(regexp_extract_all(content, {CITE}, 1)) AS doc, unnest(regexp_extract_all(content, {CITE}, 2)) AS section, unnest(regexp_extract_all(content, {CITE}, 3)) AS quote FROM v_reports)
    SELECT coverage_id, doc, section, quote, min(output_id) AS first_output FROM c GROUP BY 1, 2, 3, 4""")
def stream_first_citations(spark, d):
    """Of equal citations in a coverage's reports the first is announced, the others are not."""
    part = lambda g: F.regexp_extract_all("content", F.lit(CITATION), F.lit(g))
    c = Tables(spark, d).reports().select("output_id", "coverage_id", F.explode(F.arrays_zip(part(1).alias("doc"), part(2).alias("section"), part(3).alias("quote"))).alias("c")).select("output_id", "coverage_id", "c.*")
    return c.groupBy("coverage_id", "doc", "section", "quote").agg(F.min("output_id").alias("first_output"))


# The excuses whose return is counted.
EXCUSES = ("supply chain", "macro environment", "temporary", "one-time", "headwind")
EXCUSED = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN ' A {p} hurt us.'" for i, p in enumerate(EXCUSES)) + " ELSE '' END"


@query("excuse_phrase_frequency", f"""WITH e AS (SELECT doc_id, lower(coalesce(text, '') || {EXCUSED}) AS t, coalesce(lang, '') AS period FROM documents WHERE doc_id % 10 <> 9)
    SELECT phrase, count(*) AS n, count(DISTINCT period) AS n_periods, string_agg(DISTINCT period, ', ' ORDER BY period) AS periods FROM e JOIN (VALUES {', '.join(f"('{p}')" for p in EXCUSES)}) AS x(phrase) ON contains(t, phrase) GROUP BY 1""")
def excuse_phrase_frequency(spark, d):
    """How many earlier documents use each excuse, and in which periods; the current document (ids ending in 9) doesn't count."""
    i = F.col("doc_id")
    said = F.lit("")
    for k, p in enumerate(EXCUSES):
        said = F.when(i % 6 == k, F.lit(f" A {p} hurt us.")).otherwise(said)
    e = Tables(spark, d).raw("documents").filter(i % 10 != 9).select(F.lower(F.concat(F.coalesce("text", F.lit("")), said)).alias("t"), F.coalesce("lang", F.lit("")).alias("period"))
    hits = e.select("period", F.explode(F.filter(F.array(*[F.lit(p) for p in EXCUSES]), lambda p: F.contains(F.col("t"), p))).alias("phrase"))
    return hits.groupBy("phrase").agg(F.count("*").alias("n"), F.count_distinct("period").alias("n_periods"), F.array_join(F.array_sort(F.collect_set("period")), ", ").alias("periods"))
