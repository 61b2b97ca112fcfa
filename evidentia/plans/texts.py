"""Text operators and the citation gate over generated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citation as C, text as X
from ..functions.finance import let
from ..sources.views import Tables
from .registry import query

NL = "chr(10)"
CITE = r"""'\[([^\]]+),\s*([^\]]+)\]:\s*"([^"]{10,})"'"""
PARAS = f"list_filter(string_split(content, {NL} || {NL}), lambda p: trim(p) <> '')"
CLAIMS = rf"list_filter({PARAS}, lambda p: regexp_matches(p, '\d|\b(?:is|are|was|were|has|have|had)\b'))"
DIGITS = rf"list_filter({PARAS}, lambda p: regexp_matches(p, '\d'))"
SENTENCES = r"string_split_regex(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


def cover(claims: str) -> str:
    return f"CASE WHEN len({claims}) = 0 THEN 1.0::DOUBLE ELSE len(list_filter({claims}, lambda p: regexp_matches(p, {CITE})))::DOUBLE / len({claims}) END"


@query("split_paragraphs", rf"SELECT output_id, len(list_filter(string_split_regex(content, '\n\s*\n'), lambda p: trim(p) <> '')) AS n FROM v_answers")
def split_paragraphs(spark, d):
    return Tables(spark, d).answers().select("output_id", F.size(X.paragraphs(F.col("content"))).cast("long").alias("n"))


@query("split_sentences", rf"SELECT document_id, len(string_split_regex(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS n FROM v_corpus")
def split_sentences(spark, d):
    return Tables(spark, d).corpus().select("document_id", F.size(X.sentences(F.col("content"))).cast("long").alias("n"))


@query("token_estimate", r"SELECT document_id, CAST(floor(len(list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM v_corpus")
def token_estimate(spark, d):
    return Tables(spark, d).corpus().select("document_id", X.token_estimate(F.col("content")).cast("long").alias("tokens"))


@query("citations_extract", f"SELECT output_id, unnest(regexp_extract_all(content, {CITE}, 1)) AS doc, unnest(regexp_extract_all(content, {CITE}, 2)) AS section, unnest(regexp_extract_all(content, {CITE}, 3)) AS quote FROM v_answers")
def citations_extract(spark, d):
    c = Tables(spark, d).answers().select("output_id", F.explode(C.citations(F.col("content"))).alias("c"))
    return c.select("output_id", "c.doc", "c.section", "c.quote")


@query("citations_malformed", r"""SELECT output_id, len(list_filter(regexp_extract_all(replace(content, ']: "', '] : "') || ' Form: "short one"', '\[?[^\[\]\n]{1,80}\]?:\s*"[^"]{5,}"'), lambda a: NOT regexp_full_match(a, '\[([^\]]+),\s*([^\]]+)\]:\s*"([^"]{10,})"'))) AS n FROM v_answers""")
def citations_malformed(spark, d):
    bad = F.concat(F.replace("content", F.lit(']: "'), F.lit('] : "')), F.lit(' Form: "short one"'))
    return Tables(spark, d).answers().select("output_id", F.size(C.malformed(bad)).cast("long").alias("n"))


@query("citation_coverage_gate", f"SELECT output_id, {cover(CLAIMS)} AS coverage FROM v_answers")
def citation_coverage_gate(spark, d):
    return Tables(spark, d).answers().select("output_id", C.coverage(F.col("content")).alias("coverage"))


@query("citation_coverage_digits", f"SELECT output_id, {cover(DIGITS)} AS coverage FROM v_answers")
def citation_coverage_digits(spark, d):
    return Tables(spark, d).answers().select("output_id", C.coverage(F.col("content"), verbs=False).alias("coverage"))


@query("unsourced_numbers", rf"WITH s AS (SELECT output_id, {SENTENCES} AS s FROM v_answers) SELECT output_id, CAST(list_sum(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN NOT regexp_matches(s[i] || ' ' || coalesce(s[i + 1], ''), {CITE}) THEN len(regexp_extract_all(s[i], '\b\d+ million\b')) ELSE 0 END)) AS BIGINT) AS n FROM s")
def unsourced_numbers(spark, d):
    a = Tables(spark, d).answers()
    return a.select("output_id", F.size(F.filter(C.unsourced_numbers(F.col("content"), C.ALL), lambda x: x.rlike("million"))).cast("long").alias("n"))


@query("speculation", rf"SELECT output_id, len(list_filter({SENTENCES}, lambda s: regexp_matches(s, '(?i)\b(?:will\s+(?:grow|increase|decrease|improve|expand|reach)|expects?\s+to|expected\s+to|is\s+expected\s+to|analysts\s+predict|forecasts?|projects?)\b') AND NOT regexp_matches(s, {CITE}))) AS n FROM (SELECT output_id, replace(content, 'We expect growth', 'Management expects to see growth') AS content FROM v_answers)")
def speculation(spark, d):
    a = Tables(spark, d).answers().withColumn("content", F.replace("content", F.lit("We expect growth"), F.lit("Management expects to see growth")))
    return a.select("output_id", F.size(C.speculation(F.col("content"), C.ALL)).cast("long").alias("n"))


@query("inference_labels", rf"SELECT output_id, len(list_filter({SENTENCES}, lambda s: regexp_matches(s, '(?i)\b(?:appears?\s+to|seems?\s+to|likely|probably|presumably|suggests?\s+that|implies?\s+that)\b') AND NOT regexp_matches(s, '(?i)\(inferred from'))) AS n FROM (SELECT output_id, replace(content, 'This suggests strength', 'This likely holds') AS content FROM v_answers)")
def inference_labels(spark, d):
    a = Tables(spark, d).answers().withColumn("content", F.replace("content", F.lit("This suggests strength"), F.lit("This likely holds")))
    return a.select("output_id", F.size(C.unlabelled_inference(F.col("content"), C.ALL)).cast("long").alias("n"))


VERDICT = f"SELECT output_id, CASE WHEN {cover(CLAIMS)} >= 0.95 THEN 'approved' WHEN {cover(DIGITS)} >= 0.8 THEN 'partial' ELSE 'failed' END AS status, {cover(DIGITS)} AS cover FROM v_answers"


def verdicts(spark, d):
    """(output_id, status, cover): the enforcer's verdict on each answer; the answer is built once."""
    covers = let(F.col("content"), lambda t: F.struct(C.coverage(t).alias("every"), C.coverage(t, verbs=False).alias("digits")))
    a = Tables(spark, d).answers().select("output_id", covers.alias("c"))
    return a.select("output_id", C.verdict(F.col("c.every") >= C.APPROVED_FROM, F.col("c.digits")).alias("status"), F.col("c.digits").alias("cover"))


@query("enforcer_verdict", f"SELECT output_id, status FROM ({VERDICT})")
def enforcer_verdict(spark, d):
    return verdicts(spark, d).select("output_id", "status")


@query("retry_prompt")
def retry_prompt(spark, d):
    """Failed checks and their first three items, as the instruction for a retry. Sentences are split once for three checks, and each check runs once."""
    t = F.col("content")
    part = lambda name, items: let(items, lambda x: F.when(F.size(x) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(x, 1, 3), "; "))))
    low = F.when(C.coverage(t) < C.APPROVED_FROM, F.lit("citation_coverage: cite every claim"))
    checks = lambda s: (part("unsourced_numbers", C.unsourced_in(s)), part("speculation", C.speculation_in(s)), part("inference", C.unlabelled_in(s)))
    prompt = let(X.sentences(t), lambda s: F.concat_ws("\n", low, part("quote_format", C.malformed(t)), *checks(s)))
    return Tables(spark, d).answers().select("output_id", prompt.alias("prompt"))


@query("qblocks_parse", r"SELECT output_id, CAST(regexp_extract(b, '^### Q(\d+): ([^\n]+)', 1) AS INTEGER) AS number, regexp_extract(b, '^### Q(\d+): ([^\n]+)', 2) AS title FROM (SELECT output_id, unnest(string_split_regex(regexp_replace(content, '(^|\n)(### Q)', chr(1) || '\2', 'g'), chr(1))) AS b FROM v_answers) WHERE b LIKE '### Q%'")
def qblocks_parse(spark, d):
    blocks = Tables(spark, d).answers().select("output_id", F.explode(F.split("content", r"(?m)^(?=### Q\d+: )", -1)).alias("b")).filter("b like '### Q%'")
    head = r"^### Q(\d+): (.+)"
    return blocks.select("output_id", F.regexp_extract("b", head, 1).cast("int").alias("number"), F.regexp_extract("b", head, 2).alias("title"))


@query("not_found_items", r"SELECT output_id, len(regexp_extract_all(content, '(?i)[^.\n]*not found in uploaded documents\.?')) AS n FROM v_answers")
def not_found_items(spark, d):
    return Tables(spark, d).answers().select("output_id", F.size(F.filter(F.split(F.lower("content"), r"[.\n]", -1), lambda s: s.contains("not found in uploaded documents"))).cast("long").alias("n"))


@query("company_type", "SELECT output_id, CASE WHEN contains(lower(content), 'slow grower') THEN 'slow grower' WHEN contains(lower(content), 'stalwart') THEN 'stalwart' WHEN contains(lower(content), 'fast grower') THEN 'fast grower' WHEN contains(lower(content), 'cyclical') THEN 'cyclical' WHEN contains(lower(content), 'turnaround') THEN 'turnaround' WHEN contains(lower(content), 'asset play') THEN 'asset play' END AS company_type FROM v_answers")
def company_type(spark, d):
    t, out = F.lower("content"), F.lit(None).cast("string")
    for phrase in reversed(("slow grower", "stalwart", "fast grower", "cyclical", "turnaround", "asset play")):
        out = F.when(t.contains(phrase), phrase).otherwise(out)
    return Tables(spark, d).answers().select("output_id", out.alias("company_type"))


FOOTNOTES = f"""SELECT output_id, list_aggregate(list_transform(parts, lambda p, i: p || CASE WHEN i <= len(marks) THEN '[^' || list_position(firsts, marks[i]) || ']' ELSE '' END), 'string_agg', '') AS body FROM (
    SELECT *, list_filter(marks, lambda m, i: list_position(marks, m) = i) AS firsts FROM (SELECT output_id, string_split_regex(content, {CITE}) AS parts, regexp_extract_all(content, {CITE}) AS marks FROM v_answers))"""


@query("footnote_render", FOOTNOTES)
def footnote_render(spark, d):
    """Citations become numbered marks, in order of first appearance; the text is cut at its citations once."""
    a = Tables(spark, d).answers().select("output_id", F.split("content", C.CITATION, -1).alias("parts"), F.regexp_extract_all("content", F.lit(C.CITATION), F.lit(0)).alias("marks"))
    a = a.withColumn("firsts", F.array_distinct("marks"))
    mark = lambda i: F.when(i < F.size("marks"), F.concat(F.lit("[^"), F.array_position("firsts", F.get("marks", i)).cast("string"), F.lit("]"))).otherwise("")
    return a.select("output_id", F.array_join(F.transform("parts", lambda p, i: F.concat(p, mark(i))), "").alias("body"))


@query("json_fence_parse", "SELECT output_id, output_id AS kpi FROM v_answers")
def json_fence_parse(spark, d):
    """Fenced JSON out of prose, else what stands between the braces."""
    wrapped = F.concat(F.lit("Here it is:\n```json\n{\"kpi\": "), F.col("output_id").cast("string"), F.lit("}\n```\nDone."))
    inner = F.coalesce(F.nullif(F.regexp_extract(wrapped, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.regexp_extract(wrapped, r"(?s)(\{.*\})", 1))
    return Tables(spark, d).answers().select("output_id", F.from_json(inner, "kpi long")["kpi"].alias("kpi"))


@query("evidence_context", "SELECT coverage_id, string_agg('[doc_' || output_id || ', ' || coverage_id || ']: \"' || replace(content, chr(10), ' ') || '\"', chr(10) ORDER BY output_id) AS context FROM (SELECT *, row_number() OVER (PARTITION BY coverage_id ORDER BY output_id) AS rn FROM v_answers) WHERE rn <= 5 GROUP BY 1")
def evidence_context(spark, d):
    from ..operators.frames import first_per

    best = first_per(Tables(spark, d).answers(), ["coverage_id"], F.col("output_id"), n=5)
    line = F.concat(F.lit("[doc_"), F.col("output_id").cast("string"), F.lit(", "), "coverage_id", F.lit(']: "'), F.replace("content", F.lit("\n"), F.lit(" ")), F.lit('"'))
    return best.select("coverage_id", F.struct("output_id", line.alias("line")).alias("x")).groupBy("coverage_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("context"))
