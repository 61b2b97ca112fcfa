"""Markdown that the answers are written in: headed blocks, pipe tables, verdict lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The headings and lines that the answers' formats prescribe.
QUESTION = r"###\s*Q(\d+):\s*(.+)"
SECTION = r"##\s*SECTION\s*(\d+):\s*(.+)"
PRIMER_SECTION = r"##\s*(\d+)\.\s*(.+)"
FINAL_SUMMARY = r"(?m)^##\s*FINAL SUMMARY\s*$"
EXECUTION = r"(?i)Execution vs expectations:\s*(Improving|Stable|Deteriorating)"
CREDIBILITY = r"(?i)Management credibility:\s*(Strong|Mixed|Weak)"
MOMENTUM = r"(?i)Business momentum(?:\s*vs\s*last\s*year)?:\s*(Better|Same|Worse)"
CREDIBILITY_READ = r"(?i)management\s+credibility[:\s]+(strong|mixed|weak)"
POSITIVE = r"(?i)\b(?:grow(?:th|ing)?|increas(?:e|ed|ing)|expand(?:ed|ing)?|record|strong|improv(?:e|ed|ing)|accelerat(?:e|ed|ing))\b"
NOT_FOUND = "not found in uploaded documents"
TABLE_BLOCK = r"(?m)(?:^[ \t]*\|.*\|[ \t]*$\n?)+"
TABLE_RULE = r"^\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def headed_blocks(text: Column, head: str, stop: str | None = None) -> Column:
    """array(struct(number, title, body)): a body goes on to the next heading, or to a line that begins with ``stop``."""
    until = f"(?={head})" + (f"|(?={stop})" if stop else "")
    blocks = F.filter(F.split(text, f"(?m)^(?:{until})", -1), lambda b: b.rlike(f"^{head}"))
    whole = f"(?s)^{head.replace('(.+)', '([^\\n]+)')}(.*)$"
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, whole, 1).cast("int").alias("number"), strip(F.regexp_extract(b, whole, 2)).alias("title"), strip(F.regexp_extract(b, whole, 3)).alias("body")))


def first_group(text: Column, pattern: str) -> Column:
    """The first match's group, null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def pipe_tables(text: Column) -> Column:
    """array(table), a table being array(row of cells): runs of lines between pipes, without the ruling lines."""
    trim = lambda line: F.regexp_replace(strip(line), r"^\|+|\|+$", "")
    rows = lambda block: F.filter(F.split(block, "\n", -1), lambda line: (strip(line) != "") & ~strip(line).rlike(TABLE_RULE))
    return F.transform(F.regexp_extract_all(text, F.lit(TABLE_BLOCK), F.lit(0)), lambda b: F.transform(rows(b), lambda r: F.transform(F.split(trim(r), r"\|", -1), strip)))
