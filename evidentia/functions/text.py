"""Text expressions: splitting, tokens, sections, block kinds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Stop words, section headings (the first that matches wins), block forms.
STOPWORDS = """
a an the and or but if while of at by for with about against between into through during before after above below to from up down in out on off
over under again further then once here there all any both each few more most other some such no nor not only own same so than too very s t can
will just don should now is are was were be been being have has had do does did doing this that these those i you he she it we they what which
who whom as
""".split()
SECTIONS = (
    ("business", r"(?i)item\s+1\.?\s+business"),
    ("risk_factors", r"(?i)item\s+1a\.?\s+risk\s+factors"),
    ("mda", r"(?i)item\s+7\.?\s+management.?s\s+discussion\s+and\s+analysis"),
    ("financial_statements", r"(?i)item\s+8\.?\s+financial\s+statements"),
    ("notes_to_financials", r"(?i)notes?\s+to\s+(?:the\s+)?(?:consolidated\s+)?financial\s+statements"),
    ("controls", r"(?i)item\s+9a\.?\s+controls\s+and\s+procedures"),
    ("exhibits", r"(?i)item\s+15\.?\s+exhibits"),
)
LIST_ITEM = r"^\s*([\-\*•●]|\d+[.)])\s+"
CAPTION = r"(?i)^\s*(figure|table|exhibit)\s*\d*[:.]"
HEADING_RATIO, HEADING_DELTA = 1.15, 2.0


def not_blank(parts: Column) -> Column:
    return F.filter(parts, lambda p: F.regexp_replace(p, r"(?U)\s+", "") != "")


def paragraphs(text: Column) -> Column:
    return not_blank(F.split(text, r"\n\s*\n", -1))


def chunk_sentences(text: Column) -> Column:
    return not_blank(F.split(text, r"(?<=[.\n])\s+", -1))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+", -1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+", -1), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, cut down."""
    return F.floor(word_count(text) * 1.3).cast("int")


def all_tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text; a dotted capital I is the one letter i, as in the twins, not i and a dot."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("\u0130"), F.lit("i"))), F.lit("[a-z0-9]+"), F.lit(0))


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def index_tokens(text: Column) -> Column:
    return without_stopwords(all_tokens(text))


def term_weight(count: Column, k1: float = 1.5) -> Column:
    """Saturating term frequency of a corpus of one document."""
    return count * (k1 + 1) / (count + k1)


def section_of(heading: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS):
        out = F.when(heading.rlike(pattern), name).otherwise(out)
    return out


def block_kind(text: Column, size: Column, largest: Column, median: Column) -> Column:
    big = (size > median * HEADING_RATIO) | (size - median > HEADING_DELTA)
    return F.when(text.rlike(LIST_ITEM), "list_item").when(text.rlike(CAPTION), "caption").when((size >= largest - 0.5) & big, "heading").otherwise("paragraph")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def page_text(html: Column) -> Column:
    """Tags become blanks, scripts and styles go, runs of white space are one blank."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "), "^ | $", "")
