"""Citations in generated text, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .finance import let
from .text import sentences

# The citation form, looser attempts at it, and the phrases that the checks look for.
CITATION = r'\[([^\]]+),\s*([^\]]+)\]:\s*"([^"]{10,})"'
ATTEMPT = r'\[?[^\[\]\n]{1,80}\]?:\s*"[^"]{5,}"'
NUMBER = r"(?i)(?<!\[)\b\d[\d,]*\.?\d*\s*(?:billion|million|thousand|%|percent|B|M|K)\b"
SPECULATION = r"(?i)\b(?:will\s+(?:grow|increase|decrease|improve|expand|reach)|expects?\s+to|expected\s+to|is\s+expected\s+to|analysts\s+predict|forecasts?|projects?)\b"
INFERENCE = r"(?i)\b(?:appears?\s+to|seems?\s+to|likely|probably|presumably|suggests?\s+that|implies?\s+that)\b"
BLANKS = " \t\n\x0b\f\r"
CLAIM_VERBS = ("is", "are", "was", "were", "has", "have", "had")
APPROVED_FROM, PARTIAL_FROM = 0.95, 0.80
ALL = (1 << 31) - 1  # for counts: every hit, not only those that a retry prompt shows


def citations(text: Column) -> Column:
    """array(struct(doc, section, quote)); the last comma in the brackets parts document and section."""
    part = lambda g: F.regexp_extract_all(text, F.lit(CITATION), F.lit(g))
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.struct(x["a"].alias("doc"), x["b"].alias("section"), x["c"].alias("quote")))


def near_quotes(text: Column) -> Column:
    """The text without what no attempt can hold: the same attempts at a fraction of the search.

    An attempt's head has at most 82 characters before its colon, no line end, and no bracket but as its first and last; a quotation mark
    follows the colon, and its quote holds none. So of a stretch between marks only what follows the last line end or bracket can begin one (that
    character stays, so that no head goes over it), and of that the last 110 characters; behind a colon a stretch may be the quote and stays whole.
    """
    colon_last = lambda s: F.rtrim(s, F.lit(BLANKS)).endswith(":")

    def tail(s, inner):
        """The end of s; a head's own colon and closing bracket follow its first ``inner`` characters."""
        free = F.substring_index(F.substring_index(F.substring_index(F.left(s, inner), "\n", -1), "]", -1), "[", -1)
        return F.right(s, F.char_length(s) - inner + F.least(inner, F.char_length(free) + 1, F.lit(110)))

    def cut(s, before):
        u = F.rtrim(s, F.lit(BLANKS))
        inner = F.when(u.endswith("]:"), F.char_length(u) - 2).when(u.endswith(":"), F.char_length(u) - 1).otherwise(F.char_length(s))
        return F.when(F.coalesce(colon_last(before), F.lit(False)), s).otherwise(let(inner, lambda n: tail(s, n)))

    return let(F.split(text, '"', -1), lambda parts: F.array_join(F.transform(parts, lambda s, i: cut(s, F.get(parts, i - 1))), '"'))


def attempts(text: Column) -> Column:
    return F.regexp_extract_all(near_quotes(text), F.lit(ATTEMPT), F.lit(0))


def malformed(text: Column) -> Column:
    return F.filter(attempts(text), lambda a: ~a.rlike("^(?:" + CITATION + ")$"))


def has_citation(text: Column) -> Column:
    return text.rlike(CITATION)


def claim_paragraphs(text: Column, verbs: bool = True) -> Column:
    """Paragraphs with a digit, or with a claim verb."""
    parts = F.filter(F.transform(F.split(text, "\n\n", -1), lambda p: F.btrim(p, F.lit(BLANKS))), lambda p: p != "")
    wanted = r"\d|\b(?:" + "|".join(CLAIM_VERBS) + r")\b" if verbs else r"\d"
    return F.filter(parts, lambda p: p.rlike(wanted))


def coverage(text: Column, verbs: bool = True) -> Column:
    """Share of claim paragraphs with a citation; 1 without claims."""
    return let(claim_paragraphs(text, verbs), lambda claims: F.when(F.size(claims) == 0, 1.0).otherwise(F.size(F.filter(claims, has_citation)) / F.size(claims)))  # split once a text


def unsourced_numbers(text: Column, most: int = 5) -> Column:
    """Numbers with units in sentences where neither the sentence nor the next one cites."""
    return let(sentences(text), lambda s: unsourced_in(s, most))  # split once a text


def unsourced_in(parts: Column, most: int = 5) -> Column:
    bare = F.filter(parts, lambda x, i: x.rlike(r"\d") & ~F.concat_ws(" ", x, F.get(parts, i + 1)).rlike(CITATION))
    return F.slice(F.flatten(F.transform(bare, lambda x: F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)))), 1, most)


def flagged_sentences(parts: Column, pattern: str, unless: str, most: int = 3, width: int = 100) -> Column:
    """Sentences with a phrase but without what excuses it."""
    hit = F.filter(parts, lambda s: s.rlike(pattern) & ~s.rlike(unless))
    return F.slice(F.transform(hit, lambda s: F.left(s, F.lit(width))), 1, most)


def speculation_in(parts: Column, most: int = 3) -> Column:
    return flagged_sentences(parts, SPECULATION, CITATION, most)


def speculation(text: Column, most: int = 3) -> Column:
    return speculation_in(sentences(text), most)


def unlabelled_in(parts: Column, most: int = 3) -> Column:
    return flagged_sentences(parts, INFERENCE, r"(?i)\(inferred from", most)


def unlabelled_inference(text: Column, most: int = 3) -> Column:
    return unlabelled_in(sentences(text), most)


def verdict(passed: Column, cover: Column) -> Column:
    return F.when(passed, "approved").when(cover >= PARTIAL_FROM, "partial").otherwise("failed")
