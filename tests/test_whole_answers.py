"""The answer queries over whole texts against brute force: far citations, quotes, missing and empty texts."""

import re

import pytest

from evidentia import plans

CITE = re.compile(r'\[([^\]]+),\s*([^\]]+)\]:\s*"([^"]{10,})"')
FAR = " Then sales of 77 million came. It likely holds. They expect to grow. The board expects to see 12 million more."
TEXTS = [(i, ("Plain words stand here without end. " * 4 + FAR) * (i % 3 + 1) + f'\nA "last" line number {i}' + FAR * i) for i in range(1, 9)] + [(20, None), (21, ""), (22, "short")]


def answer(i, text):
    parts = [p.strip() for p in re.split(r"\n|(?<=[.!?])\s+", (text or "").replace('"', " "))]
    parts = [p for p in parts if p]
    cite = lambda p: f' [doc_{i}, web]: "{p}"'
    body = "\n\n".join(p + cite(p) if i % 2 == 0 and k % 2 == 0 else p for k, p in enumerate(parts))
    number = f"Revenue increased to {len(text or '')} million." if i % 3 == 0 else "Margins declined over time."
    last = cite(parts[-1]) if i % 2 == 0 and parts else ""
    spec = " We expect growth to continue. This suggests strength." if i % 5 == 0 else ""
    return f"### Q1: Business\n{body}\n\n### Q2: Numbers\n{number}{last}{spec}\n\n### Q5: Type\n" + {0: "Fast Grower", 1: "Stalwart"}.get(i % 4, "Not found in uploaded documents.")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("answers"))
    rows = [(i, t, "en", "web", len(t or "")) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def sentences(t):
    return re.split(r"(?<=[.!?])\s+", t)


def coverage(t, wanted):
    claims = [p for p in (p.strip() for p in t.split("\n\n")) if p and re.search(wanted, p)]
    return sum(bool(CITE.search(p)) for p in claims) / len(claims) if claims else 1.0


def millions(t):
    s = sentences(t)
    return sum(len(re.findall(r"\b\d+ million\b", x)) for x, y in zip(s, [*s[1:], ""]) if not CITE.search(f"{x} {y}"))


def footnotes(t):
    seen = {}
    return CITE.sub(lambda m: f"[^{seen.setdefault(m[0], len(seen) + 1)}]", t)


def flagged(t, phrase, unless):
    return sum(bool(re.search(phrase, s)) and not re.search(unless, s) for s in sentences(t))


VALUES = {
    "split_paragraphs": ("n", lambda t: len([p for p in re.split(r"\n\s*\n", t) if p.strip()])),
    "citation_coverage_gate": ("coverage", lambda t: coverage(t, r"\d|\b(?:is|are|was|were|has|have|had)\b")),
    "citation_coverage_digits": ("coverage", lambda t: coverage(t, r"\d")),
    "unsourced_numbers": ("n", millions),
    "speculation": ("n", lambda t: flagged(t.replace("We expect growth", "Management expects to see growth"), r"\bexpects?\s+to\b", CITE)),
    "inference_labels": ("n", lambda t: flagged(t.replace("This suggests strength", "This likely holds"), r"\blikely\b", r"\(inferred from")),
    "footnote_render": ("body", footnotes),
    "eval_rules": ("words", lambda t: len(t.split())),
}


@pytest.mark.parametrize("name", sorted(VALUES))
def test_whole_texts(spark, folder, name):
    column, brute = VALUES[name]
    got = {r.output_id: r[column] for r in plans.QUERIES[name](spark, folder).collect()}
    assert got == {i: pytest.approx(brute(answer(i, t))) if column == "coverage" else brute(answer(i, t)) for i, t in TEXTS}


def test_every_citation_of_whole_texts(spark, folder):
    got = sorted((r.output_id, r.doc, r.section, r.quote) for r in plans.QUERIES["citations_extract"](spark, folder).collect())
    assert got == sorted((i, *c) for i, t in TEXTS for c in CITE.findall(answer(i, t))) and len(got) > 20
