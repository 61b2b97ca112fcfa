"""Queries that SQL can't express, against plain Python over the smallest tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from evidentia import plans
from evidentia.functions.text import STOPWORDS
from evidentia.streaming.tasks import cut_safe

DIR = "/root/testdata/sf0.001"


def table(name, *columns):
    return pq.read_table(f"{DIR}/{name}.parquet", columns=list(columns)).to_pylist()


def tokens(text):
    return math.floor(len(text.split()) * 1.3)


def parents(text):
    """Paragraphs are added to the open parent until the next one would pass the limit."""
    out, size = [], 0
    for p in (p for p in re.split(r"\n\s*\n", text.replace("\n", "\n\n")) if p.strip()):
        if out and size + tokens(p) <= 2000:
            out[-1], size = f"{out[-1]}\n\n{p}", size + tokens(p)
        else:
            out.append(p)
            size = tokens(p)
    return out


def child_texts(text):
    """(content, start, end): sentences until 200 tokens; the next child repeats the fewest sentences that hold 20 tokens."""
    s, at, places = [x for x in re.split(r"(?<=[.\n])\s+", text) if x.strip()], 0, []
    for x in s:
        places.append(text.index(x, at))
        at = places[-1] + len(x)
    n, out, i = [tokens(x) for x in s], [], 0
    while i < len(s):
        j = i + 1
        while j < len(s) and sum(n[i : j + 1]) <= 200:
            j += 1
        out.append((" ".join(s[i:j]), places[i], places[j - 1] + len(s[j - 1])))
        if j == len(s):
            break
        k = j
        while k > i + 1 and sum(n[k:j]) < 20:
            k -= 1
        i = k
    return out


@pytest.fixture(scope="module")
def chunks():
    return {r["doc_id"]: parents(r["text"] or "") for r in table("documents", "doc_id", "text")}


def test_parents(spark, chunks):
    got = {r.chunk_id: (r.document_id, r.n_chars) for r in plans.QUERIES["chunk_parents"](spark, DIR).collect()}
    assert got == {d * 10000 + k: (d, len(p)) for d, ps in chunks.items() for k, p in enumerate(ps)}


def test_children_and_their_places(spark, chunks):
    want = {(d * 10000 + k, i): c for d, ps in chunks.items() for k, p in enumerate(ps) for i, c in enumerate(child_texts(p))}
    got = {(r.chunk_id, r.child): (r.content, r.token_estimate) for r in plans.QUERIES["chunk_children"](spark, DIR).collect()}
    assert got == {k: (c, tokens(c)) for k, (c, _, _) in want.items()} and len(got) > len(chunks)
    places = {(r.chunk_id, r.child): (r.char_start, r.char_end) for r in plans.QUERIES["chunk_offsets"](spark, DIR).collect()}
    assert places == {k: (a, b) for k, (_, a, b) in want.items()}
    counts = {r.document_id: r.n_searchable for r in plans.QUERIES["chunk_searchable_count"](spark, DIR).collect()}
    assert counts == Counter(k // 10000 for k, _ in want)


def test_hashed_weights(spark):
    stop, sums = set(STOPWORDS), defaultdict(lambda: defaultdict(float))
    for r in table("documents", "doc_id", "text"):
        for t, f in Counter(t for t in re.findall("[a-z0-9]+", (r["text"] or "").lower()) if t not in stop).items():
            sums[zlib.crc32(t.encode()) % 30000][r["doc_id"]] += f * 2.5 / (f + 1.5)
    got = {r.bucket: (r.df, r.weight) for r in plans.QUERIES["sparse_tf_hashed"](spark, DIR).collect()}
    assert got == {b: (len(w), pytest.approx(sum(w.values()), abs=1e-5)) for b, w in sums.items()}


def test_turns_in_order(spark):
    turns, want = defaultdict(list), []
    for r in sorted(table("conversations", "conv_id", "turn", "text"), key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append(r["text"] or "")
    for conv, texts in turns.items():
        held, pos = "", 0
        for i, text in enumerate(texts):
            ready, held = cut_safe(held + text, i + 1 == len(texts))
            if ready:
                want.append((conv, pos, ready))
                pos += 1
    assert sorted(plans.QUERIES["citation_safe_chunks"](spark, DIR).collect()) == sorted(want)


CITE = re.compile(r'\[([^\]]+),\s*([^\]]+)\]:\s*"([^"]{10,})"')


def test_retry_prompts(spark):
    """The queries that the prompt is made from are compared with SQL; here, that it names what they find."""
    find = lambda name, column: {r.output_id: r[column] for r in plans.QUERIES[name](spark, DIR).collect()}
    prompt, cover = find("retry_prompt", "prompt"), find("citation_coverage_gate", "coverage")
    answers = {r.output_id: r.content for r in plans.texts.Tables(spark, DIR).answers().collect()}
    assert prompt.keys() == answers.keys()
    number = re.compile(r"(?i)(?<!\[)\b\d[\d,]*\.?\d*\s*(?:billion|million|thousand|%|percent|B|M|K)\b")
    for i, text in answers.items():
        lines = dict(x.split(": ", 1) for x in prompt[i].split("\n") if x)
        assert ("citation_coverage" in lines) == (cover[i] < 0.95)
        s = re.split(r"(?<=[.!?])\s+", text)
        bare = [m for x, y in zip(s, [*s[1:], None]) if not CITE.search(x if y is None else f"{x} {y}") for m in number.findall(x)]
        assert lines.get("unsourced_numbers", "") == "; ".join(bare[:3])
