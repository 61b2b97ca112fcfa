"""Byte-level BPE over recursive DuckDB queries, one connection in each Python worker.

Encoding: each text falls into chunks (white space and what follows it), which the
vocabulary's pattern splits into words without regard to their neighbours. A worker
remembers chunks and words; words it has not met go to DuckDB as token-position
rows, each with one number for its word and place, by which they are sorted. There a recursive query joins each row and its right neighbour with the merge
table and contracts every word's leftmost pair of minimum rank, all words at
once, until no word has a pair left. A word that is itself a token is that token.
Decoding joins (document, place, id) rows with the vocabulary and concatenates the
pieces in an ordered aggregation.

A word of n bytes leaves up to n * n / 2 rows in the recursion. Blocks of words are
cut by that number, and words over ``LONG_WORD`` bytes are contracted by the same rule
with a heap, in n log n steps, so a megabyte without a space ends too.

Every row is encoded where it lies: nothing is shuffled and nothing is kept, so a
lost executor's tasks simply run again.

Defined results: a null or empty text has no tokens; every row is one document, also
when ids repeat or are null; ids of any type pass through; an empty table gives
an empty table. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel
from .token_files import vocabulary_path

LONG_WORD = 256  # bytes: longer words don't go through the recursion
RECURSION_ROWS = 1 << 21  # rows that one recursive query may leave
CACHE = 300_000  # chunks and words that a worker remembers anew before it lets go of those it has not met since
STRETCH = 1 << 22  # characters, or ids, that go through at once
STEP = 1 << 20  # more than the bytes of a word and than all ranks: a pair's key is rank * STEP + place, a row's spot word * STEP + place

ENCODE = """
WITH RECURSIVE step(round, spot, token) AS (
  SELECT 0, word::BIGINT * {step} + place, token FROM words
  UNION ALL
  (WITH pair AS (SELECT *, lead(token) OVER near AS next, lead(spot) OVER near AS after, lag(spot) OVER near AS before
                 FROM step WINDOW near AS (ORDER BY spot)),
        best AS (SELECT spot // {step} AS word, min(merged::BIGINT * {step} + spot % {step}) AS best
                 FROM pair JOIN merges ON merges.pair = token::BIGINT * {step} + next WHERE after // {step} = spot // {step} GROUP BY 1)
   SELECT round + 1, spot, CASE WHEN spot % {step} = best % {step} THEN (best // {step})::INT ELSE token END
   FROM pair JOIN best ON best.word = spot // {step} WHERE before IS DISTINCT FROM word * {step} + best % {step}))
SELECT spot // {step} AS word, list(token ORDER BY spot) AS ids FROM step
WHERE (spot // {step}, round) IN (SELECT spot // {step}, max(round) FROM step GROUP BY 1) GROUP BY 1 ORDER BY 1
""".format(step=STEP)
DECODE = "SELECT doc, array_to_string(list(piece ORDER BY place), '') AS text FROM tokens JOIN vocab USING (token) GROUP BY doc ORDER BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 and rank lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def class_differences(classes: tuple[str, ...] = (r"\p{L}", r"\p{N}")) -> set[str]:
    """Characters that the regex library takes into a class and tiktoken's doesn't (other Unicode versions)."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found: set[str] = set()
    for kind in classes:
        theirs = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found |= set(regex.findall(kind, every)) ^ set(bytes(theirs.encode_ordinary(every)).decode())
    return found


class BytePairs:
    """Encodes and decodes with one vocabulary; holds the DuckDB connection and what it has met."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.blanks_meet, self.chunk, self.cut = regex.compile(r"\s "), regex.compile(r"\s*\S+|\s+"), regex.compile(r"\S(?= )")
        self.differ = class_differences()
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
        self.letters_stay = r" ?\p{L}+" in pattern.split("|") and all(self.pattern.findall(x + letters) == [x + letters] for x in ("", " "))
        self.as_other = dict.fromkeys(map(ord, self.differ), "!")  # neither letter, digit nor space
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(self.ranks.values()) + 1
        self.packed = {w: np.array(i, "<u4").tobytes() for w, i in self.ranks.items()}
        self.known: dict[str, bytes] = {}  # ids of the chunks and words met of late
        self.older: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        pairs = [(self.ranks[w[:i]], self.ranks[w[i:]], r) for w, r in self.ranks.items() for i in range(1, len(w)) if w[:i] in self.ranks and w[i:] in self.ranks]
        left, right, merged = (pa.array(x, pa.int32()) for x in zip(*pairs)) if pairs else [pa.array([], pa.int32())] * 3
        # A byte is the character of its number, since only text can be aggregated in order.
        pieces = pa.array([w.decode("latin-1") for w in self.ranks])
        for name, table in (("merges", pa.table({"pair": left.cast(pa.int64()).to_numpy() * STEP + right.to_numpy(), "merged": merged})), ("vocab", pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()), "piece": pieces}))):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")

    def _query(self, sql: str, name: str, table: pa.Table) -> pa.Table:
        self.con.register(name, table)
        found = self.con.sql(sql).to_arrow_table()
        self.con.unregister(name)
        return found

    def contract_long(self, word: bytes) -> bytes:
        """The same rule for one long word: a heap of (rank, place), entries of changed neighbours are stale."""
        token = [int(i) for i in self.first[np.frombuffer(word, np.uint8)]]
        n = len(word)
        end = list(range(1, n + 1))  # where the token that starts here ends; 0: no token starts here
        before = list(range(-1, n - 1))

        def pair(i: int):
            j = end[i]
            rank = self.ranks.get(word[i : end[j]]) if j < n else None
            return None if rank is None else (rank, i, end[j])

        heap = [x for i in range(n) if (x := pair(i))]
        heapq.heapify(heap)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop or self.ranks.get(word[i:stop]) != rank:
                continue
            token[i], end[i], end[j] = rank, stop, 0
            if stop < n:
                before[stop] = i
            for k in (before[i], i):
                if k >= 0 and (x := pair(k)):
                    heapq.heappush(heap, x)
        return np.array([t for t, e in zip(token, end) if e], "<u4").tobytes()

    def _learn_words(self, words: set[str]) -> None:
        missing = []
        for w in words:
            raw = w.encode()
            if raw in self.packed:
                self.known[w] = self.packed[raw]
            else:
                missing.append((raw, w))
        missing.sort(key=lambda x: len(x[0]))  # words of one length end in the same round
        length = np.array([len(raw) for raw, _ in missing], np.int64)
        rows = np.cumsum(length * length // 2 + 1)
        short, a = int(np.searchsorted(length, LONG_WORD, "right")), 0
        while a < short:
            b = min(short, max(a + 1, int(np.searchsorted(rows, (rows[a - 1] if a else 0) + RECURSION_ROWS, "right"))))
            n = length[a:b]
            word = np.repeat(np.arange(b - a, dtype=np.int32), n)
            place = np.arange(len(word)) - (np.cumsum(n) - n)[word]
            token = self.first[np.frombuffer(b"".join(raw for raw, _ in missing[a:b]), np.uint8)]
            ids = self._query(ENCODE, "words", pa.table({"word": word, "place": place.astype(np.int32), "token": token})).column("ids").combine_chunks()
            flat, offs = ids.values.to_numpy().astype("<u4").tobytes(), (ids.offsets.to_numpy() * 4).tolist()
            self.known.update((w, flat[i:j]) for (_, w), i, j in zip(missing[a:b], offs, offs[1:]))
            a = b
        self.known.update((w, self.contract_long(raw)) for raw, w in missing[short:])

    def _split(self, chunk: str) -> list[str]:
        if chunk.isascii() or self.differ.isdisjoint(chunk):
            return self.pattern.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pattern.finditer(chunk.translate(self.as_other))]

    def _learn(self, chunks: set[str]) -> None:
        plain = {c for c in chunks if c.isascii() and c.removeprefix(" ").isalpha()} if self.letters_stay else set()
        split = {c: self._split(c) for c in chunks - plain}
        self._learn_words(plain.union(w for ws in split.values() for w in ws if w not in self.known))
        self.known.update((c, b"".join(map(self.known.__getitem__, ws))) for c, ws in split.items() if len(ws) != 1)

    def _chunks(self, text: str) -> list[str]:
        """Pieces that the pattern splits independently: no match reaches over the place where white space follows a character."""
        if self.blanks_meet.search(text):
            return self.chunk.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def _stretches(self, text: str):
        a = 0
        while len(text) - a > STRETCH and (m := self.cut.search(text, a + STRETCH)):
            yield text[a : m.end()]
            a = m.end()
        yield text[a:]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, size = [], 0
        for k, text in enumerate(texts):
            for part in self._stretches(text or ""):
                waiting.append((k, self._chunks(part)))
                size += len(part)
                if size >= STRETCH:
                    self._flush(waiting, out)
                    waiting, size = [], 0
        self._flush(waiting, out)
        return [b"".join(x) for x in out]

    def _flush(self, waiting: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known = self.known
        missing = {c for _, chunks in waiting for c in chunks if c not in known}
        again = missing & self.older.keys()
        known.update((c, self.older[c]) for c in again)
        if len(missing) > len(again):
            self._learn(missing - again)
        for k, chunks in waiting:
            out[k].append(b"".join(map(known.__getitem__, chunks)))

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes that each row of little-endian ids stands for."""
        ids = np.frombuffer(b"".join(packed), "<u4")
        if len(ids) and int(ids.max()) >= self.size:
            raise ValueError("an id is not in the vocabulary")
        doc = np.repeat(np.arange(len(packed), dtype=np.int32), [len(x) // 4 for x in packed])
        out: list[list[bytes]] = [[] for _ in packed]
        for a in range(0, len(ids), STRETCH):
            part = slice(a, a + STRETCH)
            found = self._query(DECODE, "tokens", pa.table({"doc": doc[part], "place": np.arange(len(ids[part]), dtype=np.int32), "token": ids[part].astype(np.int32)}))
            for k, text in zip(found.column("doc").to_pylist(), found.column("text").to_pylist()):
                out[k].append(text.encode("latin-1"))
        return [b"".join(x) for x in out]


_known: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One for all tasks of a worker."""
    if (path, pattern) not in _known:
        _known[path, pattern] = BytePairs(path, pattern)
    return _known[path, pattern]


def _encoded(batches, path: str, pattern: str):
    pairs = byte_pairs(path, pattern)
    for batch in batches:
        _, offs = kernel.as_bytes(batch.column("text"))
        for i, j in kernel.slices(offs, STRETCH):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(pairs.encode(batch.column("text").slice(i, j - i).to_pylist()), pa.binary())], ["doc_id", "packed"])
    kernel.trim()


def _decoded(batches, path: str, pattern: str):
    pairs = byte_pairs(path, pattern)
    for batch in batches:
        packed = batch.column("packed").to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pairs.decode([x or b"" for x in packed]), pa.binary())], [*batch.schema.names, "decoded"])


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, packed (its ids as little-endian unsigned 32-bit integers, end to end)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: _encoded(batches, path, pattern), f"doc_id {_kind(docs, doc_id)}, packed binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, packed, decoded (the bytes)."""
    return encoded.select("doc_id", "packed").mapInArrow(lambda batches: _decoded(batches, path, pattern), f"doc_id {_kind(encoded, 'doc_id')}, packed binary, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """decode(encode(docs)) in one Python worker a task, which then holds the vocabulary once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern), path, pattern), f"doc_id {_kind(docs, doc_id)}, packed binary, decoded binary")


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("packed"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
