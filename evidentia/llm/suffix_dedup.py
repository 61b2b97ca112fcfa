"""Removal of repeated passages with a logarithmic family of sparse suffix arrays.

A passage counts as repeated when ``length`` bytes of it also start in a document
with a smaller id. Full suffix arrays would hold every byte; ours hold the
suffixes at anchors: the owner of a ``length``-byte string is its first k-gram
with the smallest hash, so equal strings have equal owners at equal places, and
every string of a text has one. An entry of the index is an anchor's context:
the bytes after it, then the bytes before it in reverse, as far as the strings
that the anchor owns reach. A run is a suffix array: contexts in byte order, each once,
cut into buckets by the hash of the anchor's k-gram.

Batches come in ascending id order. A batch's contexts meet the buckets of the
runs that are there in a sort-merge join of bucketed tables, and both are merged
by suffix sorting from the first bytes on. All documents of older runs have smaller
ids, so runs need no ids. A context that has a smaller document loses all its strings;
where contexts share only the k-gram, their strings are grouped one offset at a time,
and what a hash calls equal is compared byte by byte. The batch's new contexts
become a run of level 0; two runs of a level merge into one of the next, so B
batches leave O(log B) runs and rewrite an entry O(log B) times.

Hot passages: a task keeps one entry of a context for its documents and settles
the others itself, so a passage of a third of all documents is a few entries per
task, and one per run. Long texts go through in pieces of ``SLICE`` bytes;
runs of one character or of a short period are one entry with a step and a count.

Defined results: a null text is empty; texts under ``length`` bytes lose
nothing; rows that repeat an id don't remove each other (equal ids are not
smaller); a row without an id keeps its text and removes nothing elsewhere; an
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel
from .workspace import Workspace

U = np.uint64
LENGTH, GRAM = 50, 16
SLICE = 400_000  # bytes of text at a time: a task holds about a dozen 64-bit arrays of this length
FLUSH = 150_000  # entries that a task gathers before it deals them out
BUCKET_BYTES = 4 << 20  # text per bucket of the index
BATCHES, BATCH_BYTES = 4, 1 << 40  # at least so many batches; more of them when the texts are larger
OLD = np.iinfo(np.int64).min  # stands for the ids of older runs
PLACE = (1 << 24) - 1
FIELDS = (("id", np.int64), ("uid", np.int64), ("pos", np.int64), ("step", np.int32), ("rep", np.int32))
MARK_FIELDS = (("uid", np.int64), ("pos", np.int64), ("mask", np.int64), ("step", np.int32), ("rep", np.int32))
MARKS = "uid long, pos long, mask long, step int, rep int"


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every n neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= n:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(x) - n + 1], out[n - have : n - have + len(x) - n + 1]) if have < n else out


def _widths(length: int, gram: int) -> tuple[int, int]:
    """Bytes of a context's right and left half: whole words, the last byte holds how many bytes count."""
    return -(-(length + 1) // 8) * 8, -(-(length - gram + 1) // 8) * 8


def _pieces(offs: np.ndarray, length: int):
    """Groups of (row, from, to) of about SLICE bytes; each string starts in one piece."""
    group, size = [], 0
    for row, n in enumerate(np.diff(offs).tolist()):
        for a in range(0, n - length + 1, SLICE):
            b = min(a + SLICE + length - 1, n)
            group.append((row, a, b))
            size += b - a
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """(text number, place, k-gram hash, context) of the owners of all strings of the texts."""
    right, left = _widths(length, gram)
    n, w = len(data), length - gram + 1
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(kernel._BYTE[data] * kernel.powers(kernel._BASE, n), out=run[1:])
    grams = kernel.mix((run[gram:] - run[:-gram]) * kernel.powers(kernel._UNBASE, n - gram + 1))
    low = _slide((grams & ~U(PLACE)) | np.arange(len(grams), dtype=np.uint64), w, np.minimum)
    inside = np.ones(len(low), bool)
    for end in offs[1:-1]:  # strings that reach into the next text
        inside[max(0, end - length + 1) : end] = False
    start = np.flatnonzero(inside)
    own = (low[start] & U(PLACE)).astype(np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    p, a, b = own[first], start[first], start[np.append(first[1:], len(start)) - 1]
    before, after = p - a, b + length - p
    ctx = np.zeros((len(p), right + left), np.uint8)
    k = np.arange(length)
    ctx[:, :length] = np.where(k < after[:, None], data[np.minimum(p[:, None] + k, n - 1)], 0)
    ctx[:, right - 1] = after
    k = np.arange(w - 1)
    ctx[:, right : right + w - 1] = np.where(k < before[:, None], data[np.maximum(p[:, None] - 1 - k, 0)], 0)
    ctx[:, -1] = before
    return np.searchsorted(offs, p, "right") - 1, p, grams[p], ctx


def _column(ctx: np.ndarray, c: int) -> np.ndarray:
    """Bytes 8c .. 8c+7 of the contexts as numbers in byte order."""
    return ctx[:, 8 * c : 8 * c + 8].copy().view(">u8").ravel().astype(np.uint64)


def _hash(ctx: np.ndarray) -> np.ndarray:
    h = np.zeros(len(ctx), np.uint64)
    for c in range(ctx.shape[1] // 8):
        h = kernel.mix(h * U(0x9FB21C651E98DF25) + _column(ctx, c) + U(c))
    return h


def _owned(ctx: np.ndarray, length: int, right: int) -> np.ndarray:
    """Bit j: the string that starts j bytes before the anchor belongs to it."""
    least, most = length - ctx[:, right - 1].astype(np.int64), ctx[:, -1].astype(np.int64)
    return (np.int64(1) << (most + 1)) - (np.int64(1) << least)


def suffix_order(ctx: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by bytes, where a new k-gram begins, where a new context begins): sorted by eight bytes, ties by the next."""
    first = _column(ctx, 0)
    order = np.argsort(first, kind="stable")
    new = np.ones(len(ctx), bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    new_gram = new.copy() if gram == 8 else None
    for c in range(1, ctx.shape[1] // 8):
        tied = ~new
        tied[:-1] |= ~new[1:]  # the head of a group of ties
        at = np.flatnonzero(tied)
        if len(at):
            group = np.cumsum(new[at])
            key = _column(ctx[order[at]], c)
            o = np.lexsort((key, group))
            order[at] = order[at][o]
            key = key[o]
            new[at[1:]] |= (key[1:] != key[:-1]) & ~new[at[1:]]
        if 8 * (c + 1) == gram:
            new_gram = new.copy()
    return order, new_gram, new


def _zstd(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def _pack(fields, columns: dict, ctx: np.ndarray | None = None) -> bytes:
    raw = b"".join(np.ascontiguousarray(columns[name], kind).tobytes() for name, kind in fields) + (ctx.tobytes() if ctx is not None else b"")
    n = len(columns[fields[0][0]])
    return np.array([n, len(raw)], np.int64).tobytes() + _zstd(raw)


def _unpack(fields, blobs: list, width: int = 0) -> tuple[dict, np.ndarray]:
    """Columns (and contexts) of all blobs, end to end."""
    columns, contexts = {name: [np.zeros(0, kind)] for name, kind in fields}, [np.zeros((0, width), np.uint8)]
    for blob in blobs:
        n, size = np.frombuffer(blob, np.int64, 2).tolist()
        raw, at = pa.decompress(blob[16:], size, "zstd", asbytes=True), 0
        for name, kind in fields:
            columns[name].append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        if width:
            contexts.append(np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width))
    return {name: np.concatenate(parts) for name, parts in columns.items()}, np.concatenate(contexts)


RUN_FIELDS = (("n", np.int64),)


def _pack_run(ctx: np.ndarray) -> bytes:
    return _pack(RUN_FIELDS, {"n": np.array([len(ctx)])}, ctx)


def _unpack_run(blob: bytes, width: int) -> np.ndarray:
    _, size = np.frombuffer(blob, np.int64, 2).tolist()
    return np.frombuffer(pa.decompress(blob[16:], size, "zstd", asbytes=True), np.uint8)[8:].reshape(-1, width)


def _entries_of(data, offs, rows, group, length, gram):
    """Entries of a group of pieces, neighbours with equal contexts at equal steps as one."""
    part = np.concatenate([data[offs[r] + a : offs[r] + b] for r, a, b in group])
    cut = np.concatenate([[0], np.cumsum([b - a for _, a, b in group])])
    seg, p, h, ctx = anchors(part, cut, length, gram)
    pos = p - cut[seg] + np.array([a for _, a, _ in group])[seg]
    row = np.array([r for r, _, _ in group])[seg]
    same, step = np.zeros(len(p), bool), np.zeros(len(p), np.int64)
    same[1:] = (seg[1:] == seg[:-1]) & (ctx[1:] == ctx[:-1]).all(axis=1)
    step[1:] = pos[1:] - pos[:-1]
    go_on = same.copy()
    go_on[1:] &= ~same[:-1] | (step[1:] == step[:-1])
    head = np.flatnonzero(~go_on)
    rep = np.diff(np.append(head, len(p)))
    second = np.minimum(head + 1, max(len(p) - 1, 0))
    return rows[row[head]], pos[head], np.where(rep > 1, step[second], 0), rep, h[head], ctx[head]


def _settle(ids, ctx):
    """Which entries have an entry of a smaller id with the same context."""
    h = _hash(ctx)
    order = np.lexsort((ids, h))
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    lead = order[new][np.cumsum(new) - 1]
    gone = ids[order] > ids[lead]
    at = np.flatnonzero(gone)
    gone[at] = (ctx[order[at]] == ctx[lead[at]]).all(axis=1)
    out = np.zeros(len(h), bool)
    out[order] = gone
    return out


def _smaller(key: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, whether a row of its key has a smaller id, and a row with the smallest."""
    order = np.lexsort((ids, key))
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    lead = order[new][np.cumsum(new) - 1]
    gone, who = np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    gone[order], who[order] = ids[order] > ids[lead], lead
    return gone, who


def repeated_strings(ctx: np.ndarray, group: np.ndarray, ids: np.ndarray, length: int, right: int) -> np.ndarray:
    """Per distinct context, bit j where its string at offset j also is in a context of its group with a smaller id."""
    out, owned = np.zeros(len(ctx), np.int64), _owned(ctx, length, right)
    salt = kernel.mix(group.astype(np.uint64))
    top = U(pow(kernel._BASE, length - 1, 2**64))
    h = np.zeros(len(ctx), np.uint64)
    for i in range(length):
        h += kernel._BYTE[ctx[:, i]] * U(pow(kernel._BASE, i, 2**64))
    for j in range(int(ctx[:, -1].max(initial=0)) + 1):
        if j:
            h = (h - kernel._BYTE[ctx[:, length - j]] * top) * U(kernel._BASE) + kernel._BYTE[ctx[:, right + j - 1]]
        at = np.flatnonzero(owned >> j & 1)
        if len(at) < 2:
            continue
        gone, who = _smaller(kernel.mix(h[at]) ^ salt[at], ids[at])
        x, y = at[gone], at[who[gone]]
        equal = (ctx[x, : length - j] == ctx[y, : length - j]).all(axis=1) & (ctx[x, right : right + j] == ctx[y, right : right + j]).all(axis=1) & (group[x] == group[y])
        if not equal.all():  # different strings under one hash: number the strings by their bytes instead
            text = np.concatenate([ctx[at, : length - j], ctx[at, right : right + j]], axis=1)
            _, number = np.unique(np.concatenate([text, group[at].astype(np.int64)[:, None].view(np.uint8)], axis=1), axis=0, return_inverse=True)
            gone, who = _smaller(number.ravel(), ids[at])
            x = at[gone]
        out[x] |= np.int64(1) << j
    return out


def merge_scan(old: list[np.ndarray], new: dict, ctx: np.ndarray, length: int, gram: int):
    """One bucket: (marks of the new entries, the new contexts as a sorted run)."""
    right, _ = _widths(length, gram)
    every = np.concatenate([*old, ctx])
    ids = np.concatenate([np.full(len(every) - len(ctx), OLD), new["id"]])
    order, new_gram, new_ctx = suffix_order(every, gram)
    sid, gram_no, ctx_no = ids[order], np.cumsum(new_gram) - 1, np.cumsum(new_ctx) - 1
    heads = np.flatnonzero(new_ctx)
    least = np.minimum.reduceat(sid, heads)
    in_gram = gram_no[heads]
    gram_least = np.minimum.reduceat(least, np.flatnonzero(np.append(True, in_gram[1:] != in_gram[:-1])))
    # Groups in which a context has a smaller document elsewhere: their contexts' strings decide.
    wanting = (least != OLD) & (least > gram_least[in_gram])
    some = np.bincount(in_gram[wanting], minlength=len(gram_least)) > 0
    take = np.flatnonzero(some[in_gram])
    mask = np.zeros(len(heads), np.int64)
    mask[take] = repeated_strings(every[order[heads[take]]], in_gram[take], least[take], length, right)
    first = least[ctx_no]
    fresh = np.flatnonzero(sid != OLD)
    bits = np.where(sid[fresh] > first[fresh], _owned(every[order[fresh]], length, right), mask[ctx_no[fresh]])
    hit = bits != 0
    who = order[fresh[hit]] - (len(every) - len(ctx))
    marks = {"uid": new["uid"][who], "pos": new["pos"][who], "mask": bits[hit], "step": new["step"][who], "rep": new["rep"][who]}
    return marks, every[order[heads[least != OLD]]]


class SuffixIndexFamily:
    """add() takes in a batch with larger ids than all before and returns its marks."""

    def __init__(self, space: Workspace, buckets: int, length: int = LENGTH, gram: int = GRAM):
        if gram % 8 or not 8 <= gram <= length <= 255 or length - gram > 60:
            raise ValueError("gram: a multiple of 8, at most 60 bytes under length; length: at most 255")
        self.space, self.buckets, self.length, self.gram = space, buckets, length, gram
        self.levels: list[tuple[str, DataFrame, str] | None] = []  # (table, run, folder) per level, or none
        self.batches = 0

    def _entries(self, texts: DataFrame) -> DataFrame:
        buckets, length, gram = self.buckets, self.length, self.gram
        right, _ = _widths(length, gram)

        def flush(parts):
            ids, uids, pos, step, rep, h, ctx = (np.concatenate(x) for x in zip(*parts))
            gone = _settle(ids, ctx)
            marks = _pack(MARK_FIELDS, {"uid": uids[gone], "pos": pos[gone], "mask": _owned(ctx[gone], length, right), "step": step[gone], "rep": rep[gone]})
            bucket = (kernel.mix(h + U(1)) % U(buckets)).astype(np.int32)  # owners have small hashes: mixed once more
            stay = np.flatnonzero(~gone)
            stay = stay[np.argsort(bucket[stay], kind="stable")]
            edge = np.flatnonzero(np.append(True, bucket[stay][1:] != bucket[stay][:-1])) if len(stay) else np.zeros(0, np.int64)
            blobs = []
            for x in np.split(stay, edge[1:]):
                blobs.append(_pack(FIELDS, {"id": ids[x], "uid": uids[x], "pos": pos[x], "step": step[x], "rep": rep[x]}, ctx[x]))
            return pa.RecordBatch.from_arrays([pa.array(bucket[stay[edge]], pa.int32()), pa.array(blobs, pa.binary()), pa.array([marks] + [None] * (len(blobs) - 1), pa.binary())], ["bucket", "entries", "marks"])

        def work(batches):
            parts, size = [], 0
            for batch in batches:
                data, offs = kernel.as_bytes(batch.column("text"))
                ids, uids = batch.column("id").to_numpy(), batch.column("uid").to_numpy()
                for group in _pieces(offs, length):
                    row, pos, step, rep, h, ctx = _entries_of(data, offs, np.arange(batch.num_rows), group, length, gram)
                    parts.append((ids[row], uids[row], pos, step.astype(np.int32), rep.astype(np.int32), h, ctx))
                    size += len(row)
                    if size >= FLUSH:
                        yield flush(parts)
                        parts, size = [], 0
            if parts:
                yield flush(parts)
            kernel.trim()

        return texts.select("id", "uid", "text").mapInArrow(work, "bucket int, entries binary, marks binary")

    def _save_run(self, df: DataFrame, name: str) -> tuple[str, DataFrame, str]:
        """A table bucketed by the index's buckets: joins of runs move nothing."""
        spark = self.space.spark
        table = f"suffix_runs_{uuid.uuid4().hex}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.format("parquet").bucketBy(parts, "bucket").sortBy("bucket").option("path", self.space.path(name)).option("compression", "none").saveAsTable(table)
        return table, spark.table(table), name

    def _drop_run(self, run: tuple[str, DataFrame, str]) -> None:
        self.space.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        self.space.drop(run[2])

    def add(self, texts: DataFrame, more: bool) -> DataFrame:
        """more: further batches follow, so the batch's own contexts become a run and equal levels merge."""
        k, self.batches = self.batches, self.batches + 1
        length, gram, width = self.length, self.gram, sum(_widths(self.length, self.gram))
        dealt = self._entries(texts).groupBy("bucket").agg(F.collect_list("entries").alias("entries"), F.collect_list("marks").alias("marks"))
        runs = [run for run in self.levels if run]
        n_old = len(runs)
        for i, (_, run, _) in enumerate(runs):
            dealt = dealt.join(run.select("bucket", F.col("run").alias(f"old{i}")), "bucket", "left")

        def scan(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    new, ctx = _unpack(FIELDS, r["entries"], width)
                    old = [_unpack_run(r[f"old{i}"], width) for i in range(n_old) if r[f"old{i}"] is not None]
                    found, run = merge_scan(old, new, ctx, length, gram)
                    settled, _ = _unpack(MARK_FIELDS, r["marks"])
                    marks = _pack(MARK_FIELDS, {name: np.concatenate([found[name], settled[name]]) for name, _ in MARK_FIELDS})
                    yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([_pack_run(run) if more else None], pa.binary()), pa.array([marks], pa.binary())], ["bucket", "run", "marks"])
            kernel.trim()

        def unpack(batches):
            for batch in batches:
                for blob in batch.column("marks").to_pylist():
                    marks, _ = _unpack(MARK_FIELDS, [blob])
                    yield pa.RecordBatch.from_arrays([pa.array(marks[name]) for name, _ in MARK_FIELDS], [name for name, _ in MARK_FIELDS])

        scanned = dealt.mapInArrow(scan, "bucket int, run binary, marks binary")
        if not more:
            return self.space.save(scanned.select("marks").mapInArrow(unpack, MARKS), f"marks-{k}")
        run = self._save_run(scanned, f"batch-{k}")
        marks = self.space.save(run[1].select("marks").mapInArrow(unpack, MARKS), f"marks-{k}")
        self.space.release()
        self._put(run)
        return marks

    def _put(self, run: tuple[str, DataFrame, str], level: int = 0) -> None:
        """Like carrying in binary counting: two runs of a level become one of the next."""
        while len(self.levels) <= level:
            self.levels.append(None)
        if self.levels[level] is None:
            self.levels[level] = run
            return
        other, self.levels[level] = self.levels[level], None
        width, gram = sum(_widths(self.length, self.gram)), self.gram

        def merge(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    both = [_unpack_run(x, width) for x in (r["run"], r["other"]) if x is not None]
                    ctx = np.concatenate(both)
                    yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([_pack_run(ctx[suffix_order(ctx, gram)[0]])], pa.binary())], ["bucket", "run"])
            kernel.trim()

        joined = run[1].select("bucket", "run").join(other[1].select("bucket", F.col("run").alias("other")), "bucket", "full")
        merged = self._save_run(joined.mapInArrow(merge, "bucket int, run binary"), f"level{level + 1}-{self.batches}")
        self._drop_run(run)
        self._drop_run(other)
        self._put(merged, level + 1)

    def close(self) -> None:
        """Free the runs' tables and files, when no more batches come."""
        for run in self.levels:
            if run:
                self._drop_run(run)
        self.levels = []


def _spans(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings of ``length`` bytes at these places cover."""
    starts = np.unique(starts)
    gap = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + length


def _starts(pos, mask, step, rep) -> np.ndarray:
    """Where the strings of marks start."""
    if (rep > 1).any():
        at = np.arange(int(rep.sum())) - np.repeat(np.cumsum(rep) - rep, rep)
        pos, mask = np.repeat(pos, rep) + at * np.repeat(step.astype(np.int64), rep), np.repeat(mask, rep)
    return np.concatenate([pos[mask >> j & 1 == 1] - j for j in range(int(mask.max()).bit_length())])


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    space = Workspace(docs.sparkSession, "passages")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = space.save(rows, "texts", compression="zstd")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    indexed = texts.filter(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    n = batches or max(BATCHES, -(-size // BATCH_BYTES))
    edges = sorted(set(indexed.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10_000)).first()[0] or [])) if n > 1 else []
    key = F.col("id")
    parts = [indexed.filter(c) for c in ([key < edges[0], *((key >= a) & (key < b) for a, b in zip(edges, edges[1:])), key >= edges[-1]] if edges else [F.lit(True)])]
    family = SuffixIndexFamily(space, max(8, -(-size // BUCKET_BYTES)), length, gram)
    marks = []
    for k, batch in enumerate(parts):
        marks.append(family.add(batch, k + 1 < len(parts)))
        space.release()
    family.close()
    gone = reduce(DataFrame.unionAll, marks).groupBy("uid").agg(*(F.collect_list(name).alias(name) for name, _ in MARK_FIELDS[1:]))

    def remove(batches):
        for batch in batches:
            valid = batch.column("pos").is_valid().to_numpy(zero_copy_only=False)
            out = []
            for k, raw in enumerate(batch.column("text")):
                raw = raw.as_py().encode()
                if not valid[k]:
                    out.append((len(raw), 0, 0, raw))
                    continue
                a, b = _spans(_starts(*(batch.column(name)[k].values.to_numpy() for name, _ in MARK_FIELDS[1:])), length)
                kept = b"".join(raw[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(raw)]))
                out.append((len(raw), int((b - a).sum()), len(a), kept))
            c = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.binary())], [doc_id, "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.join(gone, "uid", "left").mapInArrow(remove, f"{doc_id} long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
