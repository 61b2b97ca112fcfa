"""Token ids in ORC: run-length encoded integers, row indexes, Bloom filters on the document id.

Documents are dealt by ranges of their id and sorted, so file k holds smaller ids
than file k + 1 and a reader can skip files, stripes and row groups by id. Each
row holds its start within its file; a small table of files holds each file's
start in the whole stream and its range of ids, and is written once, beside the files: a read of few documents touches that table and
the stripes that their ids' statistics and Bloom filters leave. Stripes are read in parallel.

Chunks of text (white space and the word after it) encode independently of each
other with a byte-level vocabulary, so a task encodes each distinct chunk once
and looks the others up by hash, comparing their bytes; a text with other white space than ASCII's, or with a chunk whose hash another
chunk has, is encoded whole.

Defined results: a null or empty text has only the end id; rows with equal ids
stay, ordered by their text; null ids come first; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import kernel
from .workspace import Workspace

END_ID = 2
CACHE_CHUNKS = 600_000  # distinct chunks that a task remembers; beyond it starts anew
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "compression": "zstd"}
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
# White space beyond ASCII's six, which a pre-tokenizer may join with its neighbours.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def unlike(data: np.ndarray, start: np.ndarray, end: np.ndarray, raw: np.ndarray, raw_start: np.ndarray, raw_length: np.ndarray) -> np.ndarray:
    """Numbers of the chunks that differ from their remembered bytes. Chunks lie end to end, so the text is read in order."""
    length = end - start
    others = np.flatnonzero(raw_length != length)
    at = np.repeat((raw_start - start).astype(np.int32), length)
    at += np.arange(len(data), dtype=np.int32)
    if len(others):
        np.minimum(at, len(raw) - 1, out=at)
    differ = np.flatnonzero(raw[at] != data)
    return np.union1d(others, np.searchsorted(start, differ, "right") - 1) if len(differ) else others


class ChunkEncoder:
    """Encodes texts chunk by chunk with a bounded memory of chunks."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # hashes in order, and each one's place
        self.ids, self.size = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.raw, self.raw_size = np.zeros(1 << 16, np.uint8), 0  # the chunks' bytes
        self.raw_starts, self.raw_lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Encode chunks and remember them; the places they get."""
        # Chunks that begin with white space and end without it can stand in a row: they don't touch each other.
        joined = [k for k, x in enumerate(texts) if kernel.SPACE[x[0]] and not kernel.SPACE[x[-1]]]
        alone = sorted(set(range(len(texts))).difference(joined))
        order, flats, lengths = [], [], []
        groups = [joined[i : i + 500] for i in range(0, len(joined), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([b"".join([texts[k] for k in g]).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.int32)
            upto = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
            ends = np.cumsum([len(texts[k]) for k in group])
            cut = np.searchsorted(upto, ends)
            if np.array_equal(upto[cut], ends):
                order += group
                flats.append(ids)
                lengths.append(np.diff(cut, prepend=0))
            else:
                alone += group
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([texts[k].decode() for k in alone], add_special_tokens=False)):
            order.append(k)
            flats.append(np.array(e.ids, np.int32))
            lengths.append(np.array([len(e.ids)]))
        flat, length, n = np.concatenate(flats), np.concatenate(lengths), len(self.starts)
        while self.size + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.size : self.size + len(flat)] = flat
        self.starts = np.concatenate([self.starts, self.size + np.cumsum(length) - length])
        self.lengths = np.concatenate([self.lengths, length])
        self.size += len(flat)
        sizes = np.array([len(texts[k]) for k in order])
        while self.raw_size + sizes.sum() > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.raw_size : self.raw_size + sizes.sum()] = np.frombuffer(b"".join(texts[k] for k in order), np.uint8)
        self.raw_starts = np.concatenate([self.raw_starts, self.raw_size + np.cumsum(sizes) - sizes])
        self.raw_lengths = np.concatenate([self.raw_lengths, sizes])
        self.raw_size += int(sizes.sum())
        places = np.empty(len(texts), np.int64)
        places[order] = np.arange(n, n + len(texts))
        at = np.searchsorted(self.known, hashes)
        self.known, self.slots = np.insert(self.known, at, hashes), np.insert(self.slots, at, places)
        return places

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and offsets of the texts, without end ids, and the texts whose ids are wrong, since two chunks had one hash."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64), np.zeros(0, np.int64)
        blank = kernel.SPACE[data]
        cut = np.zeros(len(data), bool)  # a chunk begins at a text, and where white space begins
        cut[1:] = blank[1:] & ~blank[:-1]
        cut[offs[:-1][offs[:-1] < len(data)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(data))
        hashes, where, back = np.unique(kernel.span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_CHUNKS:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        found[inside] = self.known[at[inside]] == hashes[inside]
        slots = np.zeros(len(hashes), np.int64)
        slots[found] = self.slots[at[found]]
        if not found.all():
            raw, w = data.tobytes(), where[~found]
            slots[~found] = self._learn(hashes[~found], [raw[a:b] for a, b in zip(start[w].tolist(), end[w].tolist())])
        slot = slots[back]
        wrong = unlike(data, start, end, self.raw, self.raw_starts[slot], self.raw_lengths[slot])
        lengths = self.lengths[slot]
        stop = np.cumsum(lengths)
        total = int(stop[-1])
        ids = self.ids[np.arange(total) - np.repeat(stop - lengths - self.starts[slot], lengths)]
        at = np.searchsorted(start, offs)
        return ids, np.concatenate([[0], stop])[at], np.unique(np.searchsorted(at, wrong, "right") - 1)

    def encode_texts(self, column: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        data, offs = kernel.as_bytes(column)
        for i, j in kernel.slices(offs, 500_000):
            part, at = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            ids, to, wrong = self.encode(part, at)
            odd = {k: np.array(self.tokenizer.encode(column[i + k].as_py(), add_special_tokens=False).ids, np.int32) for k in wrong.tolist()}
            if part.max(initial=0) >= 0xC2 or np.any((part >= 0x1C) & (part < 0x20)):
                for k in range(i, j):
                    text = column[k].as_py() or ""
                    if OTHER_SPACE.search(text):
                        odd[k - i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            out += [odd[k] if k in odd else ids[to[k] : to[k + 1]] for k in range(j - i)]
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder_of(path: str) -> ChunkEncoder:
    """One encoder for all tasks of a worker: its chunks stay known."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every text and write the ORC files."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    # The text's hash deals out equal ids; no explicit number, so small partitions are put together.
    rows = rows.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th", "text")
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), "text")

    def encode(batches):
        kernel.trim()
        encoder, at = encoder_of(vocabulary), 0
        for batch in batches:
            _, offs = kernel.as_bytes(batch.column("text"))
            for i, j in kernel.slices(offs):
                found = encoder.encode_texts(batch.column("text").slice(i, j - i))
                lengths = np.fromiter((len(x) + 1 for x in found), np.int64, len(found))
                ids = np.concatenate([y for x in found for y in (x, np.array([end_id], np.int32))])
                stop = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("part").slice(i, j - i), pa.array(at + stop - lengths), pa.array(lengths), kernel.lists(ids.astype(np.int32), np.concatenate([[0], stop]))], ["doc_id", "part", "local_start", "n_tokens", "ids"])
                at += int(stop[-1])

    rows.mapInArrow(encode, SCHEMA).write.mode("overwrite").options(**ORC_OPTIONS).orc(path)
    written = docs.sparkSession.read.schema(SCHEMA).orc(path)
    files = written.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files.select(F.col("part").alias("file"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n", "first_id", "last_id").write.mode("overwrite").parquet(files_path(path))


def files_path(path: str) -> str:
    """Where the table of files lies: a row per file with its start, size and range of ids."""
    return f"{path.rstrip('/')}-files"


def _based(spark, rows: DataFrame, path: str) -> DataFrame:
    files = spark.read.schema("file int, base long").parquet(files_path(path))
    return rows.join(files, F.col("part") == F.col("file")).withColumn("start", F.col("base") + F.col("local_start"))


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids. Filters on doc_id prune files, stripes and row groups; no other row of the files is read."""
    return _based(spark, spark.read.schema(SCHEMA).orc(path), path).select("doc_id", "start", "n_tokens", "ids")


def token_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files' ids."""
    rows = spark.read.schema(SCHEMA).orc(path)

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            offs = ids.offsets.to_numpy()
            flat = ids.values.to_numpy().astype("<u4")
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(offs).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    read = rows.mapInArrow(digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return _based(spark, read, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "tokens").path("orc")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary_path("byte_bpe_50k.json"))
    return token_digests(spark, path)
