"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run holds (h1, h2, n_docs), sorted by hash, in a table bucketed by hash: joins
with it are merge joins that move and sort only the other side. There are two
families of runs. Counting runs hold the keys seen in fewer than ``min_docs``
documents so far; settled runs hold the keys that reached them. A new batch counts
its keys, merge-anti-joins the settled runs (their keys need no more counting), merge-joins
the counting runs for the sums, settles what now is common, and adds the other
keys as its own run. When a level has ``fanout`` runs they are merged into
one of the next level, without a shuffle, so B batches leave O(log B) runs.

Defined results: a null or empty text is one empty line; keys shorter than
``min_chars`` code points never count; every row is one document, also when rows
or ids repeat; a null id is an ordinary value; an empty table gives an empty
table. Columns besides id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .workspace import Workspace

# Fixed values of the line key: the white space that is stripped, and A-Z to a-z.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hashed(key: Column) -> list[Column]:
    """128 bits from two seeds: at 10^12 lines 64 bits would collide."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


# One file holds each bucket of a run, written in order; this lets Spark rely on it.
READ_SORTED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def sorted_runs(spark):
    before = spark.conf.get(READ_SORTED, "false")
    spark.conf.set(READ_SORTED, "true")
    try:
        yield
    finally:
        spark.conf.set(READ_SORTED, before)


class SortedRuns:
    """One family of levelled runs of (h1, h2, n_docs), of which no key is in two runs of settled keys."""

    def __init__(self, space: Workspace, name: str, fanout: int):
        self.space, self.name, self.fanout = space, name, fanout
        self.parts = int(space.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def tables(self) -> list[DataFrame]:
        return [self.space.spark.table(t) for level in self.levels for t in level]

    def put(self, df: DataFrame, level: int = 0) -> None:
        table = f"{self.name}_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.parts, "h1", "h2").sortBy("h1", "h2").option("path", self.space.path(table)).saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.put(reduce(self._merge, [self.space.spark.table(t) for t in old]), level + 1)
            self._free(old)

    @staticmethod
    def _merge(a: DataFrame, b: DataFrame) -> DataFrame:
        """Two sorted runs to one: a full merge join on the hash."""
        b = b.withColumnRenamed("n_docs", "more")
        return a.join(b.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"))

    def _free(self, tables: list[str]) -> None:
        for t in tables:
            self.space.spark.sql(f"DROP TABLE IF EXISTS {t}")
            self.space.drop(t)

    def close(self) -> None:
        self._free([t for level in self.levels for t in level])
        self.levels = []


class LineRuns:
    """The levelled index. add() takes in a batch, strip() removes common lines, close() frees the runs."""

    def __init__(self, spark, min_docs: int = 10, min_chars: int = 1, fanout: int = 2, text: str = "text", doc_id: str = "doc_id"):
        self.min_docs, self.min_chars = min_docs, min_chars
        self.text, self.doc_id = text, doc_id
        self.space = Workspace(spark, "lines")
        self.counting, self.settled = SortedRuns(self.space, "line_counts", fanout), SortedRuns(self.space, "line_common", fanout)
        self.added = 0

    def counted(self, batch: DataFrame) -> DataFrame:
        """In how many of the batch's documents each unsettled key is, and in how many so far.

        The counts are written before they meet the runs: else the anti-joins would be pushed below the
        count, and every line of the batch, not every key, would be moved and sorted.
        """
        keys = F.array_distinct(F.transform(split_lines(F.col(self.text)), line_key))
        long_enough = batch.select(F.explode(keys).alias("key")).filter(F.char_length("key") >= self.min_chars)
        run = self.space.save(long_enough.select(*hashed(F.col("key"))).groupBy("h1", "h2").agg(F.count("*").alias("n_docs")), f"counts-{self.added}")
        for table in self.settled.tables():
            run = run.join(table.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        total = F.col("n_docs")
        for i, table in enumerate(self.counting.tables()):
            run = run.join(table.select("h1", "h2", F.col("n_docs").alias(f"n{i}")).hint("merge"), ["h1", "h2"], "left")
            total = total + F.coalesce(f"n{i}", F.lit(0))
        return run.select("h1", "h2", "n_docs", total.alias("so_far"))

    def add(self, batch: DataFrame) -> None:
        """Merge a batch with the runs and add its own. A key counts once per document, in the row."""
        with sorted_runs(self.space.spark):
            name = f"batch-{self.added}"
            run = self.space.save(self.counted(batch), name)
            self.space.drop(f"counts-{self.added}")
            self.added += 1
            self.settled.put(run.filter(F.col("so_far") >= self.min_docs).select("h1", "h2", F.col("so_far").alias("n_docs")))
            self.counting.put(run.filter(F.col("so_far") < self.min_docs).select("h1", "h2", "n_docs"))
            self.space.drop(name)

    def common(self) -> DataFrame:
        return reduce(DataFrame.unionAll, [t.select("h1", "h2") for t in self.settled.tables()])

    def close(self) -> None:
        self.counting.close()
        self.settled.close()

    def strip(self, docs: DataFrame) -> DataFrame:
        """Per document: id, text (lines that stay, joined by newline), n_lines, n_dropped.

        Only (id, position, hash) rows are shuffled to meet the common keys; a
        key in a third of all documents makes one skewed join partition, which
        adaptive execution splits. The text moves once, to meet its positions.
        """
        common = self.space.save(self.common(), f"common-{self.added}")
        rows = docs.select(F.col(self.doc_id).alias("id"), split_lines(F.col(self.text)).alias("lines"), F.xxhash64(self.text).alias("th"))
        lines = rows.select("id", "th", F.posexplode("lines").alias("pos", "line")).withColumn("key", line_key(F.col("line"))).filter(F.char_length("key") >= self.min_chars)
        hits = (
            lines.select("id", "th", "pos", *hashed(F.col("key")))
            .join(common, ["h1", "h2"])
            .groupBy(F.col("id").alias("hit_id"), F.col("th").alias("hit_th"))
            .agg(F.sort_array(F.collect_set("pos")).alias("bad"))
        )
        joined = rows.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
        bad = F.coalesce("bad", F.array().cast("array<int>"))
        # The lines that stay are the slices between neighbouring dropped positions: linear in the document.
        cuts = F.concat(F.array(F.lit(-1)), bad, F.array(F.size("lines")))
        kept = F.flatten(F.transform(F.sequence(F.lit(1), F.size(bad) + 1), lambda i: F.slice("lines", F.element_at(cuts, i) + 2, F.element_at(cuts, i + 1) - F.element_at(cuts, i) - 1)))
        return joined.select(
            F.col("id").alias(self.doc_id),
            F.when(F.size(bad) == 0, F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n")).alias("text"),
            F.size("lines").cast("long").alias("n_lines"),
            F.size(bad).cast("long").alias("n_dropped"),
        )


def id_batches(docs: DataFrame, n: int, doc_id: str = "doc_id") -> list[DataFrame]:
    """n batches by ranges of an integer id, so a batch's scan skips the other row groups; by the hash of any other id."""
    if docs.schema[doc_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return [docs.filter(F.pmod(F.xxhash64(doc_id), F.lit(n)) == i) for i in range(n)]
    lo, hi = docs.agg(F.min(doc_id), F.max(doc_id)).first()
    if lo is None or n <= 1:
        return [docs]
    edges = [lo + (hi + 1 - lo) * i // n for i in range(1, n)]
    key = F.col(doc_id)
    parts = [key.isNull() | (key < edges[0])]
    parts += [(key >= a) & (key < b) for a, b in zip(edges, edges[1:])]
    parts.append(key >= edges[-1])
    return [docs.filter(p) for p in parts]


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Strip from every document the lines found in at least ``min_docs`` documents of the table."""
    runs = LineRuns(docs.sparkSession, min_docs, min_chars, fanout)
    for batch in id_batches(docs, batches):
        runs.add(batch)
    stripped = runs.strip(docs)
    runs.close()
    return stripped


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id
"""
