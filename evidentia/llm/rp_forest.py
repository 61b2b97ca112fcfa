"""Embedding near-dedup by a forest of random-projection trees with spill.

Each tree halves the vectors level by level at the median of a random
projection; vectors near a split go to both sides. Vectors of one label that
share a leaf in some tree are compared exactly, in double precision, and linked
pairs are united.

The medians come from a sample of about ``SAMPLE`` vectors of each length, picked
by hash; every vector is put into the trees. Equal vectors are one class and never
expanded into pairs. A leaf larger than ``LEAF_BLOCK`` is compared as pairs of
blocks, so none is cut short. Pairs are not written: a task counts each vector's links and
returns the edges of a spanning forest. A pair that meets in several leaves counts
in the first one that its vectors share: the leaves of linked vectors are found again from the vectors, so an entry of a leaf
holds a vector and a few numbers, whatever the depth.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label or id, link with nothing; vectors of other
lengths don't compare; rows that repeat an id are further vectors, each by itself;
a label can be of any type that groups; an empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel
from .components import connected_components
from .runs import by_sorted_key, key_changes
from .workspace import Workspace

TREES, LEAF, SPILL, SAMPLE, LEAF_BLOCK, SEED = 8, 128, 0.5, 20_000, 4096, 7
PAIRS = 200_000  # pairs whose leaves are found again at a time
SAMPLE_LEAF = 16  # below this many sampled vectors a node splits at its level's overall median


def usable(kind):
    """Rows with their vector's length and bytes; an unusable vector has neither."""

    def work(batches):
        for batch in batches:
            vectors, out = batch.column("v"), []
            for x in vectors:
                v = np.array(x.values.to_numpy(zero_copy_only=False), kind) if x.is_valid and not x.values.null_count else np.zeros(0, kind)
                good = len(v) and np.isfinite(v).all() and v.any()
                out.append((len(v), (v + kind(0)).tobytes()) if good else (None, None))  # -0 becomes 0: equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["id", "label", "dim", "v"])

    return work


def unit(raw: list[bytes], kind) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Forest:
    """Directions per tree and level, split places per tree and node."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int, margin: float):
        rng = np.random.default_rng(SEED)
        self.depth, self.margin = depth, margin
        self.directions = rng.standard_normal((trees, max(depth, 1), sample.shape[1] if sample.size else 1))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.splits: list[list[dict[int, float]]] = []
        self.level_median = np.zeros((trees, max(depth, 1)))
        for t in range(trees):
            node, per_level = np.zeros(len(sample), np.int64), []
            for level in range(depth):
                x = sample @ self.directions[t, level]
                self.level_median[t, level] = np.median(x) if len(x) else 0.0
                own, order = {}, np.argsort(node, kind="stable")
                at = key_changes(node[order])
                for a, b in zip(at[:-1], at[1:]):
                    if b - a >= SAMPLE_LEAF:
                        own[int(node[order[a]])] = float(np.median(x[order[a:b]]))
                per_level.append(own)
                node = node * 2 + (x > self._places(own, node, t, level))
            self.splits.append(per_level)

    def _places(self, own: dict[int, float], node: np.ndarray, t: int, level: int) -> np.ndarray:
        u, back = np.unique(node, return_inverse=True)
        return np.array([own.get(int(k), self.level_median[t, level]) for k in u])[back] if len(u) else np.zeros(0)

    def leaves(self, m: np.ndarray):
        """(tree, row, leaf) of all leaves that each vector reaches."""
        for t, per_level in enumerate(self.splits):
            row, node = np.arange(len(m)), np.zeros(len(m), np.int64)
            for level, own in enumerate(per_level):
                x = (m @ self.directions[t, level])[row] - self._places(own, node, t, level)
                left, right = x <= self.margin, x > -self.margin
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([node[left] * 2, node[right] * 2 + 1])
            yield t, row, node


def _pairs(m: np.ndarray, block: np.ndarray, cosine: float):
    """(x, y), x < y, of the linked rows of one leaf, or across two of its blocks, a few thousand rows at a time."""
    across = block.min() != block.max()
    for i in range(0, len(m), 512):
        x, y = np.nonzero(m[i : i + 512] @ m[i:].T >= cosine)
        x, y = x + i, y + i
        keep = (y > x) & ((block[x] != block[y]) if across else True)
        yield x[keep], y[keep]


class Links:
    """Links of a table's rows and the edges of a spanning forest, from pairs in leaves.

    A pair counts in its leaf unless its vectors share an earlier one. leaves_of(rows) gives the rows' leaves, in rows that 0
    pads; it is asked for many pairs at once.
    """

    def __init__(self, copies: np.ndarray, leaf: np.ndarray, leaves_of):
        self.copies, self.leaf, self.leaves_of = copies, leaf, leaves_of
        self.links, self.parent, self.edges = np.zeros(len(copies), np.int64), list(range(len(copies))), []
        self.waiting, self.size = [], 0

    def _root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        for k in range(0, len(p), PAIRS):
            self.waiting.append((p[k : k + PAIRS], q[k : k + PAIRS]))
            self.size += len(self.waiting[-1][0])
            if self.size >= PAIRS:
                self.settle()

    def settle(self) -> None:
        if not self.size:
            return
        p, q = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.size = [], 0
        rows, back = np.unique(np.concatenate([p, q]), return_inverse=True)
        leaves, front, rear = self.leaves_of(rows), back[: len(p)], back[len(p) :]
        for k in range(0, len(p), 20_000):
            x, y = p[k : k + 20_000], q[k : k + 20_000]
            ours, theirs = leaves[front[k : k + 20_000]], leaves[rear[k : k + 20_000]]
            mine = np.ones(len(x), bool)
            for c in range(leaves.shape[1]):  # leaves are in the order of all vectors
                own = ours[:, c]
                at = np.flatnonzero((own != 0) & (own < self.leaf[x]) & mine)
                mine[at[(theirs[at] == own[at, None]).any(axis=1)]] = False
            x, y = x[mine], y[mine]
            np.add.at(self.links, x, self.copies[y])
            np.add.at(self.links, y, self.copies[x])
            for a, b in zip(x.tolist(), y.tolist()):
                a_root, b_root = self._root(a), self._root(b)
                if a_root != b_root:
                    self.parent[max(a_root, b_root)] = min(a_root, b_root)
                    self.edges.append((a, b))


def near_duplicates(table: DataFrame, cosine: float = 0.93, trees: int = TREES, leaf: int = LEAF, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = table.sparkSession
    space = Workspace(spark, "forest")
    kind = np.float32 if table.schema[vector].dataType.elementType.simpleString() == "float" else np.float64  # bytes as they are; all sums are in double precision
    label_type = table.schema[label].dataType.simpleString()
    rows = table.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<float>" if kind is np.float32 else "array<double>").alias("v"))
    seen = rows.mapInArrow(usable(kind), f"id long, label {label_type}, dim int, v binary")
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("dim").isNotNull()
    seen = space.save(seen.select("id", "label", "dim", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), fit.alias("fit")), "seen")
    good = seen.filter("fit")
    key = ["label", "h1", "h2"]
    classes = space.save(good.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    heads = good.join(classes.withColumnRenamed("rep", "id"), ["id", *key], "left_semi").dropDuplicates(["id", *key]).drop("fit")
    heads = space.save(heads.join(classes.select(*key, "copies"), key).withColumn("hid", F.monotonically_increasing_id()), "heads")

    # A forest for each vector length that fills more than a leaf.
    forests = {}
    sizes = heads.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("total"))
    for r in sizes.filter(F.col("most") > leaf).toLocalIterator():
        share = int(min(1.0, SAMPLE / r.total) * (1 << 30))
        picked = heads.filter((F.col("dim") == r.dim) & (F.pmod(F.xxhash64(F.lit(SEED), "h1", "h2"), F.lit(1 << 30)) < share)).select("v").toPandas()  # about SAMPLE rows
        sample = unit(sorted(bytes(v) for v in picked.v), kind) if len(picked) else np.zeros((0, r.dim))
        depth = int(np.ceil(np.log2(r.most / leaf))) if len(sample) else 0
        forests[r.dim] = Forest(sample, depth, trees, SPILL * np.sqrt((2 - 2 * cosine) / r.dim))

    def leaf_lists(forest: Forest | None, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat leaves of the vectors in the order of vectors and leaves, and each vector's place; 0 is no leaf."""
        found = list(forest.leaves(m)) if forest else [(0, np.arange(len(m)), np.zeros(len(m), np.int64))]
        row = np.concatenate([x for _, x, _ in found])
        leaves = np.concatenate([(np.int64(t) << 48) + node + 1 for t, _, node in found])
        order = np.lexsort((leaves, row))
        return leaves[order], np.searchsorted(row[order], np.arange(len(m) + 1))

    def padded(forest: Forest | None, m: np.ndarray) -> np.ndarray:
        flat, offs = leaf_lists(forest, m)
        lengths = np.diff(offs)
        out = np.zeros((len(m), int(lengths.max(initial=0))), np.int64)
        out[np.arange(out.shape[1]) < lengths[:, None]] = flat
        return out

    def place(batches):
        for batch in batches:
            dim = batch.column("dim").to_numpy()
            for d in np.unique(dim):
                part = batch.take(pa.array(np.flatnonzero(dim == d)))
                flat, offs = leaf_lists(forests.get(int(d)), unit(part.column("v").to_pylist(), kind))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("label", "dim", "hid")] + [kernel.lists(flat, offs)], ["label", "dim", "hid", "leaves"])

    placed = space.save(heads.select("label", "dim", "hid", "v").mapInArrow(place, f"label {label_type}, dim int, hid long, leaves array<long>"), "placed")
    leaf_key = ["label", "dim", "leaf"]
    entries = placed.select("label", "dim", "hid", F.explode("leaves").alias("leaf"))
    blocks = entries.groupBy(*leaf_key).agg(F.count("*").alias("size")).filter("size > 1").withColumn("blocks", F.ceil(F.col("size") / LEAF_BLOCK).cast("int"))
    dealt = entries.join(blocks, leaf_key).withColumn("block", F.pmod(F.xxhash64("hid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hid", "leaf", "block", F.xxhash64(*leaf_key, F.least("block", "other"), F.greatest("block", "other")).alias("route"), (F.col("block") != F.col("other")).alias("mixed"))
    dealt = dealt.join(heads.select("hid", "dim", "v", "copies"), "hid")

    def compare(t: pa.Table):
        route, hid, copies, block, leaf_no, mixed, dim = (t.column(c).to_numpy() for c in ("route", "hid", "copies", "block", "leaf", "mixed", "dim"))
        raw = t.column("v").to_pylist()

        def leaves_of(rows: np.ndarray) -> np.ndarray:
            parts = [(at, padded(forests.get(int(d)), unit([raw[i] for i in rows[at]], kind))) for d in np.unique(dim[rows]) for at in [np.flatnonzero(dim[rows] == d)]]
            out = np.zeros((len(rows), max(x.shape[1] for _, x in parts)), np.int64)
            for at, x in parts:
                out[at, : x.shape[1]] = x
            return out

        links, at = Links(copies, leaf_no, leaves_of), key_changes(route)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if mixed[a] and len(np.unique(block[a:b])) < 2:
                continue  # one of the two blocks is empty
            for x, y in _pairs(unit(raw[a:b], kind), block[a:b], cosine):
                links.add(x + a, y + a)
        links.settle()
        some, edges = np.flatnonzero(links.links), np.array(links.edges, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hid[some], hid[edges[:, 0]]])), pa.array(np.concatenate([links.links[some], np.zeros(len(edges), np.int64)])), pa.array(np.concatenate([np.full(len(some), -1), hid[edges[:, 1]]]))], ["hid", "links", "other"])

    found = space.save(by_sorted_key(dealt, "route", ["hid"], compare, "hid long, links long, other long"), "found")
    linked = found.filter("other = -1").groupBy("hid").agg(F.sum("links").alias("others"))
    names = heads.select("hid", "id")
    edges = found.filter("other <> -1").select("hid", "other")
    edges = edges.join(names.toDF("hid", "x"), "hid").join(names.toDF("other", "y"), "other").select(F.col("x").alias("a"), F.col("y").alias("b"))
    root = connected_components(edges, space, "linked")
    per_class = heads.join(linked, "hid", "left").join(root, "id", "left").select(*key, (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    own = good.select("id", *key).join(per_class, key).select("id", "n_links", "component_id")
    bad = seen.filter("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return own.unionByName(bad).select(F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_forest(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
