"""N-gram Jaccard join by signature trees: who is linked with whom, as component ids.

1. Each text becomes its set of distinct n-word shingles; equal sets are one class.
2. Routing, without loss: sets as similar as wanted share one of their first
   n - ceil(t n) + 1 shingles in any common order. The order is by hash, with
   shingles that are frequent somewhere last (a fixed-size Bloom filter of them
   goes to all tasks; what it holds changes the work, never the result).
3. The classes that share such a shingle form a group. Pairs of small groups are
   compared by their bitmaps; larger groups by dual traversal of a signature tree.
   What may be similar is connected into candidate components.
4. Each candidate component gets its full sets once, and a tree traversal with
   exact overlaps finds the links.
5. No task holds a group beyond two blocks. Members of such a group are first
   compared exactly with a few pivots; those linked through pivots are one label.
   Then size bands, labels and hashes cut it into cells, and pairs of cells are
   compared, save cells of one label: their members are linked already. So a group
   of n near copies costs about n comparisons, not n squared. Components likewise.

Defined results: null, empty or blank texts have an empty set, linked with
nothing; fewer than n words are one shingle; rows that repeat an id are one
document, each row with its own set size; a row without an id is linked with
nothing and has no component; an empty table gives an empty table. Other columns
are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel
from .components import connected_components
from .runs import by_sorted_key, key_changes
from .signature_tree import bitmap, forest, needed
from .workspace import Workspace

U = np.uint64
BLOOM_BITS = 1 << 22  # the filter of frequent shingles: 512 KB, whatever the input
OFTEN_IN_SLICE, OFTEN = 6, 32  # frequent: this often in 1 MB of text, and in all such slices together
SMALL_GROUP = 8
GROUP_BLOCK = 2048  # groups beyond two, and components beyond one, of such blocks are cut into cells of this size
PIVOTS = 3  # members of a group's size band that all others of the band are first compared with
BLOCK_BYTES = 32 << 20
BROADCAST_ROWS = 1 << 19  # wanted documents that go to all tasks; more are dealt out with the texts
SKETCH = "id long, n int, d1 long, d2 long, keys array<long>, bits binary"


def _sets(batches, text: str, n: int):
    """(batch, first row, sets of a slice of rows)"""
    for batch in batches:
        data, offs = kernel.as_bytes(batch.column(text))
        for i, j in kernel.slices(offs):
            w, at = kernel.word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield batch, i, list(kernel.shingle_sets(w, at, n))
    kernel.trim()


def _bloom_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = U(BLOOM_BITS - 1)
    return (h & m).astype(np.int64), ((h >> U(23)) & m).astype(np.int64)


def frequent_filter(docs: DataFrame, text: str, n: int) -> np.ndarray:
    """Bits of the shingles that are frequent in some slices of text."""

    def count(batches):
        for _, _, sets in _sets(batches, text, n):
            h, c = np.unique(np.concatenate(sets), return_counts=True)
            often = c >= OFTEN_IN_SLICE
            yield pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["h", "c"])

    often = docs.select(text).mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= OFTEN)
    place = F.explode(F.array(F.col("h").bitwiseAND(BLOOM_BITS - 1), F.shiftrightunsigned("h", 23).bitwiseAND(BLOOM_BITS - 1)))
    found = often.select(place.alias("p")).groupBy(F.shiftrightunsigned("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    for row in found.toLocalIterator():  # at most BLOOM_BITS / 64 rows
        out[row.word] = row.bits
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def sketches(docs: DataFrame, doc_id: str, text: str, n: int, percent: int, often: np.ndarray) -> DataFrame:
    """Per document: set size, 128-bit digest of the set, routing shingles, bitmap."""
    packed = np.packbits(often, bitorder="little").tobytes()

    def sketch(batches):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        for batch, i, sets in _sets(batches, "text", n):
            size = np.array([len(s) for s in sets], np.int32)
            d1 = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
            d2 = np.array([int(np.bitwise_xor.reduce(kernel.mix(s * U(0xA24BAED4963EE407)))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            keys, lengths, maps = [], [0], []
            for s in sets:
                p = len(s) - needed_share(len(s), percent) + 1 if len(s) else 0
                if p:
                    x, y = _bloom_places(s)
                    rare = ~(bits[x] & bits[y])
                    s0 = s[rare][:p]
                    keys.append(s0 if len(s0) == p else np.concatenate([s0, s[~rare][: p - len(s0)]]))
                lengths.append(lengths[-1] + p)
                maps.append(bitmap(s).tobytes())
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, len(sets)), pa.array(size), pa.array(d1), pa.array(d2), kernel.lists(flat.view(np.int64), lengths), pa.array(maps, pa.binary())], ["id", "n", "d1", "d2", "keys", "bits"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(sketch, SKETCH)


def needed_share(n: int, percent: int) -> int:
    return -(-percent * n // 100)


PAIR, MEMBER, LARGE = 0, 1, 2


def _rows(kind: int, gid, a, b) -> pa.RecordBatch:
    column = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), column(gid), column(a), column(b)], ["kind", "gid", "a", "b"])


def _large(table: pa.Table):
    """Pieces of a large group as they are: (key, id, size)."""
    yield _rows(LARGE, *(table.column(c).to_numpy() for c in ("key", "id", "n")))


def _groups(table: pa.Table, percent: int, most: int | None = None):
    """Sorted (key, id, n) rows to pairs of small groups (a, b), members of larger ones (gid, a), and what is cut into cells later (key, a, size)."""
    key, doc, size = (table.column(c).to_numpy() for c in ("key", "id", "n"))
    at = key_changes(key)
    lengths = np.diff(at)
    most = most or 2 * GROUP_BLOCK
    pa_, pb, gids, members = [], [], [], []
    for g in range(2, SMALL_GROUP + 1):
        rows = at[:-1][lengths == g][:, None] + np.arange(g)
        for x, y in combinations(range(g), 2) if len(rows) else ():
            a, b = rows[:, x], rows[:, y]
            ok = (100 * np.minimum(size[a], size[b]).astype(np.int64) >= percent * np.maximum(size[a], size[b])) & (doc[a] != doc[b])
            pa_.append(np.minimum(doc[a][ok], doc[b][ok]))
            pb.append(np.maximum(doc[a][ok], doc[b][ok]))
    seen = set()
    for k in np.flatnonzero(lengths > min(SMALL_GROUP, most)):
        rows = slice(at[k], at[k + 1])
        if lengths[k] > most:
            yield _rows(LARGE, key[rows], doc[rows], size[rows])
            continue
        m = np.sort(doc[rows])
        gid = int(kernel.mix(kernel.mix(m.view(np.uint64)) + np.arange(len(m)).astype(np.uint64)).sum()) >> 1
        if gid not in seen:  # near copies share many shingles, and so form one group many times
            seen.add(gid)
            gids.append(np.full(len(m), gid))
            members.append(m)
    if pa_:
        pairs = np.unique(np.stack([np.concatenate(pa_), np.concatenate(pb)]), axis=1)
        yield _rows(PAIR, None, pairs[0], pairs[1])
    if gids:
        yield _rows(MEMBER, np.concatenate(gids), np.concatenate(members), None)


def _band(percent: int) -> F.Column:
    """Sizes whose ratio allows a link lie in one band or in neighbouring ones."""
    width = max(math.log(100 / percent), 0.01) * 1.0001
    return F.floor(F.log(F.col("n").cast("double")) / width).cast("int")


def cells(rows: DataFrame, percent: int) -> DataFrame:
    """(gid, id, n, label) to (gid, id): rows of a group share a new, bounded group if their sizes allow a link and they aren't of one label (-1: none)."""
    rows = rows.select(F.col("gid").alias("g"), "id", "n", "label", _band(percent).alias("band"))
    count = rows.groupBy("g", "band", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    # Labels with few rows in a band don't get cells of their own.
    count = count.withColumn("cell", F.when(F.col("c") * 2 >= GROUP_BLOCK, F.col("label")).otherwise(F.lit(-1).cast("long")))
    parts = count.groupBy("g", "band", "cell").agg(F.greatest(F.ceil(F.sum("c") / GROUP_BLOCK), F.ceil(F.sum("s") * 8 / BLOCK_BYTES)).cast("int").alias("parts"))
    names = count.select("g", "band", "label", "cell").join(parts, ["g", "band", "cell"])
    dealt = rows.join(names, ["g", "band", "label"]).select("g", "band", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id")
    all_cells = parts.select("g", "band", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("g", F.struct("band", "cell", "part").alias("x"))
    near = ((F.col("y.band") == F.col("x.band")) & (F.col("x") <= F.col("y"))) | (F.col("y.band") == F.col("x.band") + 1)
    open_ = (F.col("x.cell") == -1) | (F.col("x.cell") != F.col("y.cell"))
    pairs = all_cells.join(all_cells.withColumnRenamed("x", "y"), "g").filter(near & open_)
    pairs = pairs.select("g", F.xxhash64("g", "x", "y").alias("gid"), F.explode(F.array_distinct(F.array("x", "y"))).alias("z")).select("g", "gid", "z.*")
    return pairs.join(dealt, ["g", "band", "cell", "part"]).select("gid", "id")


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["a", "b"])


def _near_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Keep the pairs (a, b, na, nb, bits_a, bits_b) whose bitmaps allow enough overlap."""

    def near(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy().astype(np.int64), batch.column("nb").to_numpy().astype(np.int64)
            want, ok = needed(na, nb, percent), []
            for i, (x, y) in enumerate(zip(batch.column("bits_a"), batch.column("bits_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                px, py = int(np.bitwise_count(x).sum()), int(np.bitwise_count(y).sum())
                m = min(len(x), len(y))
                x, y = np.bitwise_or.reduce(x.reshape(-1, m), axis=0), np.bitwise_or.reduce(y.reshape(-1, m), axis=0)
                px, py = int(np.bitwise_count(x).sum()), int(np.bitwise_count(y).sum())
                ok.append(int(np.bitwise_count(x & y).sum()) + min(na[i] - px, nb[i] - py) >= want[i])
            ok = np.array(ok, bool)
            yield _edges(batch.column("a").to_numpy()[ok], batch.column("b").to_numpy()[ok])

    return pairs.mapInArrow(near, "a long, b long")


def _tree_edges(percent: int):
    def work(table: pa.Table):
        key, doc, size = table.column("gid").to_numpy(), table.column("a").to_numpy(), table.column("n").to_numpy().astype(np.int64)
        bits = table.column("bits").to_pylist()
        at = key_changes(key)
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            found = forest(bits[s:e], size[s:e], percent, None)
            if found:
                x, y = np.array(found).T
                yield _edges(doc[s:e][x], doc[s:e][y])

    return work


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    p = np.searchsorted(y, x)
    p[p == len(y)] = 0
    common = int((y[p] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _exact_edges(percent: int):
    def work(table: pa.Table):
        key, doc = table.column("route").to_numpy(), table.column("id").to_numpy()
        at = key_changes(key)
        raw = table.column("tokens").combine_chunks()
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            sets = [np.frombuffer(raw[k].as_buffer(), np.uint64) for k in range(s, e)]
            sizes = np.array([len(x) for x in sets], np.int64)

            found = forest([bitmap(x).tobytes() for x in sets], sizes, percent, lambda i, j: _linked(sets[i], sets[j], percent))
            if found:
                x, y = np.array(found).T
                yield _edges(doc[s:e][x], doc[s:e][y])

    return work


def _digest(s: np.ndarray) -> int:
    return int(kernel.mix(s).sum()) if len(s) else 0


def with_texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of the saved table wanted (doc, d1, ...) with the texts of their ids. No text is sorted, and none moves for few rows."""
    few = wanted.count() <= BROADCAST_ROWS
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).join(wanted.hint("broadcast" if few else "shuffle_hash"), "doc")


def _own_sets(batches, n: int, names: list[str]):
    """(names, id, tokens) of the rows whose text is the wanted one; of rows in a row with the same names and id the first."""
    last = None
    for batch, i, sets in _sets(batches, "text", n):
        want = batch.column("d1").slice(i, len(sets)).to_numpy()
        at = np.flatnonzero(np.array([_digest(s) for s in sets], np.uint64).view(np.int64) == want)
        part = batch.select([*names, "id"]).slice(i, len(sets))
        rows = list(zip(*(part.column(c).take(pa.array(at)).to_pylist() for c in [*names, "id"])))
        new = [k for k, row in enumerate(rows) if row != (rows[k - 1] if k else last)]
        last = rows[-1] if rows else last
        at = at[new]
        yield pa.RecordBatch.from_arrays([*part.take(pa.array(at)).columns, pa.array([sets[k].tobytes() for k in at], pa.binary())], [*names, "id", "tokens"])


def full_sets(docs: DataFrame, wanted: DataFrame, n: int, doc_id: str, text: str) -> DataFrame:
    """(id, tokens) of the saved (id, doc, d1): their texts are read again."""
    found = with_texts(docs, wanted, doc_id, text).select("id", "d1", "text").mapInArrow(lambda batches: _own_sets(batches, n, []), "id long, tokens binary")
    return found.dropDuplicates(["id"])


def pivot_pairs(large: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of large groups (gid, id, n) with a few members of their size band, where the bitmaps allow a link."""
    rows = large.withColumn("band", _band(percent))
    pivots = rows.groupBy("gid", "band").agg(F.array_distinct(F.array(*[F.min_by("id", F.xxhash64("id", F.lit(k))) for k in range(PIVOTS)])).alias("p"))
    pairs = rows.join(pivots, ["gid", "band"]).select(F.col("id").alias("a"), F.explode("p").alias("b")).filter("a <> b").distinct()
    return _near_pairs(pairs.join(bits.toDF("a", "na", "bits_a"), "a").join(bits.toDF("b", "nb", "bits_b"), "b"), percent)


def pivot_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""
    pairs = pairs.join(sets.toDF("a", "tokens"), "a").join(sets.toDF("b", "pivot"), "b")

    def check(batches):
        view = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        for batch in batches:
            ok = np.array([_linked(view(x), view(y), percent) for x, y in zip(batch.column("tokens"), batch.column("pivot"))], bool)
            yield _edges(batch.column("a").to_numpy()[ok], batch.column("b").to_numpy()[ok])

    return pairs.mapInArrow(check, "a long, b long")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (the smallest id that links reach)."""
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    often = frequent_filter(docs, text, n)
    sketch = space.save(sketches(docs, doc_id, text, n, percent, often), "sketch")

    # Classes of equal sets; the smallest id stands for the class.
    classes = space.save(sketch.filter("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")
    heads = sketch.join(classes.select(F.col("rep").alias("id"), "d1", "d2"), ["id", "d1", "d2"], "left_semi").dropDuplicates(["id", "d1", "d2"])
    heads = space.save(heads.withColumn("hid", F.monotonically_increasing_id()), "heads")  # ids may repeat with other texts
    sketch = space.save(sketch.select("id", "n", "d1", "d2"), "rows")
    space.drop("sketch")
    space.release()

    routed = heads.select(F.explode("keys").alias("key"), F.col("hid").alias("id"), "n")
    most = 2 * GROUP_BLOCK
    groups = by_sorted_key(routed, "key", ["id"], lambda t: _groups(t, percent, most), "kind int, gid long, a long, b long", most=most, hot=_large)
    groups = space.save(groups, "groups")
    heads = space.save(heads.drop("keys"), "named-heads")
    space.drop("heads")
    space.release()
    bits = heads.select("hid", "n", "bits")
    members = groups.filter(F.col("kind") == MEMBER).select("gid", "a")
    large = groups.filter(F.col("kind") == LARGE).select("gid", F.col("a").alias("id"), F.col("b").alias("n"))
    named = heads.select(F.col("hid").alias("id"), F.col("id").alias("doc"), "d1", "n")
    links = label = spark.createDataFrame([], "a long, b long")
    if not large.isEmpty():
        pairs = space.save(pivot_pairs(large, bits, percent), "pivot-pairs")
        wanted = named.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", "doc", "d1")
        sets = space.save(full_sets(docs, space.save(wanted, "large-wanted"), n, doc_id, text), "large-sets")
        links = space.save(pivot_links(pairs, sets, percent), "pivot-links")
        space.drop("large-sets")
        space.release()
        label = space.save(connected_components(links, space, "pivots"), "labels")
        marked = large.join(label.withColumnRenamed("root", "label"), "id", "left").fillna(-1, ["label"])
        members = members.unionByName(cells(marked, percent).withColumnRenamed("id", "a"))
    label = label.toDF("id", "label")

    pairs = groups.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    pairs = pairs.join(bits.toDF("a", "na", "bits_a"), "a").join(bits.toDF("b", "nb", "bits_b"), "b")
    members = members.distinct().join(bits.toDF("a", "n", "bits"), "a")
    maybe = _near_pairs(pairs, percent).unionByName(by_sorted_key(members.select("gid", "a", "n", "bits"), "gid", ["a"], _tree_edges(percent), "a long, b long"))
    maybe = space.save(maybe, "maybe")
    space.release()
    near = space.save(connected_components(maybe, space, "near"), "near")

    # The texts of the documents in candidate components move, which are smaller than their sets; a component beyond a block goes in pairs of cells.
    load = near.join(named.select("id", "n"), "id").groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    wide = space.save(load.filter((F.col("c") > GROUP_BLOCK) | (F.col("s") * 8 > BLOCK_BYTES)).select("root"), "wide")
    routes = near.select(F.col("root").alias("route"), "id")
    if not wide.isEmpty():
        inside = near.join(wide, "root", "left_semi").join(named.select("id", "n"), "id").join(label, "id", "left").fillna(-1, ["label"])
        routes = near.join(wide, "root", "left_anti").select(F.col("root").alias("route"), "id").unionByName(cells(inside.withColumnRenamed("root", "gid"), percent).withColumnRenamed("gid", "route"))
    wanted = space.save(routes.join(named.select("id", "doc", "d1"), "id").select("route", "id", "doc", "d1"), "wanted")
    texts = with_texts(docs, wanted, doc_id, text).select("route", "id", "d1", "text")
    found = by_sorted_key(texts, "route", ["id"], _exact_edges(percent), "a long, b long", prepare=lambda batches: _own_sets(batches, n, ["route"]))
    links = space.save(found.unionByName(links), "links")
    space.release()

    # Links join classes; ids that repeat join classes too.
    names = heads.select("hid", F.col("id").alias("rep"))
    linked = links.join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    rows = sketch.filter("n > 0 and id is not null").join(classes.select("d1", "d2", "rep"), ["d1", "d2"]).select("id", "rep")
    repeated = rows.groupBy("id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least <> most").select("id").join(rows, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    component = connected_components(linked.unionByName(repeated), space, "linked")
    out = sketch.select("id", "n", "d1", "d2").join(classes.select("d1", "d2", "rep", F.lit(1).alias("some")), ["d1", "d2"], "left")
    out = out.withColumn("rep", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).otherwise(F.col("id")))
    out = out.join(component.select(F.col("id").alias("rep"), "root"), "rep", "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))


def one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest id of their component; the columns stay."""
    found = jaccard_components(docs, n, percent).filter("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_semi")


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
g AS (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 4
    THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
    ELSE [array_to_string(words, ' ')] END) AS sh
  FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, sh FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
