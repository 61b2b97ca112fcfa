"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot i of the mix gets the point frac(i * golden ratio); the point's place in the
cumulative target weights names the slot's source, and the slot's rank among the
slots of its source names the block it takes. A source is a shuffled stream of
words, repeated as often as it may be and cut into blocks of ``BLOCK_WORDS`` words.
Joining slots with the blocks that a document overlaps gives the words the mix takes
of it, and where. The sequence's low discrepancy brings each source within a few blocks of its target;
closing slots behind the schedule's last one give what a source still lacks, and the source's last block is cut where
its target is reached, so a source of a few words gets its share too.

Defined results: a null text has size 0; the null source is a source and comes
last; a source or table without words has target 0 and takes nothing; every row
is a document, also when ids repeat; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .workspace import Workspace

# Weights by the source's place, the share of all words, the most a source may repeat.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
GOLDEN = 0.6180339887498949
BLOCK_WORDS, CHUNK_SLOTS = 64, 4096  # words of a block, at every size of the input; slots that are ranked at a time
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): one row per source, so one small sorted task.

    Sources reach their ceiling in the order ceiling / weight. With the first j
    at their ceilings the others get (budget - ceilings) * weight / weights left;
    the first source that stays under its ceiling fixes that level for all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select("*", F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"), F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_capped"), F.sum("w").over(everyone).alias("w_all"), (F.sum("source_size").over(everyone) * share).alias("budget"))
    level = (F.col("budget") - F.col("capped")) / (F.col("w_all") - F.col("w_capped"))
    s = s.withColumn("first", F.when(level * F.col("w") <= F.col("cap"), F.struct(F.row_number().over(order).alias("at"), level.alias("level"))))
    s = s.withColumn("level", F.min("first").over(everyone)["level"])
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def schedule(spark, shares: DataFrame, n: int, total: float, step: float) -> tuple[DataFrame, list]:
    """(place, slot, rank) of the mix's n slots, and the sources by place: each slot names its source and the source's block.

    Ranks come from counts per chunk of slots plus a rank inside the chunk, so no
    task sorts more than a chunk, or the chunks' counts of one source.
    """
    cum = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    steps = shares.filter("target > 0").select("source", "target", F.sum("target").over(cum).alias("hi"))
    edges = [(r.source, r.hi) for r in steps.orderBy("hi").toLocalIterator()]  # one pair per source: the weights of the mix
    point = F.col("slot") * F.lit(step)
    point = (point - F.floor(point)) * F.lit(float(total))
    his = F.array(*[F.lit(float(h)) for _, h in edges]) if edges else F.array().cast("array<double>")
    place = F.least(F.size(F.filter(his, lambda h: h <= point)), F.lit(max(len(edges) - 1, 0)))
    slots = spark.range(n if edges else 0).select(F.col("id").alias("slot"), F.expr(f"id div {CHUNK_SLOTS}").alias("chunk")).withColumn("place", place)
    counts = slots.groupBy("place", "chunk").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("place", "chunk", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("place", "chunk").orderBy("slot")
    ranked = slots.withColumn("rn", F.row_number().over(inside)).join(counts.hint("merge"), ["place", "chunk"])
    return ranked.select("place", "slot", (F.col("base") + F.col("rn") - 1).alias("rank")), [s for s, _ in edges]


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, step: float = GOLDEN, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """Per document: id, source, size, source_size, target, taken, first_slot (where the mix first takes it; null if never)."""
    spark = docs.sparkSession
    space = Workspace(spark, "mix")
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")))))  # rows without an id are shuffled by their text
    doc = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(name).alias("shuffle"))
    doc = space.save(doc.withColumn("bucket", F.substring("shuffle", 1, 3)), "sizes")

    # Place of each document in its source's shuffled stream: sums per bucket of the shuffle key, then inside the bucket.
    buckets = doc.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col("source").alias("b_source"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    sizes = doc.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = space.save(targets(sizes, weights, share, most), "targets")
    total = shares.agg(F.sum("target")).first()[0] or 0.0
    n = round(2 * total) // (2 * block_words) + 1 if total else 0

    slots, names = schedule(spark, shares, n, total, step)
    slots = space.save(slots, "slots")
    drawn = slots.groupBy("place").agg(F.count("*").alias("n_slots"))
    named = spark.createDataFrame(list(enumerate(names)), "place int, name string")
    # A source gives its target in whole words, and no document more than ``most`` times.
    limit = F.least(F.round("target"), F.floor(F.col("source_size") * float(most))).cast("long")
    plan = shares.join(named, F.col("source").eqNullSafe(F.col("name")), "left").join(drawn, "place", "left")
    plan = space.save(plan.select(F.col("source").alias("p_source"), "source_size", "target", "place", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), limit.alias("limit")), "plan")
    closing = plan.filter(F.col("limit") > F.col("n_slots") * block_words).withColumn("rank", F.explode(F.sequence("n_slots", F.expr(f"(limit - 1) div {block_words}"))))
    slots = slots.unionByName(closing.select("place", (n + F.col("place") + (F.col("rank") - F.col("n_slots")) * len(names)).alias("slot"), "rank"))

    inside = Window.partitionBy("source", "bucket").orderBy("shuffle", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = doc.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.count("*").over(inside))
    placed = placed.join(buckets.hint("merge"), F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bucket") == F.col("b_bucket")), "left")
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left")  # a row per source: Spark broadcasts it by its size
    placed = space.save(placed.select("id", "source", "bucket", "nth", "size", "source_size", "target", "place", "limit", (F.col("base") + F.col("upto") - F.col("size")).alias("start")), "placed")

    # A document lies once in every pass over its source; the blocks that it overlaps there meet their slots.
    spans = placed.filter((F.col("size") > 0) & (F.col("limit") > 0)).withColumn("pass", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("limit") / F.col("source_size")) - 1).cast("int"))))
    spans = spans.withColumn("lo", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("limit"))).filter("hi > lo")
    pieces = spans.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block_words}"), F.expr(f"(hi - 1) div {block_words}"))))
    pieces = pieces.select("place", "bucket", "nth", "rank", (F.least("hi", (F.col("rank") + 1) * block_words) - F.greatest("lo", F.col("rank") * block_words)).alias("words"))
    taken = pieces.join(slots, ["place", "rank"]).groupBy("place", "bucket", "nth").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    out = placed.join(taken, ["place", "bucket", "nth"], "left")
    return out.select(F.col("id").alias(doc_id), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_documents(docs: DataFrame, in_order: bool = False, **options) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, to the nearest whole document; all columns stay.

    in_order: the rows come by the slots that first take them, so files written from them follow the schedule.
    """
    taken = mix(docs, **options).filter("taken > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).alias("__times"), F.col("first_slot").alias("__slot"))
    # Rows that repeat an id, source and size share their number evenly.
    taken = taken.groupBy("__id", "__source", "__size").agg(F.round(F.avg("__times")).cast("int").alias("__times"), F.min("__slot").alias("__slot")).filter("`__times` > 0")
    sized = docs.withColumn("__words", word_count(F.col("text")))
    joined = sized.join(taken, sized["doc_id"].eqNullSafe(taken["__id"]) & sized["source"].eqNullSafe(taken["__source"]) & (sized["__words"] == taken["__size"]))
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    if in_order:
        copies = copies.repartitionByRange("__copy", "__slot").sortWithinPartitions("__copy", "__slot")
    return copies.select(*[sized[c] for c in docs.columns])


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS w,
         2.0::DOUBLE * source_size AS cap FROM s),
o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS capped,
         coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS w_capped,
         sum(w) OVER () AS w_all, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         row_number() OVER (ORDER BY cap / w, source ASC NULLS LAST) AS nth FROM w),
l AS (SELECT arg_min((budget - capped) / (w_all - w_capped), nth) FILTER (WHERE (budget - capped) / (w_all - w_capped) * w <= cap) AS level FROM o),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM o, l),
e AS (SELECT *, sum(target) OVER (ORDER BY source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS hi, sum(target) OVER () AS total FROM t WHERE target > 0),
n AS (SELECT unnest(range(CAST(round(2 * total) AS BIGINT) // 128 + 1)) AS slot, total FROM (SELECT DISTINCT total FROM e)),
x AS (SELECT slot, (slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE)) * total AS point FROM n),
h AS (SELECT list(hi ORDER BY hi) AS his FROM e),
y AS (SELECT slot, least(len(list_filter(his, lambda v: v <= point)), len(his) - 1) AS place FROM x, h),
z AS (SELECT place, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM y),
k AS (SELECT place, count(*) AS n_slots FROM z GROUP BY place),
q AS (SELECT t.*, e.place, coalesce(k.n_slots, 0) AS n_slots, CAST(least(round(target), 2 * t.source_size) AS BIGINT) AS lim
      FROM t LEFT JOIN (SELECT source, row_number() OVER (ORDER BY hi) - 1 AS place FROM e) e ON e.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.place = e.place),
c AS (SELECT place, unnest(range(n_slots, (lim - 1) // 64 + 1)) AS rank, n_slots FROM q WHERE lim > n_slots * 64),
j AS (SELECT place, slot, rank FROM z UNION ALL SELECT place, (SELECT max(slot) + 1 FROM n) + place + (rank - n_slots) * (SELECT count(*) FROM e), rank FROM c),
p AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.place, q.lim,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.m, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS lo
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
r AS (SELECT *, greatest(0, least(lo + size, lim) - lo) AS one, greatest(0, least(source_size + lo + size, lim) - source_size - lo) AS two FROM p)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken, least(a.first, b.first) AS first_slot
FROM r
LEFT JOIN LATERAL (SELECT min(slot) AS first FROM j WHERE j.place = r.place AND one > 0 AND j.rank = lo // 64) a ON true
LEFT JOIN LATERAL (SELECT min(slot) AS first FROM j WHERE j.place = r.place AND two > 0 AND j.rank = (source_size + lo) // 64) b ON true
"""
