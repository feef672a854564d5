"""Mixing sources to target weights by a low-discrepancy source schedule, natively.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share the words of all documents; a target stops at ``cap`` times its source's
own words and the excess is shared again by weight (water filling, in closed
form over the sources sorted by size per weight).

Schedule: slot i of about ``words / block_words`` slots takes the golden-ratio
point frac((i + 1) * phi), which falls into one source's interval of the
cumulative targets; slots are ranked within their source. The documents of a
source, in a shuffled order, form one circular stream of words; rank r of n
takes the r-th of n equal blocks of the stream's first ``target`` words, passing
over the stream again as often as needed. Each source's blocks differ by one
word at most, so its taken words are the whole part of its target, and no
document is taken more than ``cap`` times.

Scale: texts are read once and never shuffled; a source's stream positions come
from sums over hash-prefix buckets plus a running sum within a bucket, ranks
from sums over chunks of slots, and blocks meet documents by stream cell, so
that a source with a third of all rows is spread over all tasks. The only
unpartitioned window runs over one row per source.

Defined cases: a null source is a source of its own; null and empty texts have
size 0 and are never taken; repeated rows are documents of their own; rows that
tie in the shuffled order follow doc_id, then size; rows without doc_id are
shuffled by their texts; an empty table gives an
empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 1024
SEED = "mix-1"
#: Words of a source's stream in one cell of the join between documents and blocks.
CELL_WORDS = 4096
#: 2**32 divided by the golden ratio, odd.
GOLDEN_32 = 2654435769
SLOT_CHUNK_BITS = 16
POINT_CELL_BITS = 20


def sized(documents: DataFrame, *keep: str) -> DataFrame:
    """doc_id, source, size, shuffle_key and the columns in ``keep``; no text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))))
    return documents.select("doc_id", "source", size.alias("size"), key.alias("shuffle_key"), *keep)


def source_targets(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row per source: idx, source, source_size, weight, target, total."""
    scale = 1
    for w in weights:
        scale *= w
    per = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*map(F.lit, weights))
    per = per.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    per = per.withColumn("weight", F.get(cycle, F.col("idx") % len(weights)).cast("long"))
    per = per.withColumn("fill", F.col("source_size") * F.expr(f"{scale} div weight"))
    up = Window.orderBy("fill", "idx").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("fill", "idx").rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy("fill", "idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = lambda c: c.cast("decimal(19,0)")
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        (F.lit(cap) * F.coalesce(F.sum("source_size").over(up), F.lit(0))).alias("below"),
        F.sum("weight").over(on).alias("weight_left"),
        F.row_number().over(Window.orderBy("fill", "idx")).alias("place"),
    )
    open_ = wide(F.lit(cap) * F.col("source_size")) * wide(F.col("weight_left")) >= wide(F.col("total") - F.col("below")) * wide(F.col("weight"))
    per = per.withColumn("first_open", F.min(F.when(open_, F.struct("place", "below", "weight_left"))).over(every))
    shared = F.col("weight").cast("double") * (F.col("total") - F.col("first_open.below")).cast("double") / F.col("first_open.weight_left").cast("double")
    capped = F.col("place") < F.col("first_open.place")
    target = F.when(capped, (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(shared)
    return per.select("idx", "source", "source_size", "weight", target.alias("target"), "total")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per slot: slot, idx, rank, slots (of the source), from and to in the source's unrolled stream."""
    spark = targets.sparkSession
    total = targets.agg(F.max("total")).first()[0] or 0
    n = -(-total // block_words)
    run = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    spans = targets.withColumn("hi", F.sum("target").over(run))
    to_point = lambda c: F.least(F.floor(c / F.greatest(F.col("total"), F.lit(1)) * float(2**32)), F.lit(2**32)).cast("long")
    spans = spans.select("idx", F.floor("target").cast("long").alias("words"), to_point(F.col("hi") - F.col("target")).alias("lo"), to_point(F.col("hi")).alias("hi"))
    cells = spans.where("hi > lo").select("*", F.explode(F.sequence(F.shiftright("lo", POINT_CELL_BITS), F.shiftright(F.col("hi") - 1, POINT_CELL_BITS))).alias("cell"))
    slots = spark.range(n).select(F.col("id").alias("slot"), ((((F.col("id") + 1) % 2**31) * GOLDEN_32) % 2**32).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", POINT_CELL_BITS)).withColumn("chunk", F.shiftright("slot", SLOT_CHUNK_BITS))
    placed = slots.join(cells, "cell").where("point >= lo AND point < hi").select("slot", "chunk", "idx", "words")
    per_chunk = placed.groupBy("chunk", "idx").agg(F.count("*").alias("n"))
    by_chunk = Window.partitionBy("idx").orderBy("chunk")
    bases = per_chunk.select(
        "chunk",
        "idx",
        (F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"),
        F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("slots"),
    )
    bases = scratch.stage(bases, "slots")
    ranked = placed.join(bases, ["chunk", "idx"]).select("slot", "idx", "words", "slots", (F.col("base") + F.row_number().over(Window.partitionBy("chunk", "idx").orderBy("slot")) - 1).alias("rank"))
    # a source whose interval no point has met gets one slot after all others
    unmet = spans.where("words > 0").join(bases, "idx", "left_anti").select((F.lit(n) + F.col("idx")).alias("slot"), "idx", "words", F.lit(1).cast("long").alias("slots"), F.lit(0).cast("long").alias("rank"))
    edge = lambda r: F.expr(f"({r}) * (words div slots) + (({r}) * (words % slots)) div slots")
    return ranked.unionByName(unmet).select("slot", "idx", "rank", "slots", edge("rank").alias("from"), edge("rank + 1").alias("to"))


def mix(narrow: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: a row per document and block that overlap (slot, pass, word_from, word_to
    within the document), and one with null slot for a document that no block takes.

    ``narrow`` and ``targets`` should be staged tables (see ``scratch.stage``)."""
    keyed = narrow.withColumn("bucket", F.substring("shuffle_key", 1, 3)).join(targets, narrow["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    sums = keyed.groupBy("idx", "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = sums.select("idx", "bucket", (F.sum("in_bucket").over(Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_bucket")).alias("base"))
    inside = Window.partitionBy("idx", "bucket").orderBy("shuffle_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("base") + F.sum("size").over(inside) - F.col("size")
    placed = keyed.where("size > 0").join(sums, ["idx", "bucket"]).withColumn("start", start).drop("base", "bucket")
    doc_cells = placed.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {CELL_WORDS}"), F.expr(f"(start + size - 1) div {CELL_WORDS}"))))

    blocks = schedule(targets, block_words).where("`to` > `from`").join(targets.select("idx", F.col("source_size").alias("stream")), "idx")
    blocks = blocks.withColumn("pass", F.explode(F.sequence(F.expr("`from` div stream"), F.expr("(`to` - 1) div stream"))))
    origin = F.col("pass") * F.col("stream")
    blocks = blocks.select("slot", "idx", "pass", F.greatest(F.col("from") - origin, F.lit(0)).alias("y0"), F.least(F.col("to") - origin, F.col("stream")).alias("y1"))
    blocks = blocks.withColumn("cell", F.explode(F.sequence(F.expr(f"y0 div {CELL_WORDS}"), F.expr(f"(y1 - 1) div {CELL_WORDS}"))))

    d, b = doc_cells.alias("d"), blocks.alias("b")
    lo = F.greatest(F.col("d.start"), F.col("b.y0"), F.col("d.cell") * CELL_WORDS)
    hi = F.least(F.col("d.start") + F.col("d.size"), F.col("b.y1"), (F.col("d.cell") + 1) * CELL_WORDS)
    meet = (F.col("d.idx") == F.col("b.idx")) & (F.col("d.cell") == F.col("b.cell")) & (lo < hi)
    met = F.col("b.slot").isNotNull()
    pieces = d.join(b, meet, "left").select(
        "d.*", "b.slot", "b.pass", F.when(met, lo - F.col("d.start")).alias("word_from"), F.when(met, hi - F.col("d.start")).alias("word_to")
    ).drop("cell")
    empty = keyed.where("size = 0").drop("bucket")
    return pieces.unionByName(empty, allowMissingColumns=True)


def taken(narrow: DataFrame, targets: DataFrame, *keys: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``keys``, a row per document."""
    pieces = mix(narrow, targets, block_words)
    of = ["doc_id", "size", "source_size", "target", *keys]
    whole = pieces.where("size > 0").groupBy("idx", "start", *of).agg(F.sum(F.coalesce(F.col("word_to") - F.col("word_from"), F.lit(0))).alias("taken"))
    none = pieces.where("size = 0").select(*of, F.lit(0).cast("long").alias("taken"))
    return whole.select(*of, "taken").unionByName(none)


def mix_documents(documents: DataFrame) -> DataFrame:
    """The documents with each one repeated as often as the mix takes it, a part counting as a whole.

    Rows equal in doc_id (null too) and text share what the mix takes of them: each
    gets the whole part of its share, and the least of them (by its columns in order,
    as JSON) what is left over. Further columns may have any name."""
    key = F.md5(F.coalesce(F.col("text"), F.lit("")))
    narrow = scratch.stage(sized(documents.select("doc_id", "source", "text", key.alias("text_key")), "text_key"), "mix")
    targets = scratch.stage(source_targets(narrow), "targets")
    each = taken(narrow, targets, "text_key").select("doc_id", "text_key", F.when(F.col("taken") > 0, F.expr("(taken + size - 1) div size")).otherwise(0).alias("copies"))
    shares = each.groupBy("doc_id", "text_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("equals")).where("copies > 0")
    shares = scratch.stage(shares.withColumnsRenamed({"doc_id": "of_doc", "text_key": "of_key"}), "shares")
    rows = documents.select(F.struct("*").alias("row"), key.alias("text_key"))  # the row's columns can't clash with those made here
    joined = rows.join(shares, F.col("row.doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_key")))
    alike = joined.where("equals > 1 AND copies % equals > 0").groupBy("of_doc", "of_key").agg(F.min_by("row", F.to_json("row")).alias("row"), F.max(F.expr("copies % equals")).alias("times"))
    every = joined.select("row", F.expr("copies div equals").alias("times")).where("times > 0").unionByName(alike.select("row", "times"))
    return every.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    narrow = scratch.stage(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix")
    targets = scratch.stage(source_targets(narrow), "targets")
    return taken(narrow, targets)


SQL_MIXING = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + idx % 3] AS weight FROM per
), f AS (
  SELECT *, source_size * 10 // weight AS fill FROM w
), s AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
    CAST(3 * coalesce(sum(source_size) OVER (ORDER BY fill, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS below,
    CAST(sum(weight) OVER (ORDER BY fill, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left,
    row_number() OVER (ORDER BY fill, idx) AS place
  FROM f
), o AS (
  SELECT place, below, weight_left FROM s
  WHERE CAST(3 * source_size AS HUGEINT) * weight_left >= CAST(total - below AS HUGEINT) * weight ORDER BY place LIMIT 1
), t AS (
  SELECT s.source, s.source_size, s.idx, CASE WHEN s.place < o.place THEN CAST(3 * s.source_size AS DOUBLE)
    ELSE CAST(s.weight AS DOUBLE) * CAST(s.total - o.below AS DOUBLE) / CAST(o.weight_left AS DOUBLE) END AS target
  FROM s, o
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS words,
    CAST(sum(d.size) OVER (PARTITION BY t.idx ORDER BY d.k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(
  greatest(least(start + size, words) - start, 0) + greatest(least(start + size, words - source_size) - start, 0)
  + greatest(least(start + size, words - 2 * source_size) - start, 0) AS BIGINT) AS taken
FROM p
"""
