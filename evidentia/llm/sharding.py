"""Sharding by sampled splitters: ranges of near-equal bytes that keep equal texts together.

Records are ordered by (hash of the text, hash of doc_id). Keys are sampled with
probability proportional to size; quantiles of the sample are the splitters that
cut the order into many fine ranges, and a text that fills several ranges is
subdivided by doc_id. The exact bytes of each range are then summed, and a
record's place in the order is its range's base plus a running sum inside the
range. The sample decides how evenly work is spread, not the result.

The law here is ``bytes``, with groups of equal texts whole. A group (or single
record) of more than ``SMALL`` of a shard's mean size is seated by itself: there
are at most ``shards / SMALL`` of them whatever the input, so the driver seats
them, the largest first, each on the emptiest shard. Only a group larger than a
shard is cut, into pieces of as many records as a shard holds, seated like the
others. All smaller groups form one line, which the shards' remaining room cuts
into one stretch each; a group goes where its middle lies and so stays whole.
A shard's size thus differs from the mean by less than ``SMALL`` of it or the
largest record, unless whole groups themselves leave no better seating.

Scale: texts are read once; everything after works on about 40 bytes a record.
The sample is bounded (``SAMPLES`` expected rows, whatever the input); the driver
holds the sample, the splitters and the seats only. Slots come from row counts
of ranges, so that no shard is numbered by one task.

Defined cases: a null text has no bytes and is a group with the empty ones;
records equal in text and doc_id follow in any order, their rows being the same;
with more shards than groups some shards stay empty; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from evidentia.llm import scratch

SHARDS = 40
OVERHEAD = 16
#: Expected number of sampled keys, and of fine ranges.
SAMPLES = 16384
RANGES = 1024
#: Groups of equal texts above this share of a shard's mean size are seated one by one.
SMALL = 0.02
#: Lane of the groups that stand in line; seated ones have their hash's place in the driver's list.
LINE = -1


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the two hashes of the order; no text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return documents.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"), F.xxhash64("doc_id", F.lit("shard")).alias("d"))


def splitters(records: DataFrame, total: int, seated: set[int], samples: int = SAMPLES, ranges: int = RANGES) -> list[tuple[int, int]]:
    """Quantiles of a size-weighted sample of the keys; whether a record is drawn depends on its key alone."""
    rate = samples / max(total, 1)
    draw = F.pmod(F.xxhash64("d", "h", F.lit("draw")), F.lit(1 << 40)).cast("double") / float(1 << 40)
    # a record larger than one sampling step counts as often as it holds steps
    weight = F.greatest(F.floor(F.col("size") * rate), F.lit(1))
    drawn = sorted((r.h, r.d, r.w) for r in records.where(draw < F.col("size") * rate).select("h", "d", weight.alias("w")).collect())
    if not drawn:
        return []
    at = np.cumsum([w for _, _, w in drawn])
    cuts = sorted({drawn[i][:2] for i in np.searchsorted(at, np.linspace(0, at[-1], ranges + 1)[1:-1])})
    # a text that a splitter falls upon stays in one range, but for one that is seated by itself and fills ranges of its own
    often = Counter(h for h, _ in cuts)
    return sorted({(h, d if often[h] > 1 and h in seated else -(1 << 63)) for h, d in cuts})


def with_range(records: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``, the number of splitters at or below the record's key."""
    heads = np.array([h for h, _ in cuts], dtype=np.int64)
    tails = np.array([d for _, d in cuts], dtype=np.int64)

    @F.pandas_udf(LongType())
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hs, ds in parts:
            h, d = hs.to_numpy(np.int64), ds.to_numpy(np.int64)
            lo, hi = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
            out = lo.copy()
            for i in np.flatnonzero(hi > lo):  # a splitter cuts the group of this text
                out[i] += np.searchsorted(tails[lo[i] : hi[i]], d[i], "right")
            yield pd.Series(out)

    return records.withColumn("range", place("h", "d"))


def seat(groups: list[tuple[int, int, int]], total: int, shards: int) -> tuple[list[list[tuple[float, int]]], list[tuple[float, int]]]:
    """Seats of groups (hash, bytes, bytes of a record), and of the line: stretches (end, shard) of each one's running bytes.

    A group has one stretch, unless it is larger than a shard: then pieces of as many whole records as a shard holds."""
    mean = total / shards
    stretches: list[list[tuple[float, int]]] = [[] for _ in groups]
    items = []  # (bytes, group, piece)
    for i, (_, size, record) in enumerate(groups):
        piece = size if size <= mean else record * max(1, int(mean // record))
        items += [(min(piece, size - at), i, k) for k, at in enumerate(range(0, size, piece))]
    heap = [(0, s) for s in range(shards)]
    seats = {}
    for size, i, k in sorted(items, key=lambda x: (-x[0], groups[x[1]][0], x[2])):
        held, s = heapq.heappop(heap)
        seats[i, k] = size, s
        heapq.heappush(heap, (held + size, s))
    for (i, _), (size, s) in sorted(seats.items()):
        stretches[i].append(((stretches[i][-1][0] if stretches[i] else 0) + size, s))
    load = {s: held for held, s in heap}
    # the line fills the room below one common level
    room = sorted((held, s) for s, held in load.items())
    left, level = total - sum(size for _, size, _ in groups), 0.0
    for n in range(1, shards + 1):
        level = (left + sum(held for held, _ in room[:n])) / n
        if n == shards or level <= room[n][0]:
            break
    line, end = [], 0.0
    for held, s in sorted(room, key=lambda x: x[1]):
        if level > held:
            end += level - held
            line.append((end, s))
    return stretches, line or [(float("inf"), 0)]


def _seats(lanes: list[list[tuple[float, int]]]):
    """A Pandas UDF from (lane, place of the middle) to the shard; the line's stretches stand last."""
    ends = [np.array([e for e, _ in own]) for own in lanes]
    shards = [np.array([s for _, s in own]) for own in lanes]

    @F.pandas_udf(IntegerType())
    def find(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lane, middle in parts:
            lane, middle = lane.to_numpy(np.int64), middle.to_numpy(np.float64)
            out = np.zeros(len(lane), np.int32)
            for one in np.unique(lane):
                mine = lane == one
                at = np.searchsorted(ends[one], middle[mine], "right")
                out[mine] = shards[one][np.minimum(at, len(ends[one]) - 1)]
            yield pd.Series(out)

    return find


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place inside the shard)."""
    spark = documents.sparkSession
    records = scratch.stage(measured(documents), "records")
    total = records.agg(F.sum("size")).first()[0] or 0
    # at most shards / SMALL rows, whatever the input
    large = records.groupBy("h").agg(F.sum("size").alias("bytes"), F.max("size").alias("record")).where(F.col("bytes") * shards > SMALL * total)
    groups = sorted((r.h, r.bytes, r.record) for r in large.collect())
    stretches, line = seat(groups, total, shards)
    lanes = F.broadcast(spark.createDataFrame([(h, i) for i, (h, *_) in enumerate(groups)], "h long, own int"))  # bounded as above
    ranged = with_range(records, splitters(records, total, {h for h, *_ in groups})).join(lanes, "h", "left").withColumn("lane", F.coalesce("own", F.lit(LINE))).drop("own")
    sums = ranged.groupBy("lane", "range").agg(F.sum("size").alias("bytes"))
    # a row per range and seated group in it: at most RANGES + 2 shards / SMALL, whatever the input
    before = Window.partitionBy("lane").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("lane", "range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("lane", "range").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("run", F.sum("size").over(inside)).join(F.broadcast(bases), ["lane", "range"])
    # where the middle lies: of the whole group in the line, of the record in a seated group
    group = Window.partitionBy("lane", "range", "h")
    in_line = F.col("lane") == LINE
    end = F.col("base") + F.when(in_line, F.max("run").over(group)).otherwise(F.col("run"))
    middle = end.cast("double") - F.when(in_line, F.sum("size").over(group)).otherwise(F.col("size")) / 2
    find = _seats([*stretches, line])
    placed = run.select("doc_id", "size", "text_crc32", "lane", "range", "h", "d", find(F.when(in_line, len(stretches)).otherwise(F.col("lane")), middle).alias("shard"))
    placed = scratch.stage(placed, "placed")
    counts = placed.groupBy("shard", "lane", "range").agg(F.count("*").alias("rows"))
    ahead = Window.partitionBy("shard").orderBy("lane", "range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", "lane", "range", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "lane", "range").orderBy("h", "d"))
    numbered = placed.withColumn("nth", nth).join(F.broadcast(firsts), ["shard", "lane", "range"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``bytes``."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
