"""Prefix trie of conversations, named by doubling.

A node is a distinct sequence of first turns. ``node_names`` gives every prefix
of every conversation its node's number without ever holding a sequence: the
turns get dense names (equal turns, equal names), neighbouring blocks of 1, 2,
4, .. turns are named by the pair of their halves' names, and a prefix of d
turns is composed from the blocks of d's binary digits, the longest first. So a
conversation of n turns costs about 3n rows in 2 log2(n) rounds of joins.

Dense names come from the distinct keys of a round: each partition numbers its
own, the partitions' counts are summed (one row a partition), and the table of
names is written before it is joined, so that a repeated task can't rename.

A subtree is summed without walking it: every node belongs to its smallest
member, which owns the nodes of its path from some depth on. What a member owns
at or below a depth is a running sum along its path, and a node's subtree is
what its members own at or below it.

Scale: texts are read once and replaced by their digests (SHA-256 of role and
text). Turns are numbered over ranges of (conversation, turn, digest), so that
a conversation with a third of all turns spreads over all tasks; running sums
go over stretches of ``STRETCH`` turns. A turn that very many conversations
share is a hot key only of joins with one row on the other side, which the
planner splits. Ids of a node's ended conversations are gathered in pieces of
at most ``PIECE`` and digested piece by piece, never in one row.

Defined cases: rows without conv_id belong to no conversation and are left out;
null role and null text count as empty; null turns come first; rows that tie on
turn follow their digests; a repeated row is a turn of its own; an empty table
gives an empty result (no root, as nobody is its member); further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import scratch
from evidentia.llm.periodic import CRC_SQL

STRETCH = 4096
PIECE = 512
LOCAL_BITS = 33


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written, with part (their partition) and at (their place in it)."""
    staged = scratch.stage(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    return staged.select(*rows.columns, F.shiftright("_at", LOCAL_BITS).alias("part"), F.col("_at").bitwiseAND((1 << LOCAL_BITS) - 1).alias("at"))


def dense_names(keys: DataFrame, first: int = 0) -> tuple[DataFrame, int]:
    """The distinct rows of ``keys`` with a dense ``name`` from ``first`` on, and the number after the last."""
    numbered = _numbered(keys.distinct(), "names")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sizes.select("part", (F.sum("n").over(before) - F.col("n") + first).alias("base"))
    named = numbered.join(offsets, "part").select(*keys.columns, (F.col("base") + F.col("at")).alias("name"))
    return named, first + (sizes.agg(F.sum("n")).first()[0] or 0)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_key, bytes (UTF-8, of the text): a row per turn, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", key.alias("turn_key"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "turn_key"]
    numbered = _numbered(rows.repartitionByRange(*order).sortWithinPartitions(*order), "turns")
    parts = numbered.groupBy("conv_id", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    bases = parts.select("conv_id", "part", (F.sum("n").over(before) - F.col("n") - F.col("start") + 1).alias("shift"))
    return numbered.join(bases, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("pos"), "turn_key", "bytes")


def node_names(turns: DataFrame) -> DataFrame:
    """conv_id, depth, name, bytes (of the prefix's last turn) for every non-empty prefix; names count from 1.

    ``turns`` (conv_id, pos from 1 without gaps, turn_key, bytes) should be a staged table."""
    longest = turns.agg(F.max("pos")).first()[0] or 0
    names, _ = dense_names(turns.select("turn_key"))
    levels = [scratch.stage(turns.join(names, "turn_key").select("conv_id", (F.col("pos") - 1).alias("k"), "name", "bytes"), "blocks")]
    while 1 << len(levels) <= longest:
        even = F.col("k") % 2 == 0
        halves = levels[-1].groupBy("conv_id", F.expr("k div 2").alias("k")).agg(
            F.max(F.when(even, F.col("name"))).alias("left"), F.max(F.when(~even, F.col("name"))).alias("right"), F.max(F.when(~even, F.col("bytes"))).alias("bytes")
        ).where("left IS NOT NULL AND right IS NOT NULL")
        names, _ = dense_names(halves.select("left", "right"))
        levels.append(scratch.stage(halves.join(names, ["left", "right"]).select("conv_id", "k", "name", "bytes"), "blocks"))
    found, following = None, 1
    for j in range(len(levels) - 1, -1, -1):
        blocks = levels[j].where("k % 2 = 0").select("conv_id", (F.col("k") * (1 << j)).alias("before"), F.col("name").alias("block"), "bytes")
        pairs = blocks.where("before = 0").withColumn("prefix", F.lit(0).cast("long"))
        if found is not None:
            shorter = found.select("conv_id", F.col("depth").alias("before"), F.col("name").alias("prefix"))
            pairs = pairs.unionByName(blocks.where("before > 0").join(shorter, ["conv_id", "before"]))
        names, following = dense_names(pairs.select("prefix", "block"), following)
        new = scratch.stage(pairs.join(names, ["prefix", "block"]).select("conv_id", (F.col("before") + (1 << j)).alias("depth"), "name", "bytes"), "prefixes")
        found = new if found is None else found.unionByName(new)
    return found


def _digest_pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A digest for each name of rows sorted by (name, piece), over as many batches as its pieces fill."""
    name, state = None, None
    for part in parts:
        done = []
        for x, ids in zip(part["name"].tolist(), part["ids"], strict=True):
            if x != name:
                if state is not None:
                    done.append((name, state.hexdigest()))
                name, state = x, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["name", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(name, state.hexdigest())], columns=["name", "ends_sha256"])


def ids_digests(ends: DataFrame) -> DataFrame:
    """name, ends_sha256: the SHA-256 of each name's conv_ids, ascending, joined by commas."""
    of = ends.groupBy("name", F.expr(f"conv_id div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = of.select("name", "piece", F.array_join("ids", ",").alias("ids"))
    return pieces.repartition("name").sortWithinPartitions("name", "piece").mapInPandas(_digest_pieces, "name long, ends_sha256 string")


def _own_sums(own: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """``own`` (conv_id, depth, ..) with each column summed over this depth and all deeper ones of
    its conversation, and the sums of whole conversations."""
    stretch = F.expr(f"depth div {STRETCH}").alias("stretch")
    per = own.groupBy("conv_id", stretch).agg(*[F.sum(c).alias(f"{c}_all") for c in columns])
    deeper = Window.partitionBy("conv_id").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, 0)
    after = per.select("conv_id", "stretch", *[(F.sum(f"{c}_all").over(deeper) - F.col(f"{c}_all")).alias(f"{c}_after") for c in columns])
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = own.withColumn("stretch", stretch).join(after, ["conv_id", "stretch"])
    summed = summed.select("name", *[(F.sum(c).over(inside) + F.col(f"{c}_after")).alias(c) for c in columns])
    return summed, own.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in columns])


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of conversations given by ``turns`` (see ``node_names``) and ``lengths``
    (conv_id, n_turns; those without a turn too), both staged: a row per node."""
    prefixes = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("bytes"))
    if (named := node_names(turns)) is not None:
        prefixes = prefixes.unionByName(named)
    # written first, so that the planner can split the hot names (root, common first turns) of the join
    nodes = scratch.stage(prefixes.groupBy("name").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")), "nodes")
    paths = scratch.stage(prefixes.join(nodes, "name"), "paths")
    own = paths.where("conv_id = owner")
    above = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("owner").alias("parent_conv_id"))
    own = scratch.stage(own.drop("owner").join(above, ["conv_id", "depth"], "left"), "nodes")
    children = own.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    full = scratch.stage(own.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    weights = full.select("conv_id", "depth", "name", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    mine, whole = _own_sums(weights, "n_leaves", "saved_tokens")
    others = paths.where("conv_id <> owner").select("conv_id", "name").join(scratch.stage(whole, "sums"), "conv_id").select("name", "n_leaves", "saved_tokens")
    sums = mine.unionByName(others).groupBy("name").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = paths.select("conv_id", "depth", "name").join(lengths, "conv_id").where("depth = n_turns").select("conv_id", "name")
    out = full.join(sums, "name").join(ids_digests(ends), "name", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of whole conversations: a row per node, as ``trie``."""
    turns = scratch.stage(turn_rows(conversations), "turns")
    return trie(turns, scratch.stage(turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns")), "lengths"))


def _cut(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` of conversations whose first turns are replaced by those of another one in five, and their lengths."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    own = lengths.select("conv_id", "n", _cut(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    base = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    own = scratch.stage(own.join(base, "base", "left").select("conv_id", "base", "h", "n", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "lengths")
    first = turns.where("pos <= 8").withColumnRenamed("conv_id", "base").join(own.select("conv_id", "base", "h"), "base").where("pos <= h").select("conv_id", "pos", "turn_key", "bytes")
    rest = turns.join(own.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "bytes")
    return scratch.stage(first.unionByName(rest), "rebuilt"), own.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, rebuilt so that they share first turns."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(*rebuilt(scratch.stage(turn_rows(rows), "turns")))


SQL_TRIE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k, bytes FROM (
    SELECT conv_id, turn, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {CRC_SQL.format(x="CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t GROUP BY conv_id
), parts AS (
  SELECT c.conv_id, 0 AS side, t.pos, k, bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, k, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), r AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, pos) AS depth, k, bytes FROM parts
), p AS (
  SELECT conv_id, depth, bytes, sha256(string_agg(k, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), len AS (
  SELECT conv_id, max(depth) AS n_turns FROM p GROUP BY conv_id
), n AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY node, depth
), e AS (
  SELECT node, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM p JOIN len USING (conv_id) WHERE depth = n_turns GROUP BY node, depth
), up AS (
  SELECT n.node, n.depth, q.node AS parent, m.conv_id AS parent_conv_id FROM n JOIN p q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 JOIN n m ON m.node = q.node AND m.depth = q.depth
), ch AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM up GROUP BY ALL
), w AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * bytes AS saved FROM n LEFT JOIN ch USING (node, depth)
), s AS (
  SELECT a.node, a.depth, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, CAST(sum(w.saved) AS BIGINT) AS saved_tokens
  FROM w JOIN p a ON a.conv_id = w.conv_id AND a.depth <= w.depth GROUP BY a.node, a.depth
)
SELECT w.conv_id, w.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM w JOIN s USING (node, depth) LEFT JOIN up USING (node, depth) LEFT JOIN e USING (node, depth)
"""
