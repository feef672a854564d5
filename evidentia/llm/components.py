"""Connected components of a distributed edge table by alternating stars.

A local union-find shrinks the edges of each partition to stars; large and
small star steps then alternate, the edges shrunk again after each, until only
stars are left. Every step is a
grouped minimum, combined before the exchange, and a join on the node; the few
nodes with very many edges are joined by broadcast, so that no task gathers
them. Edges never come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import scratch

#: Nodes with more than one part in so many of all edges are joined by broadcast.
HEAVY = 1000


def _contract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def roots() -> pd.DataFrame:
        found = [(x, find(x)) for x in list(parent)]
        return pd.DataFrame([(x, r) for x, r in found if x != r], columns=["u", "v"], dtype="int64")

    for part in parts:
        for a, b in zip(part["u"].tolist(), part["v"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:  # bounded memory: emit what is known and start afresh
            yield roots()
            parent = {}
    yield roots()


def _with_low(edges: DataFrame, low: DataFrame, heavy_from: int) -> DataFrame:
    """``edges`` with the minimum m of their u. Nodes with many edges are few (their number is bounded by the caller) and are broadcast, so that no task gathers one node's edges."""
    heavy = F.broadcast(low.where(F.col("n") > heavy_from).select("u", F.col("m").alias("heavy_m")))
    marked = edges.join(heavy, "u", "left")
    light = marked.where("heavy_m IS NULL").drop("heavy_m").join(low.where(F.col("n") <= heavy_from).drop("n").hint("merge"), "u")
    return marked.where("heavy_m IS NOT NULL").withColumnRenamed("heavy_m", "m").unionByName(light)


def _edges_and_faults(links: DataFrame) -> tuple[int, int]:
    """How many distinct edges (u > v) there are, and how many nodes keep them from being stars: a u with several v, or one that is itself a v. Without any, each v is the smallest of its component."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    nodes = links.select(ends.alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    edges, faults = nodes.agg(F.sum("up"), F.count_if(F.expr("up > 1 OR (up = 1 AND down = 1)"))).first()
    return edges or 0, faults


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), for every node of ``edges`` (u, v: long) but the smallest ones."""

    def shrunk(some: DataFrame) -> DataFrame:
        return scratch.stage(some.where("u <> v").mapInPandas(_contract, "u long, v long").distinct(), "links")

    links = shrunk(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while (state := _edges_and_faults(links))[1]:
        # at most 2 * HEAVY nodes have more than a 1 / HEAVY part of the edges, counted at both ends
        heavy_from = max(64, state[0] // HEAVY)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_low(both.where("v > u"), low, heavy_from).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, low, heavy_from).select(F.col("v").alias("a"), "u", "m")
        links = shrunk(small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
