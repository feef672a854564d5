"""Exact top-k by distributed histogram selection.

Vectors become integers, floor(256 x), and are scored by inner product. Every
round scores all tiles and counts, for each query, the scores of its current
interval in ``BINS`` bins; summed over all tiles, the counts tell the bin that
holds the k-th score, which is the next interval. When bins have the width of
one score, the k-th value is known; a last pass keeps the scores above it and,
among those equal to it, as many as are missing by smallest vec_id. A tile
counts only bins from its own k-th score upwards: the k-th score of all is no
lower, so nothing below matters.

Blocks hold components in one or two bytes where they fit, so that what a tile
needs of the vectors is small in every round. Scores are exact: products are
taken in single or double precision where the norms bound them below 2**24 or
2**52, in Python integers otherwise (and beyond the range of long they stop at
its ends).

Defined cases: vectors that are null, empty or hold null or non-finite
components, and rows without vec_id, take no part; any finite component will do;
rows of one vec_id are one vector (the smallest); vectors of different lengths
are no candidates of each other; a query with fewer candidates than k gets them
all; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import scratch
from evidentia.llm.blocks import Tiles, finite, largest, unpack

K = 5
SCALE = 256
#: Bins of a round, a power of two.
BINS = 4096
STEP = 512
LOWEST = -(1 << 63)


def whole(x: float) -> int:
    """floor(SCALE * x) for any finite x."""
    return math.floor(SCALE * x) if abs(x) < 2.0**1000 else SCALE * int(x)


def narrowest(top: int):
    """The smallest type of components up to ``top``; beyond two bytes, vectors travel as they are."""
    return np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.float64


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, as int64; integers, or doubles still to be scaled."""
    if a.dtype != np.float64:
        a32, b32 = a.astype(np.float32), b.astype(np.float32)
        if _norm(a32) * _norm(b32) < 2**24:
            return (a32 @ b32.T).astype(np.int64)
        a64, b64 = a.astype(np.float64), b.astype(np.float64)  # two bytes a component: exact up to half a million components
        return (a64 @ b64.T).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        x, y = np.floor(SCALE * a), np.floor(SCALE * b)
        big_x, big_y = (~(np.sqrt((m * m).sum(axis=1)) < 2**26) for m in (x, y))
    x[big_x], y[big_y] = 0, 0
    out = (x @ y.T).astype(np.int64)
    exact = lambda m: np.array([[whole(c) for c in row] for row in m.tolist()], dtype=object)
    clip = lambda m: np.array([[min(max(c, LOWEST + 1), -LOWEST - 1) for c in row] for row in m], np.int64)
    if big_x.any():
        out[big_x] = clip(exact(a[big_x]) @ exact(b).T)
    if big_y.any():
        out[:, big_y] = clip(exact(a) @ exact(b[big_y]).T)
    return out


def _norm(m: np.ndarray) -> float:
    return float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max()) if len(m) else 0.0


def _scored(queries: pd.DataFrame, candidates: pd.DataFrame, dtype):
    """Of every step of queries with a state and block of candidates: query ids, their states, candidate ids, scores (own: LOWEST)."""
    blocks = [(c.dim, *unpack(c, dtype)[:2]) for c in candidates.itertuples()]
    for q in queries.itertuples():
        ids, rows, _ = unpack(q, dtype)
        at = {i: n for n, i in enumerate(ids.tolist())}
        states = np.array([(at[s["query_id"]], s["lo"], s["hi"], s["need"], s["exact"]) for s in q.states], np.int64)
        for n in range(0, len(states), STEP):
            state = states[n : n + STEP]
            mine = ids[state[:, 0]]
            for dim, c_ids, c_rows in blocks:
                if dim == q.dim:
                    scores = products(rows[state[:, 0]], c_rows)
                    scores[mine[:, None] == c_ids[None, :]] = LOWEST
                    yield mine, state[:, 1:], c_ids, scores


def _count(k: int, shift: int, dtype):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        for ids, state, _, scores in _scored(queries, candidates, dtype):
            lo, hi, need = state[:, 0:1], state[:, 1:2], state[:, 2]
            # differences wrap around as unsigned numbers do
            bins = ((scores.view(np.uint64) - lo.astype(np.int64).view(np.uint64)) >> np.uint64(shift)).astype(np.int64)
            bins[(scores < lo) | (scores > hi) | (scores == LOWEST)] = -1
            least = np.zeros(len(ids), np.int64)
            if bins.shape[1] > k:
                top = np.partition(bins, range(bins.shape[1] - k, bins.shape[1]), axis=1)
                least = np.maximum(top[np.arange(len(ids)), bins.shape[1] - need], 0)
            r, c = np.nonzero(bins >= least[:, None])
            key, n = np.unique(r * BINS + bins[r, c], return_counts=True)
            row, bin_ = key // BINS, key % BINS
            edge = (lo[row, 0].view(np.uint64) + (bin_.astype(np.uint64) << np.uint64(shift))).view(np.int64)
            found.append((ids[row], edge, n))
        return _frame(found, ("query_id", "edge", "n"))

    return run


def _select(dtype):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found = []
        for ids, state, c_ids, scores in _scored(queries, candidates, dtype):
            lo, hi, need, exact = state.T
            r, c = np.nonzero((scores > np.where(exact == 1, hi, LOWEST)[:, None]) & (scores != LOWEST))
            found.append((ids[r], c_ids[c], scores[r, c]))
            r, c = np.nonzero((scores == lo[:, None]) & (exact == 1)[:, None])
            order = np.lexsort((c_ids[c], r))
            r, c = r[order], c[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            r, c = r[nth < need[r]], c[nth < need[r]]
            found.append((ids[r], c_ids[c], scores[r, c]))
        return _frame(found, ("query_id", "vec_id", "score"))

    return run


def _frame(found: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pd.DataFrame:
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [[]] * len(names)
    return pd.DataFrame(dict(zip(names, columns, strict=True))).astype("int64")


def top_scores(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of every query; ``is_query`` looks at vec_id."""
    rows = scratch.stage(finite(vectors, nonzero=False), "vectors")
    top = whole(largest(rows)) + 1
    dtype = narrowest(top)
    tiles = Tiles(rows, is_query, lambda m: (m if dtype is np.float64 else np.floor(SCALE * m).astype(dtype), np.empty((len(m), 0))))
    power = min(63, (top * top * (rows.agg(F.max(F.size("v"))).first()[0] or 1)).bit_length())  # all scores are below 2**power

    def named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for q in part.itertuples():
                yield pd.DataFrame({"query_id": np.frombuffer(q.ids, np.int64), "g": q.part, "nth": q.nth})

    number = lambda x: F.lit(x).cast("long")
    ids = tiles.queries.mapInPandas(named, "query_id long, g int, nth int")
    states = ids.select("g", "nth", "query_id", number(-(1 << power)).alias("lo"), number((1 << power) - 1).alias("hi"), number(k).alias("need"), F.lit(0).alias("exact"))
    asked = scratch.stage(states, "states")
    done, shift, bits = None, power + 1, BINS.bit_length() - 1

    def by_block(states: DataFrame) -> DataFrame:
        return states.groupBy("g", "nth").agg(F.collect_list(F.struct("query_id", "lo", "hi", "need", "exact")).alias("states"))  # a block of queries at most

    while shift:
        shift = max(0, shift - bits)
        counts = tiles.run(_count(k, shift, dtype), "query_id long, edge long, n long", by_block(asked))
        counts = counts.groupBy("query_id", "edge").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("edge")).rowsBetween(Window.unboundedPreceding, 0)
        joined = counts.join(asked, "query_id").withColumn("cum", F.sum("n").over(down))
        hit = joined.where("cum >= need AND cum - n < need")
        narrowed = scratch.stage(
            hit.select("g", "nth", "query_id", F.col("edge").alias("lo"), (F.col("edge") + ((1 << shift) - 1)).alias("hi"), (F.col("need") - F.col("cum") + F.col("n")).alias("need"), F.lit(int(shift == 0)).alias("exact")), "states"
        )
        if done is None:  # without a hit in the first round a query has fewer candidates than k: it takes them all
            done = asked.join(narrowed, "query_id", "left_anti")
        asked = narrowed
    found = tiles.run(_select(dtype), "query_id long, vec_id long, score long", by_block(asked.unionByName(done)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every vector whose vec_id is divisible by 50."""
    return top_scores(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


SQL_TOP = f"""
WITH v AS (
  SELECT vec_id, list_transform(min(CAST(embedding AS DOUBLE[])), lambda x: floor({SCALE} * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
  GROUP BY vec_id
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= {K}
"""
