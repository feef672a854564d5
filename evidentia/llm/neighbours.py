"""Nearest neighbours by a block matrix join with int8 product tiles.

Equal vectors are one class, known by its smallest vec_id; classes are searched,
and a class's ``k + 1`` smallest members are put in its place at the end, so that
a vector that stands in many rows is met once. Classes are packed into blocks
(see ``blocks``) of int8 components, each vector with its own scale, its norm and
the norm of its residual. In a tile, the product of two int8 matrices, exact in
float32 arithmetic, gives every squared distance with an error bound from the
norms of the residuals. A pair leaves the tile if its lower bound is no more than
the smallest ``k + 1`` upper bounds of its query there, and survives if that holds
for the bounds of all tiles. Only survivors fetch their original vectors; they
are computed again in double precision and merged by heaps, so the result is
exact.

Bounds are taken on components divided by a power of two near the table's
largest one, and distances whose squares leave the range of doubles are computed
on scaled differences, so any finite vectors will do.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without vec_id, take no part; rows of one vec_id are one
vector (the smallest); vectors of different lengths are no candidates of each
other; equal distances go by vec_id; a distance beyond the range of doubles is
infinite; an empty table gives an empty result; further columns are not looked
at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm import scratch
from evidentia.llm.blocks import Tiles, finite, largest, unpack

K = 10
#: Queries and components worked on at once; 127 * 127 * 1024 is exact in float32.
STEP, EXACT_DIMS = 512, 1024


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 matrix; and for each row its scale, its squared norm, and the norms of its int8 part and of the residual."""
    scale = np.abs(v).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.clip(np.rint(v / scale[:, None]), -127, 127)
    rest = v - q * scale[:, None]
    return q.astype(np.int8), np.stack([scale, (v * v).sum(axis=1), scale * np.sqrt((q * q).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))], axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, at : at + EXACT_DIMS].astype(np.float32) @ b[:, at : at + EXACT_DIMS].astype(np.float32).T
    return out


def bounds(a8: np.ndarray, a: np.ndarray, b8: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between the rows of two quantised matrices."""
    norms = a[:, 1][:, None] + b[:, 1][None, :]
    near = norms - 2 * (a[:, 0][:, None] * b[:, 0][None, :]) * int8_products(a8, b8)
    error = a[:, 3][:, None] * (b[:, 2] + b[:, 3])[None, :] + a[:, 2][:, None] * b[:, 3][None, :]
    error = 2 * error + 1e-9 * norms + 1e-290  # rounding, and squares that underflow
    return near - error, near + error


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a to the rows of b, summed in order of the components."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            total += d * d
        out = np.sqrt(total)
        odd = np.flatnonzero(~(total < np.inf) | (total < 1e-280))  # squares out of range: scale the differences
        if len(odd):
            half = a[odd] / 2 - b[odd] / 2
            top = np.abs(half).max(axis=1)
            unit = half / np.where(top > 0, top, 1.0)[:, None]
            out[odd] = 2 * (top * np.sqrt((unit * unit).sum(axis=1)))
    return out


def _tile(k: int):
    def run(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        kept = []
        blocks = [(c.dim, *unpack(c, np.int8)) for c in candidates.itertuples()]
        for q in queries.itertuples():
            all_ids, all_rows, all_aux = unpack(q, np.int8)
            for at in range(0, len(all_ids), STEP):
                ids, rows, aux = (x[at : at + STEP] for x in (all_ids, all_rows, all_aux))
                limit = np.full(len(ids), np.inf)
                found = []
                for dim, c_ids, c_rows, c_aux in blocks:
                    if dim != q.dim:
                        continue
                    lower, upper = bounds(rows, aux, c_rows, c_aux)
                    if len(c_ids) > k:
                        limit = np.minimum(limit, np.partition(upper, k, axis=1)[:, k])
                    r, c = np.nonzero(lower <= limit[:, None])
                    found.append((r, c_ids[c], lower[r, c], upper[r, c]))
                for r, c, low, high in found:  # the limit may have fallen since
                    some = low <= limit[r]
                    kept.append((ids[r[some]], c[some], low[some], high[some]))
        columns = [np.concatenate(x) for x in zip(*kept, strict=True)] if kept else [[]] * 4
        return pd.DataFrame(dict(zip(("q", "c", "low", "high"), columns, strict=True))).astype({"q": "int64", "c": "int64", "low": "float64", "high": "float64"})

    return run


def _merge(k: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[float, int]]] = {}  # (-distance, -id): the worst on top
        for part in parts:
            if not len(part):
                continue
            for dim in np.unique(sizes := part["q_v"].map(len).to_numpy()):
                some = part[sizes == dim]
                exact = distances(np.stack(some["q_v"]), np.stack(some["c_v"]))
                for q, c, d in zip(some["q"].tolist(), some["c"].tolist(), exact.tolist(), strict=True):
                    heap = heaps.setdefault(q, [])
                    if len(heap) <= k:
                        heapq.heappush(heap, (-d, -c))
                    elif (-d, -c) > heap[0]:
                        heapq.heapreplace(heap, (-d, -c))
        found = [(q, -c, -d) for q, heap in heaps.items() for d, c in heap]
        yield pd.DataFrame(found, columns=["q", "c", "score"]).astype({"q": "int64", "c": "int64", "score": "float64"})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other vectors of every query; ``is_query`` looks at vec_id."""
    rows = scratch.stage(finite(vectors, nonzero=True), "vectors")
    classes = scratch.stage(rows.groupBy("v").agg(F.min("vec_id").alias("class")), "classes")
    members = scratch.stage(rows.join(classes, "v").select("vec_id", "class"), "members")
    asked = members.where(is_query).select(F.col("vec_id").alias("query_id"), "class")
    scale = 2.0 ** -np.frexp(largest(rows))[1]
    searched = classes.select(F.col("class").alias("vec_id"), "v").join(asked.select(F.col("class").alias("vec_id")).distinct().withColumn("asked", F.lit(True)), "vec_id", "left")
    tiles = Tiles(scratch.stage(searched, "searched"), F.col("asked"), lambda m: quantise(m * scale))
    met = scratch.stage(tiles.run(_tile(k), "q long, c long, low double, high double"), "met")
    limits = met.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("high"))).where(F.col("nth") <= k + 1)
    limits = limits.groupBy("q").agg(F.when(F.count("*") > k, F.max("high")).otherwise(F.lit(float("inf"))).alias("limit"))
    left = met.join(limits, "q").where("low <= limit").select("q", "c")
    exact = left.join(classes.select(F.col("class").alias("c"), F.col("v").alias("c_v")), "c").join(classes.select(F.col("class").alias("q"), F.col("v").alias("q_v")), "q")
    found = exact.mapInPandas(_merge(k), "q long, c long, score double")
    order = Window.partitionBy("q").orderBy("score", "c")
    found = scratch.stage(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1), "found")
    # members in place of classes: of each, no more than k besides the query can count
    first = members.withColumn("nth", F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))).where(F.col("nth") <= k + 1).select(F.col("class").alias("c"), "vec_id")
    pairs = asked.join(found.select(F.col("q").alias("class"), "c", "score"), "class").join(first, "c").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose vec_id is divisible by 100."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


SQL_NEAREST = """
WITH v AS (
  SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY vec_id
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, x: a + x)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY rank <= 10
"""
