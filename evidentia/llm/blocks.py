"""Vectors packed into blocks of small integers, and the tiles of query blocks by blocks of all vectors.

Rows of one vec_id are one vector (the smallest). Blocks hold vectors of one
length, in the form that ``convert`` gives them: a byte or two a component, so
that what a tile needs of many vectors is small. A tile group (g, s) holds the
query blocks of group g and the vector blocks of slice s; each side is repeated
once for every group or slice of the other. A group is ``GROUP_ROWS`` queries
whatever the table's size, and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import scratch

BLOCK_ROWS = 4096
#: From a matrix of vectors to one of small numbers and one of doubles that belong to its rows.
Convert = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Queries that meet a block of all vectors in one task.
GROUP_ROWS = 32768
SCHEMA = "part int, nth int, dim int, ids binary, data binary, aux binary"


def finite(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """One row (vec_id, v: array of double) per vec_id, without vectors that are null, empty or hold null or non-finite components, and without zero vectors if so asked."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def largest(rows: DataFrame) -> float:
    """The largest size of a component."""
    return rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0


def pack(rows: DataFrame, convert: Convert, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of ``convert``ed vectors, made partition by partition."""

    def block(nth: int, ids: list[int], vectors: list[np.ndarray]) -> pd.DataFrame:
        data, aux = convert(np.stack(vectors))
        row = {"part": TaskContext.get().partitionId(), "nth": nth, "dim": len(vectors[0]), "ids": np.array(ids, np.int64).tobytes(), "data": data.tobytes(), "aux": aux.astype(np.float64).tobytes()}
        return pd.DataFrame([row])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[int, tuple[list, list]] = {}  # by length
        nth = 0
        for part in parts:
            for i, v in zip(part["vec_id"].tolist(), part["v"], strict=True):
                ids, vectors = open_.setdefault(len(v), ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) == block_rows:
                    yield block(nth, *open_.pop(len(v)))
                    nth += 1
        for ids, vectors in open_.values():
            yield block(nth, ids, vectors)
            nth += 1

    return rows.mapInPandas(run, SCHEMA)


def unpack(block, dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the two matrices that ``convert`` made."""
    ids = np.frombuffer(block.ids, np.int64)
    return ids, np.frombuffer(block.data, dtype).reshape(len(ids), block.dim), np.frombuffer(block.aux, np.float64).reshape(len(ids), -1)


class Tiles:
    """Staged blocks of queries and of all vectors."""

    def __init__(self, rows: DataFrame, is_query: Column, convert: Convert):
        self.vectors = scratch.stage(pack(rows, convert), "blocks")
        asked = rows.where(is_query)
        self.groups = max(1, -(-asked.count() // GROUP_ROWS))
        self.queries = scratch.stage(pack(asked.repartition(self.groups, "vec_id"), convert), "queries")
        self.slices = max(1, self.vectors.count())

    def run(self, tile: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, state: DataFrame | None = None) -> DataFrame:
        """``tile`` on the blocks of every tile group; ``state`` (g, nth, ...) is joined to the query blocks."""
        tasks = min(self.groups * self.slices, 20_000)
        q = self.queries.withColumnRenamed("part", "g")
        if state is not None:
            q = q.join(state, ["g", "nth"])
        q = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(self.slices - 1))))
        c = self.vectors.withColumn("s", F.pmod(F.xxhash64("ids"), F.lit(self.slices)).cast("int")).drop("part")
        c = c.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(self.groups - 1))))
        q, c = q.repartition(tasks, "g", "s"), c.repartition(tasks, "g", "s")
        return q.groupBy("g", "s").cogroup(c.groupBy("g", "s")).applyInPandas(tile, schema)
