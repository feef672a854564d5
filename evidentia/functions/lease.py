"""Leasehold factors: a dimension of whole years, and its use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years and percent through which the synthetic table runs. Fixed values.
POINTS = ((1, 3.8), (2, 7.5), (30, 60.0), (60, 80.0), (99, 96.0))
FREEHOLD = 999


def factor_rows() -> list[tuple[int, float]]:
    """Piecewise linear through ``POINTS``, 99 rows."""
    out = []
    for (a, x), (b, y) in zip(POINTS, POINTS[1:], strict=False):
        out += [(n, (x + (y - x) * (n - a) / (b - a)) / 100) for n in range(a, b)]
    return [*out, (99, 0.96)]


def factor_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(factor_rows(), "years int, factor double")


FACTOR_SQL = "factors AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {f!r}::DOUBLE)" for n, f in factor_rows()) + ") f(years, factor))"


def with_factor(df: DataFrame, years: str, name: str) -> DataFrame:
    """Adds the factor of ``years``: 1 for unknown and freehold, the table to 99, then linear to 100 % at 999."""
    table = F.broadcast(factor_table(df.sparkSession).withColumnsRenamed({"years": "_y", "factor": "_f"}))  # 99 rows
    n = F.bround(F.col(years), 0).cast("int")
    joined = df.withColumn("_n", n).join(table, F.col("_n") == F.col("_y"), "left")
    open_ = F.col("_n").isNull() | (F.col("_n") <= 0) | (F.col("_n") >= FREEHOLD)
    value = F.when(open_, 1.0).when(F.col("_n") > 99, (96.0 + (F.col("_n") - 99) * 4.0 / 900) / 100).otherwise(F.col("_f"))
    return joined.withColumn(name, value).drop("_n", "_y", "_f")


def factor_sql(years: str) -> str:
    n = f"CAST(round_even({years}, 0) AS INTEGER)"
    return f"CASE WHEN {years} IS NULL OR {n} <= 0 OR {n} >= 999 THEN 1.0 WHEN {n} > 99 THEN (96.0 + ({n} - 99) * 4.0 / 900)::DOUBLE / 100 ELSE (SELECT factor FROM factors WHERE factors.years = {n}) END::DOUBLE"


def literal_factor(years: Column) -> Column:
    """The same without a join, for a table of 99 literals."""
    n = F.bround(years, 0).cast("int")
    table = F.array(*[F.lit(f) for _, f in factor_rows()])
    return F.when(n.isNull() | (n <= 0) | (n >= FREEHOLD), 1.0).when(n > 99, (96.0 + (n - 99) * 4.0 / 900) / 100).otherwise(F.get(table, n - 1))
