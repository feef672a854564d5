"""Registered queries over the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from evidentia.plans import register
from evidentia.plans import acquisition, briefs, review, scalars, refinement, evidence, retrieval, extraction, grids, reports, rules, sheets, streams, workflows  # noqa: F401  (they register queries)

FLAGSHIP = "q_sales_table"


def queries() -> dict[str, Callable]:
    return dict(register.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(register.SQL)
