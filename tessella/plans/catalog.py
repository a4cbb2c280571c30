"""All registered queries and their SQL."""

from __future__ import annotations

from . import agent_queries, history_queries, io_queries, metric_queries, retrieval_queries, source_queries, store_queries, text_queries  # noqa: F401  they register
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
