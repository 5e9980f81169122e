"""All registered queries: name -> (DataFrame program, the same result as SQL for DuckDB)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partmill.plans import availability, catalog, dashboard, entities, ledger, matching, orders, pricing, quality, quotations, review, streams, texts, writes

_MODULES = (availability, dashboard, catalog, orders, ledger, pricing, matching, quality, review, streams, texts, writes, entities, quotations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: pair[0] for module in _MODULES for name, pair in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: pair[1] for module in _MODULES for name, pair in module.QUERIES.items() if pair[1]}
