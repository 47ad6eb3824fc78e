"""All queries of the core with their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    from chainsieve.plans import evaluation, extra, more, records, reports, selection, textual

    return [selection, evaluation, textual, more, extra, records, reports]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in _modules():
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = query
    return found


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _modules() for name, text in module.SQL.items()}


def flagship(spark: SparkSession, root: str) -> DataFrame:
    from chainsieve.plans import selection

    return selection.flagship(spark, root)
