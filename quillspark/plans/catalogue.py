"""All registered queries of the core library with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import assess, browse, content, corpus, experiments, facts, ranking, shelves, state, upkeep
from quillspark.plans.registry import QUERIES, SQL

MODULES = (corpus, ranking, experiments, content, upkeep, browse, state, facts, assess, shelves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
