"""All queries of the core by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import copies, frames, inventory, labels, streams

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {"p2_found": copies.p2_found} | frames.QUERIES | inventory.QUERIES | labels.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p2_found": copies.P2_SQL} | frames.SQL | inventory.SQL | labels.SQL | streams.SQL
