"""Positions and running sums of rows in an order over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import Scratch


def with_running(df: DataFrame, order: list[str | Column], sums: dict[str, Column | str], name: str = "position") -> DataFrame:
    """The rows with their position from 0 in an order over the whole table, and for each name in ``sums`` the sum of a
    whole-numbered column over all rows up to and including this one.

    Range partitioning puts the table into stretches of the order; each is sorted and summed by itself, and what lies
    before it, a row for each stretch, is added. So no task sees the whole table. The order should be total: rows that
    tie lie in one stretch, in any order.
    """
    scratch = Scratch(df.sparkSession, "positions")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    values = [(F.expr(c) if isinstance(c, str) else c).cast("bigint").alias(f"__v_{n}") for n, c in sums.items()]
    rows = scratch.write(ranged.select("*", *values, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__id")), "rows")
    totals = [F.coalesce(F.sum(f"__v_{n}"), F.lit(0)).alias(f"__t_{n}") for n in sums]
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__t"), F.min("__id").alias("__first"), *totals)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    before = [F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in sums]
    offsets = sizes.select("__part", "__first", F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before"), *before)
    joined = rows.join(F.broadcast(offsets), "__part")
    upto = Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0)
    running = [(F.col(f"__b_{n}") + F.coalesce(F.sum(f"__v_{n}").over(upto), F.lit(0))).alias(n) for n in sums]
    return joined.select(*df.columns, (F.col("__before") + F.col("__id") - F.col("__first")).alias(name), *running)


def with_positions(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """The rows with their position from 0 in an order over the whole table; see :func:`with_running`."""
    return with_running(df, order, {}, name)
