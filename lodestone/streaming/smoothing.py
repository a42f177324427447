"""Exponential smoothing of any number of values per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.positions import with_positions

#: Values of a key that are folded in one piece.
PIECE = 10_000


def smoothed(df: DataFrame, key: str, order: list[str], value: str, fresh: float = 0.65) -> DataFrame:
    """``key, n, smoothed``: the last of s(1) = v(1), s(k) = fresh * v(k) + (1 - fresh) * s(k - 1), in order.

    The fold is linear, so a key's values are cut into pieces, each folded by itself into a factor for what comes
    before it and an addend; the pieces, a PIECE-th of the values, are then folded. So no key is too large for a task.
    Null values are left out, null keys too. ``order`` should be total within a key.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, *order, value)
    at = with_positions(rows, [key, *order], "__at").withColumn("__piece", F.expr(f"__at div {PIECE}"))
    # A piece holds at most PIECE rows by construction.
    folded = at.groupBy(key, "__piece").agg(F.array_sort(F.collect_list(F.struct("__at", F.col(value).cast("double").alias("v")))).alias("vs"))
    step = lambda a, x: a * (1 - fresh) + x["v"] * fresh
    tail = F.aggregate(F.slice("vs", 2, PIECE), F.get("vs", F.lit(0))["v"], step)  # if the piece is the key's first
    whole = F.aggregate("vs", F.lit(0.0), step)
    parts = folded.select(key, "__piece", F.size("vs").alias("n"), tail.alias("first"), whole.alias("add"), F.pow(F.lit(1 - fresh), F.size("vs")).alias("factor"))
    w = Window.partitionBy(key).orderBy("__piece")
    parts = parts.withColumn("start", F.row_number().over(w) == 1)
    g = parts.groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("__piece", "start", "first", "add", "factor"))).alias("ps"))
    last = F.aggregate("ps", F.lit(0.0), lambda a, p: F.when(p["start"], p["first"]).otherwise(a * p["factor"] + p["add"]))
    return g.select(key, "n", last.alias("smoothed"))
