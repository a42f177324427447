"""Training histories and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.positions import with_positions


def class_weights(labels: DataFrame, label: str, classes: int) -> DataFrame:
    """``label, n, weight``: balanced weights, all rows divided by classes and by the rows of the label."""
    n = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.lit(classes) * F.col("n"))).alias("weight"))


def early_stopping(history: DataFrame, run: str, epoch: str, score: str, patience: int) -> DataFrame:
    """``run, epoch, score, best, stale, stop, contiguous``: the best score so far, epochs since it last improved
    (strictly), whether patience is used up, and whether epochs have counted up from 1 without a gap."""
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    h = history.withColumn("__seen", F.max(score).over(before)).withColumn("__at", F.row_number().over(Window.partitionBy(run).orderBy(epoch)))
    h = h.withColumn("best", F.max(score).over(upto)).withColumn("__better", F.coalesce(F.col(score) > F.col("__seen"), F.col("__seen").isNull()))
    h = h.withColumn("stale", F.col("__at") - F.max(F.when(F.col("__better"), F.col("__at"))).over(upto))
    ok = F.min((F.col(epoch) == F.col("__at")).cast("int")).over(upto) == 1
    return h.select(run, epoch, score, "best", "stale", (F.col("stale") >= patience).alias("stop"), ok.alias("contiguous"))


def systematic_sample(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """Every k-th row in order, k so that about ``count`` rows come out, and no more than ``count``.

    Rows get their positions in parallel: those of each stretch of the order are counted first, so that the whole
    table is never sorted in one task.
    """
    n = df.count()
    step = max(1, n // count)
    at = with_positions(df, order, "__at")
    return at.where((F.col("__at") % step == 0) & (F.col("__at") < step * count)).drop("__at")
