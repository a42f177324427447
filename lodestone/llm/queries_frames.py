"""Problem 4: the best detections of every frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.topn import top_n
from lodestone.operators.rows import current_rows


def valid_score(s: Column) -> Column:
    return s.isNotNull() & ~F.isnan(s) & s.between(0.0, 1.0)


def best_detections(frames: DataFrame, n: int) -> DataFrame:
    """``path, score, anchor``: the n best current detections of every path.

    A batch (path, batch_no) is replaced as a whole by its latest delivery. Of one batch no more than its n best can
    be among the n best of its path, so only these travel.
    """
    pairs = F.transform(
        F.filter(F.arrays_zip(F.col("detections.score").alias("s"), F.col("detections.anchor").alias("a")), lambda d: valid_score(d["s"]) & d["a"].isNotNull()),
        lambda d: F.struct((0.0 - d["s"]).alias("s"), d["a"].alias("a")),
    )
    batches = frames.where("path is not null").select("path", "batch_no", "arrived_at", F.slice(F.array_sort(F.array_distinct(pairs)), 1, n).alias("best"))
    now = current_rows(batches, ["path", "batch_no"], "arrived_at", ["best"])
    items = now.select(F.col("path").alias("group"), F.explode("best").alias("d")).select("group", (0.0 - F.col("d.s")).alias("score"), F.col("d.a").alias("tie"))
    return top_n(items, n).select(F.col("group").alias("path"), "score", F.col("tie").cast("int").alias("anchor"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_detections(spark.read.parquet(f"{sf_dir}/frame_prediction.parquet"), 5).select("path", "anchor")


P4_SQL = """
with current_batch as (
  select path, batch_no, detections from frame_prediction where path is not null
  qualify row_number() over (partition by path, batch_no order by arrived_at desc) = 1),
detection as (select path, unnest(detections) as d from current_batch),
ranked as (
  select path, d.anchor as anchor, row_number() over (partition by path order by d.score desc, d.anchor) as rank
  from (select distinct path, d from detection) where d.score >= 0 and d.score <= 1 and not isnan(d.score))
select path, anchor from ranked where rank <= 5
"""
