"""Queries over sessions of live frames and over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.detections import suppress
from lodestone.functions.logits import softmax, valid_logits
from lodestone.plans.frames import frames
from lodestone.streaming.smoothing import smoothed
from lodestone.streaming.tracker import latest_of, track_table

#: Milliseconds between two frames of a session.
TICK = 250.0


def live_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of sessions (``.../sesi-N/frame_K.png``), after suppression, with class probabilities where there are logits."""
    f = frames(spark, sf_dir, least=0.25).where(F.col("path").rlike(r"sesi-\d+/frame_\d+"))
    number = F.regexp_extract("path", r"frame_(\d+)", 1).cast("bigint")
    kept = F.transform(
        suppress(F.col("detections"), F.lit(0.25), F.lit(0.45)),
        lambda d: F.struct(d["box"].alias("box"), d["score"].alias("score"), F.when(valid_logits(d["logits"]), softmax(d["logits"])).alias("scores")),
    )
    return f.select(F.regexp_extract("path", r"(sesi-\d+)/", 1).alias("session"), number.alias("frame"), (number * TICK).alias("ts"), kept.alias("detections"))


def track_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_table(live_frames(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("confidence", "detector_confidence")})


def conflate_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour"), "ts", "event_id", "value")
    return latest_of(e, ["user_id", "hour"], ["ts", "event_id"]).select("user_id", "hour", "event_id", "value", "skipped")


def smoothed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = smoothed(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], "value")
    return s.select("user_id", "n", F.round("smoothed", 6).alias("smoothed"))


QUERIES = {"track_objects": track_objects, "conflate_latest": conflate_latest, "smoothed_values": smoothed_values}
SQL = {
    "conflate_latest": """select user_id, strftime(ts, '%Y-%m-%d %H') as hour, arg_max(event_id, {'a': ts, 'b': event_id}) as event_id,
  arg_max(value, {'a': ts, 'b': event_id}) as value, count(*) - 1 as skipped from events group by 1, 2""",
    "smoothed_values": """select user_id, count(*) as n,
  round(list_reduce(list(value::double order by ts, event_id), lambda a, x: 0.35::double * a + 0.65::double * x), 6) as smoothed
from events where user_id is not null and value is not null group by user_id""",
}
