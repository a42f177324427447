"""Current rows and lookups of hot keys."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestone import scratch
from lodestone.operators import rows as R


def test_current_rows_takes_latest_then_greatest(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 2), (2, None, None), (None, "n", 1), (None, "m", 3)], "k int, v string, ts int")
    got = {r.k: r.v for r in R.current_rows(df, ["k"], "ts", ["v"]).collect()}
    assert got == {1: "c", 2: None, None: "m"}


def test_lookup_join_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(R, "SMALL", 20)
    big = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "k bigint, id bigint")
    )
    table = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, 14)], "k bigint, v bigint"))
    assert R.hot_keys(big, "k", 3001) == [7]
    inner, left = R.lookup_join(big, table, "k"), R.lookup_join(big, table, "k", "left")
    assert inner.count() == 2500 and inner.where("v <> 2 * k").count() == 0
    assert left.count() == 3001 and left.where("v is null").count() == 501


def test_scratch_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda s: f"file://{tmp_path}")
    s = scratch.Scratch(spark, "t")
    df = s.write(spark.range(10), "a")
    assert df.count() == 10 and s.files("a") and s.write(df.where("false"), "b").count() == 0
    s.drop("b", "never written")
    assert [p.name for p in next(tmp_path.iterdir()).iterdir()] == ["a"]
    s.clear()
    assert not list(tmp_path.iterdir())


def test_shared_folder():
    def session(at, master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: at), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))

    assert scratch.shared_folder(session("hdfs://n/x/", "yarn")) == "hdfs://n/x"
    with pytest.raises(ValueError, match="share"):
        scratch.shared_folder(session(None, "yarn"))
    own = scratch.shared_folder(session(None, "local[2]"))
    assert own == scratch.shared_folder(session(None, "local[2]"))
