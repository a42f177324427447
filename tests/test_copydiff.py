"""Comparison of two copies, against a plain comparison of dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import same_path, same_path_value, same_text_value
from lodestone.operators.copydiff import checksum_matrix, compare_copies, unequal_cells

SCHEMA = "k string, a string, b bigint, ts bigint"


def plain(left, right, fields=("a", "b")):
    def now(rows):
        best = {}
        for k, a, b, ts in rows:
            if k is None:
                continue
            order = (ts is not None, ts or 0, a is not None, a or "", b is not None, b or 0)
            if k not in best or order > best[k][0]:
                best[k] = (order, {"a": a, "b": b})
        return {k: v[1] for k, v in best.items()}

    x, y = now(left), now(right)
    out = {(k, "missing_in_left") for k in y.keys() - x.keys()} | {(k, "missing_in_right") for k in x.keys() - y.keys()}
    return out | {(k, f) for k in x.keys() & y.keys() for f in fields if x[k][f] != y[k][f]}


def compare(spark, left, right, **options):
    frames = (spark.createDataFrame(rows, SCHEMA) for rows in (left, right))
    got = compare_copies(*frames, "k", ["a", "b"], left_order="ts", right_order="ts", **options).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("buckets", [None, 1, 7, 1000])
def test_random_copies(spark, buckets):
    r = random.Random(5)
    left = [(f"k{i}", r.choice(["x", "", None]), r.choice([1, None, 2]), r.randint(0, 3)) for i in range(300)]
    right = [(k, r.choice(["x", a]), b, ts) for k, a, b, ts in left if r.random() > 0.1] + [("new", None, None, 1)]
    left += left[:40] + [(k, "late", b, 9) for k, _, b, _ in left[:5]]
    assert compare(spark, left, right, buckets=buckets) == plain(left, right)


def test_equal_copies_and_order_of_rows(spark):
    rows = [(f"k{i}", str(i), i, 0) for i in range(50)]
    assert compare(spark, rows, rows[::-1] + rows[:9]) == set()


def test_null_is_not_empty_and_equals_null(spark):
    assert compare(spark, [("k", None, None, 1)], [("k", "", None, 1)]) == {("k", "a")}
    assert compare(spark, [(None, "x", 1, 1)], [("k", "x", 1, None)]) == {("k", "missing_in_left")}


def test_empty_sides(spark):
    assert compare(spark, [], []) == set()
    assert compare(spark, [("k", "v", 1, 1)], []) == {("k", "missing_in_right")}
    assert compare(spark, [], [("k", "v", 1, 1)]) == {("k", "missing_in_left")}


def test_hot_key_with_ties_and_very_long_value(spark):
    left = [("hot", "x" * 200_000, i % 7, 5) for i in range(3000)] + [("cold", "y", 1, 1)]
    right = [("hot", "x" * 200_000, 6, 1), ("cold", "y", 1, 1)]
    assert compare(spark, left, right) == set()


def test_extra_and_clashing_columns(spark):
    left = spark.createDataFrame([("k", "v", 1, "l", 3)], "k string, a string, ts int, bucket string, columns int")
    right = spark.createDataFrame([("k", "w", 1, 7, "r")], "k string, a string, ts int, here int, difference string")
    got = compare_copies(left, right, "k", ["a"], left_order="ts", right_order="ts", names={"a": "the a"}).collect()
    assert [tuple(r) for r in got] == [("k", "the a")]


def test_matrix_names_only_the_unequal_column(spark):
    left = spark.createDataFrame([(f"k{i}", "x", i) for i in range(100)], "k string, a string, b int")
    right = spark.createDataFrame([(f"k{i}", "x", i + (i == 50)) for i in range(100)], "k string, a string, b int")
    cells = unequal_cells(left, right, "k", ["a", "b"], 10).collect()
    assert [r["columns"] for r in cells] == [[2]]  # the second field
    assert checksum_matrix(left, "k", ["a", "b"], 10).agg({"n": "sum"}).first()[0] == 100


def test_more_fields_than_bits_of_a_word(spark):
    fields = [f"c{i}" for i in range(80)]
    left = spark.createDataFrame([(k, 1, *[f"{k}{i}" for i in range(80)]) for k in "abcdef"], ["k", "ts", *fields])
    right = left.withColumn("c79", F.when(F.col("k") == "c", F.lit("other")).otherwise(F.col("c79"))).withColumn("c0", F.when(F.col("k") != "e", F.col("c0")))
    got = compare_copies(left, right, "k", fields, left_order="ts", right_order="ts").collect()
    assert {tuple(r) for r in got} == {("c", "c79"), ("e", "c0")}


def test_a_superseded_row_does_not_hide_in_equal_sums(spark):
    """Both sides hold the same rows, but another one is the current one."""
    left, right = [("k", "x", 1, 1), ("k", "y", 2, 2)], [("k", "x", 1, 2), ("k", "y", 2, 1)]
    assert compare(spark, left, right) == {("k", "a"), ("k", "b")}
    assert compare(spark, left, left[::-1]) == set()


def test_swapped_columns_differ(spark):
    rows = [(f"k{i}", i, i + 1, 1) for i in range(30)]
    left = spark.createDataFrame(rows, "k string, a int, b int, ts int")
    right = left.select("k", F.col("b").alias("a"), F.col("a").alias("b"), "ts")
    assert compare_copies(left, right, "k", ["a", "b"], left_order="ts", right_order="ts").count() == 60


def test_same_text_and_path(spark):
    assert same_text_value("  Düsun　") == same_text_value("DÜSUN") == "düsun"
    assert same_text_value(" \t") is None and same_text_value(None) is None
    assert same_path_value("A\\b＼c") == "a/b/c"
    rows = spark.createDataFrame([("A\\B ",), (None,), ("",)], "p string").select(same_path("p").alias("p")).collect()
    assert [r.p for r in rows] == ["a/b", None, None]
