"""Top N by merging runs, against sorting."""

import random

import pytest

from lodestone.llm.queries_frames import best_detections
from lodestone.llm.topn import LoserTree, top_n

SCHEMA = "group string, score double, tie bigint, bucket string"


class Cursor:
    def __init__(self, items):
        self.items, self.key = iter(items), None
        self.move()

    def move(self):
        self.key = next(self.items, None)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randint(0, 50) for _ in range(r.randint(0, 20))) for _ in range(k)]
    cursors = [Cursor(x) for x in runs]
    tree, out = LoserTree(cursors), []
    while tree.winner >= 0 and cursors[tree.winner].key is not None:
        out.append(cursors[tree.winner].key)
        cursors[tree.winner].move()
        tree.replay()
    assert out == sorted(x for run in runs for x in run)


def plain(rows, n):
    groups = {}
    for g, s, t, _ in rows:
        if g is not None and s is not None and s == s and t is not None:
            groups.setdefault(g, set()).add((-s + 0.0, t))
    return {(g, 0.0 - s, t) for g, items in groups.items() for s, t in sorted(items)[:n]}


@pytest.mark.parametrize(("n", "parts", "buckets"), [(1, 5, 3), (5, 7, 4), (50, 2, 1)])
def test_top_n(spark, n, parts, buckets):
    r = random.Random(n)
    rows = [(r.choice(["", "a", "ä", "b b", "B"]), r.choice([0.5, 0.25, -0.0, 0.0, float("inf")]), r.randint(0, 40), "x") for _ in range(800)]
    rows += [(f"g{i % 40}", r.random(), i, "x") for i in range(400)] + rows[:100]
    rows += [(None, 1.0, 1, "x"), ("a", None, 1, "x"), ("a", float("nan"), 2, "x"), ("a", 0.1, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [tuple(x) for x in top_n(df, n, buckets=buckets).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, n)


def test_hot_group_over_many_row_groups(spark, monkeypatch):
    import lodestone.llm.topn as T

    monkeypatch.setattr(T, "ROW_GROUP_BYTES", 2000)
    rows = [("hot", (i * 37 % 5000) / 5000, i, "x") for i in range(20000)] + [("z", 0.5, 1, "x"), ("a", 0.5, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert {tuple(x) for x in top_n(df, 4, buckets=1).collect()} == plain(rows, 4)


@pytest.mark.parametrize(("fan", "parts", "buckets"), [(2, 9, 5), (3, 4, 1), (2, 5, 8)])
def test_more_runs_than_are_merged_at_once(spark, monkeypatch, fan, parts, buckets):
    import lodestone.llm.topn as T

    monkeypatch.setattr(T, "FAN", fan)
    monkeypatch.setattr(T, "ROW_GROUP_BYTES", 2000)
    r = random.Random(fan)
    rows = [(r.choice(["hot", "hot", "hot", f"g{i % 30}"]), r.choice([0.5, r.random()]), r.randint(0, 900), "x") for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = [tuple(x) for x in top_n(df, 5, buckets=buckets).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 5)


def test_nothing(spark):
    assert top_n(spark.createDataFrame([], SCHEMA), 5).count() == 0
    with pytest.raises(ValueError, match="positive"):
        top_n(spark.createDataFrame([], SCHEMA), 0)


def test_current_batches_replace_whole(spark):
    schema = "path string, batch_no int, arrived_at timestamp, detections array<struct<score:double,anchor:int>>, score string"
    from datetime import datetime

    a, b = datetime(2025, 1, 1), datetime(2025, 1, 2)
    nan = float("nan")
    rows = [
        ("p", 0, a, [(0.9, 1), (0.8, 2)], "x"), ("p", 0, b, [(0.1, 3), (None, 4), (nan, 5), (1.5, 6), (-0.1, 7), (1.0, 8)], "x"),
        ("p", 1, a, [(0.1, 0)], "x"), ("p", 1, a, [(0.1, 0)], "x"), ("q", 0, a, None, "x"), ("r", 0, a, [], "x"), (None, 0, a, [(0.5, 1)], "x"),
    ]
    got = {tuple(x) for x in best_detections(spark.createDataFrame(rows, schema), 2).collect()}
    assert got == {("p", 1.0, 8), ("p", 0.1, 0)}
