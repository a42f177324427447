"""Tracking, conflation, the gate and smoothing."""

import random

import numpy as np

from lodestone.streaming import smoothing
from lodestone.streaming.tracker import FRAMES, InFlight, Objects, TrackerOptions, assign, overlaps, latest_of, track_stream, track_table, write_latest

SURE = [0.91 if i == 2 else 0.01 for i in range(10)]
OTHER = [0.91 if i == 5 else 0.01 for i in range(10)]
A, B = [0.1, 0.1, 0.3, 0.3], [0.6, 0.6, 0.3, 0.3]


def follow(updates, options=TrackerOptions()):
    t, out = Objects(), []
    for frame, (ts, ds) in enumerate(updates):
        out.append(t.take(frame, ts, ds, options))
        t = Objects.load(t.dump())  # state survives being written
    return out


def test_confirmation_and_smoothing():
    rows = follow([(0, [(A, 0.9, SURE)]), (250, [(A, 0.9, SURE)]), (500, []), (750, [(A, 0.9, OTHER)])])
    assert [(r[0]["track_id"], r[0]["status"], r[0]["class_id"]) for r in (rows[0], rows[1])] == [(1, "analyzing", None), (1, "recognized", 2)]
    # The empty frame takes the objects with it; what comes next is new.
    assert rows[2] == [] and rows[3][0]["track_id"] == 2 and rows[3][0]["status"] == "analyzing"
    mixed = follow([(0, [(A, 0.9, SURE)]), (250, [(A, 0.9, SURE)]), (500, [(A, 0.9, OTHER)])])[2][0]
    assert mixed["status"] == "uncertain" and mixed["track_id"] == 1


def test_a_planted_session():
    """Two objects, each with its own class, shown at 0, 250, 750 ms and gone at 500 ms: answers worked out by hand."""
    scores = [[0.91 if i == c else 0.01 for i in range(10)] for c in (0, 3)]
    left, right = [0.1, 0.1, 0.2, 0.2], [0.6, 0.6, 0.2, 0.2]
    both = [(left, 0.9, scores[0]), (right, 0.8, scores[1])]
    shown = [[(r["track_id"], r["class_id"], r["status"]) for r in rows] for rows in follow([(0, both), (250, both), (500, []), (750, both)])]
    assert shown == [
        [(1, None, "analyzing"), (2, None, "analyzing")],
        [(1, 0, "recognized"), (2, 3, "recognized")],
        [],
        [(3, None, "analyzing"), (4, None, "analyzing")],
    ]
    # A changed class needs 0.65 * 0.91 + 0.35 * 0.01 = 0.595, below 0.65: uncertain once, then accepted, then recognised.
    turned = [(left, 0.9, scores[1])]
    steps = follow([(0, both[:1]), (250, both[:1]), (500, turned), (750, turned), (1000, turned)])
    assert [r[0]["status"] for r in steps] == ["analyzing", "recognized", "uncertain", "analyzing", "recognized"]
    assert steps[4][0]["class_id"] == 3 and abs(steps[4][0]["confidence"] - (0.91 - 0.9 * 0.35**3)) < 1e-12


def test_expiry_and_overflow():
    assert follow([(0, [(A, 0.9, None)]), (1000, [(A, 0.9, None)])])[1][0]["track_id"] == 1
    assert follow([(0, [(A, 0.9, None)]), (1001, [(A, 0.9, None)])])[1][0]["track_id"] == 2
    many = follow([(0, [([0.1 * i, 0.0, 0.05, 0.05], i / 10, None) for i in range(7)])])[0]
    assert len(many) == 5 and all(r["overflow"] for r in many) and many[0]["detector_confidence"] == 0.6


def test_late_frames_come_out_as_late():
    rows = follow([(500, [(A, 0.9, SURE)]), (500, [(A, 0.9, SURE)]), (100, [(A, 0.7, SURE), (B, 0.6, None)]), (200, []), (750, [(A, 0.9, SURE)])])
    assert [r["status"] for r in rows[1]] == ["recognized"]  # another frame of the same time counts
    assert [(r["track_id"], r["status"], r["detector_confidence"]) for r in rows[2]] == [(None, "late", 0.7), (None, "late", 0.6)]
    assert [(r["x"], r["status"]) for r in rows[3]] == [(None, "late")]
    assert rows[4][0]["track_id"] == 1 and rows[4][0]["status"] == "recognized"
    again = Objects()
    assert len(again.take(1, 0.0, [(A, 0.9, None)], TrackerOptions())) == 1 and again.take(1, 0.0, [(A, 0.9, None)], TrackerOptions()) == []


def test_ambiguity_and_continuity():
    # Two boxes that fit the object about as well: neither inherits it.
    near = [0.12, 0.1, 0.3, 0.3]
    assert {r["track_id"] for r in follow([(0, [(A, 0.9, None)]), (250, [(A, 0.9, None), (near, 0.8, None)])])[1]} == {2, 3}
    # A known object comes before a better score.
    kept = follow([(0, [(A, 0.9, None)]), (250, [(B, 0.99, None), (A, 0.3, None)])], TrackerOptions(max_objects=1))[1]
    assert [r["track_id"] for r in kept] == [1]


def test_assignment_on_the_matrix():
    assert assign(np.zeros((0, 3))).tolist() == [] and assign(np.zeros((2, 0))).tolist() == [-1, -1]
    assert assign(np.array([[0.9, 0.1], [0.1, 0.8]])).tolist() == [0, 1]
    assert assign(np.array([[0.39, 0.0]])).tolist() == [-1]
    assert assign(np.array([[0.9, 0.8]])).tolist() == [-1]  # the next object is within the lead
    assert assign(np.array([[0.9], [0.75]])).tolist() == [-1, -1]  # the other box is, and the better one lacks the lead
    assert assign(np.array([[0.9], [0.74]])).tolist() == [0, -1]
    # The first takes its object, so that the second no longer hesitates between two.
    assert assign(np.array([[0.9, 0.0], [0.7, 0.6]])).tolist() == [0, 1]
    assert overlaps(np.array([[0.0, 0, 1, 1]]), np.array([[0.0, 0, 1, 1], [0.5, 0, 1, 1], [2, 2, 1, 1], [0, 0, 0, 0]])).tolist() == [[1.0, 1 / 3, 0.0, 0.0]]


def stream_rows(seed, sessions=4, frames=30):
    r = random.Random(seed)
    out = []
    for s in range(sessions):
        for f in range(frames):
            ds = [({"x": round(r.choice([0.1, 0.5]) + r.random() * 0.05, 3), "y": 0.1, "w": 0.3, "h": 0.3}, round(r.random(), 3), r.choice([SURE, OTHER, None])) for _ in range(r.randint(0, 3))]
            out.append((f"s{s}", f, f * 250.0, ds or r.choice([[], None])))
    return out


def test_stream_equals_table(spark, tmp_path):
    rows = stream_rows(3)
    for k in range(3):  # three files, in order of time, one in each micro-batch
        part = [x for x in rows if k * 10 <= x[1] < (k + 1) * 10]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, FRAMES).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(spark.createDataFrame([], FRAMES).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = track_stream(source).writeStream.format("memory").queryName("tracked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.session, r.frame, r.track_id)
    streamed = sorted(spark.table("tracked").collect(), key=key)
    table = sorted(track_table(spark.createDataFrame(rows, FRAMES)).collect(), key=key)
    assert streamed == table and len(table) > 50


def test_table_of_dirty_frames(spark):
    b = {"x": 0.1, "y": 0.1, "w": 0.3, "h": 0.3}
    rows = [("s", 1, 0.0, [(b, 0.9, SURE)]), ("s", 1, 0.0, [(b, 0.9, SURE)]), (None, 1, 0.0, []), ("s", None, 0.0, []), ("s", 2, None, []), ("s", 3, 10.0, [(None, 0.9, SURE), (b, None, SURE), (b, 0.5, [])])]
    got = track_table(spark.createDataFrame(rows, FRAMES)).orderBy("frame").collect()
    assert [(r.frame, r.track_id, r.status) for r in got] == [(1, 1, "analyzing"), (3, 1, "uncertain")]
    assert track_table(spark.createDataFrame([], FRAMES)).count() == 0


def test_one_frame_in_flight():
    g = InFlight()
    first = g.acquire()
    assert first is not None and g.acquire() is None and g.fresh(first)
    assert g.renew() == 1 and not g.fresh(first)
    second = g.acquire()
    assert second.number == first.number + 1 and not g.release(first) and g.acquire() is None
    assert g.release(second) and not g.release(second) and g.acquire() is not None


def test_latest_wins(spark, tmp_path):
    rows = [("s", 1, "a"), ("s", 3, "c"), ("s", 2, "b"), ("t", 1, "x"), (None, 5, "n")]
    df = spark.createDataFrame(rows, "session string, frame int, v string")
    assert {tuple(r) for r in latest_of(df, ["session"], ["frame"]).collect()} == {("s", 3, "c", 2), ("t", 1, "x", 0), (None, 5, "n", 0)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = write_latest(source, ["session"], ["frame"], lambda t, n: seen.extend(t.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.session, r.v) for r in seen} == {("s", "c"), ("t", "x"), (None, "n")}


def test_smoothing_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(smoothing, "PIECE", 7)
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b"]), i, r.random()) for i in range(400)] + [("one", 0, 5.0), ("a", 999, None), (None, 1, 1.0)]
    want = {}
    for k, _, v in rows:
        if k is not None and v is not None:
            n, s = want.get(k, (0, None))
            want[k] = (n + 1, v if s is None else 0.35 * s + 0.65 * v)
    got = {x.k: (x.n, x.smoothed) for x in smoothing.smoothed(spark.createDataFrame(rows, "k string, i int, v double"), "k", ["i"], "v").collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
