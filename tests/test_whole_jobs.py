"""Queries do the whole job: what an earlier form of them left out."""

import hashlib
import struct
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.plans import inventory
from lodestone.sources import files

BOX = "struct<x:double,y:double,w:double,h:double>"
FRAMES = (
    "path string, group_id string, split string, batch_no int, arrived_at timestamp, "
    f"truth array<struct<box:{BOX},class_id:int,logits:array<double>>>, "
    f"detections array<struct<box:{BOX},score:double,anchor:int,logits:array<double>>>, candidate_count int"
)


def truth(*boxes, cls=0):
    return [(b, cls, [0.0] * 10) for b in boxes]


def found(*anchored):
    return [(b, 0.5, a, None) for b, a in anchored]


def frame(path, batch, hour, truth, detections, group="g", split="valid"):
    return (path, group, split, batch, datetime(2026, 1, 1, hour), truth, detections, 0)


def test_best_overlap_takes_the_truth_of_all_batches_of_a_frame(spark, tmp_path, monkeypatch):
    a, b, far = (0.0, 0.0, 0.2, 0.2), (0.5, 0.5, 0.2, 0.2), (0.8, 0.0, 0.1, 0.1)
    rows = [
        frame("p", 0, 1, truth(far), found((far, 9))),  # delivered again below
        frame("p", 0, 2, truth(a), found((a, 1), (b, 2))),
        frame("p", 1, 1, [], found((a, 3), (far, 4))),
        frame("p", 2, 1, truth(b), None),
        frame("p", None, 1, None, found((b, 5))),
        frame("none", 0, 1, None, found((a, 6))),
        frame(None, 0, 1, truth(a), found((a, 7))),
    ]
    spark.createDataFrame(rows, FRAMES).write.parquet(str(tmp_path / "frame_prediction.parquet"))
    want = {("p", 0, 1): 1.0, ("p", 0, 2): 1.0, ("p", 1, 3): 1.0, ("p", 1, 4): 0.0, ("p", None, 5): 1.0}
    for hot in ([], ["p"]):
        monkeypatch.setattr("lodestone.operators.rows.hot_keys", lambda *_, hot=hot: hot)
        got = [tuple(r) for r in inventory.best_overlap(spark, str(tmp_path)).collect()]
        assert len(got) == len(want) and {r[:3]: r[3] for r in got} == want


def test_prediction_consistency_compares_group_truth_and_live_frames(spark, tmp_path):
    a, b = (0.1, 0.1, 0.2, 0.2), (0.5, 0.5, 0.2, 0.2)
    held = lambda path, objects, split="valid", group="g": (path, group, split, objects)
    images = [
        held("same", [(0, [*a]), (1, [*b])], "Val", " G "), held("split", None), held("group", []), held("number", [(0, [*a])]), held("class", [(0, [*a])]),
        held("box", [(0, [*a])]), held("order", [(0, [*a]), (0, [*b])]), held("gone", None), held("torn", None), held("twice", None), held("twice", None, "test"),
        held("late", [(0, [*a])]), held("train", None, "train"), held("pindai/held", [(0, [*a])]), held("pindai/train", None, "train"), held("nogroup", None, group=" "),
    ]
    spark.createDataFrame(images, "path string, groupid string, split string, objects array<struct<classid:int,bbox:array<double>>>").write.parquet(str(tmp_path / "manifest.parquet"))
    frames = [
        frame("same", 1, 1, truth(b, cls=1), None), frame("same", 0, 1, truth(a), None), frame("split", 0, 1, None, None, split="test"), frame("group", 0, 1, None, None, group="h"),
        frame("number", 0, 1, truth(a), None), frame("number", 1, 1, truth(a), None), frame("class", 0, 1, truth(a, cls=1), None), frame("box", 0, 1, truth(b), None),
        frame("order", 0, 1, truth(b, a), None), frame("torn", 0, 1, None, None), frame("torn", 1, 1, [], None, group=None), frame("twice", 0, 1, None, None),
        frame("late", 0, 1, truth(b), None), frame("late", 0, 2, truth(a), None), frame("train", 0, 1, None, None), frame("stray", 0, 1, None, None),
        frame("pindai/held", 0, 1, truth(b), None), frame("pindai/train", 0, 1, None, None), frame("pindai/scan", 0, 1, truth(a), None), frame("nogroup", 0, 1, None, None, group=None),
    ]
    spark.createDataFrame(frames, FRAMES).write.parquet(str(tmp_path / "frame_prediction.parquet"))
    got = sorted(tuple(r) for r in inventory.prediction_consistency(spark, str(tmp_path)).collect())
    assert got == sorted([
        ("split", "split"), ("group", "group"), ("number", "truth"), ("class", "truth"), ("box", "truth"), ("order", "truth"), ("gone", "missing"), ("torn", "group"),
        ("twice", "split"), ("twice", "repeated"), ("train", "unexpected"), ("stray", "unexpected"), ("pindai/held", "truth"), ("pindai/train", "unexpected"), ("pindai/scan", "live"),
    ])


def test_image_headers_behind_long_blocks(spark, tmp_path):
    def jpeg(blocks):
        tiff = b"MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, 6, 0)
        exif = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
        long = (b"\xff\xe1" + struct.pack(">H", 65535) + b"x" * 65533) * blocks
        return b"\xff\xd8" + exif + long + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 1) + b"\1\x11\0\xff\xd9"

    (tmp_path / "short.jpg").write_bytes(jpeg(0))
    (tmp_path / "long.jpg").write_bytes(jpeg(20))
    (tmp_path / "cut.jpg").write_bytes(jpeg(20)[:-20])
    rows = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.orientation, r.problem) for r in files.inspect_images(spark, str(tmp_path)).collect()}
    assert rows == {"short.jpg": (40, 30, 6, None), "long.jpg": (40, 30, 6, None), "cut.jpg": (None, None, None, "damaged header")}


def test_every_current_detection_has_its_two_best_classes(spark, tmp_path):
    box, high, low = (0.0, 0.0, 0.1, 0.1), [0.0] * 7 + [9.0, 0.0, 0.0], [0.0] * 10
    rows = [
        frame("p", 0, 1, None, [(box, 0.5, 9, high)]),  # delivered again below
        frame("p", 0, 2, None, [(box, 0.5, 1, high), (box, None, 2, low)]),
        frame("p", 1, 1, None, [(box, 0.01, i, high) for i in range(3, 404)]),
        frame("q", 0, 1, None, [(box, 0.5, 1, None)]),
        frame("q", 1, 1, None, None),
    ]
    spark.createDataFrame(rows, FRAMES).write.parquet(str(tmp_path / "frame_prediction.parquet"))
    got = {(r.path, r.anchor): (r.class_id, r.accepted) for r in entry.queries()["detection_top2"](spark, str(tmp_path)).collect()}
    assert got == {("p", i): (7, True) for i in (1, *range(3, 404))} | {("p", 2): (0, False), ("q", 1): (None, False)}


def test_digest_orientation_and_side_of_image_files(spark, tmp_path):
    def jpeg(w, h, orientation):
        tiff = b"MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, orientation, 0)
        exif = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
        return b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0\xff\xd9"

    made = {"good.jpg": (16, 40, 1), "turned.jpg": (41, 40, 6), "zero.jpg": (42, 40, 0), "small.jpg": (40, 15, 1), "other.jpg": (43, 40, 1), "a/x.jpg": (44, 40, 1), "a/y.jpg": (44, 40, 1)}
    (tmp_path / "a").mkdir()
    for n, x in made.items():
        (tmp_path / n).write_bytes(jpeg(*x))
    (tmp_path / "cut.jpg").write_bytes(jpeg(45, 40, 1)[:-20])
    rows = [(n, hashlib.sha256(jpeg(*x)).hexdigest().upper()) for n, x in made.items() if n != "other.jpg"] + [("other.jpg", "0" * 64), ("cut.jpg", None), ("gone.jpg", None)]
    got = [tuple(r) for r in files.manifest_file_violations(spark.createDataFrame(rows, "path string, sha256 string"), str(tmp_path)).collect()]
    assert sorted(got) == sorted([
        ("turned.jpg", "EXIF orientation"), ("zero.jpg", "EXIF orientation"), ("small.jpg", "too small"), ("other.jpg", "checksum mismatch"), ("cut.jpg", "damaged header"),
        ("gone.jpg", "missing file"), ("a/x.jpg", "repeated content"), ("a/y.jpg", "repeated content"),
    ])
    problems = {r.path.rsplit("/", 1)[1]: r.problem for r in files.inspect_images(spark, str(tmp_path)).where("problem is not null").collect()}
    assert problems == {"zero.jpg": "invalid EXIF orientation", "small.jpg": "too small", "cut.jpg": "damaged header"}


SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="the tables aren't here")
def test_splits_however_they_are_spelled(spark):
    """Literal answers on the given tables: three splits and none, no unknown one; eight torn groups by the same text, where
    spaces alone left out would give six."""
    rules = {r.rule: r.n for r in inventory.manifest_violations(spark, str(SF)).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert "unknown split" not in rules and rules["group in several splits"] > 0
    torn = inventory.manifest(spark, str(SF)).where("groupid is not null").groupBy("groupid").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    assert torn == 8
    assert {r.split for r in inventory.split_summary(spark, str(SF)).collect()} == {"train", "valid", "test", None}
    assert inventory.class_spread(spark, str(SF)).count() == 40


def test_receipts_with_conflicts(spark, tmp_path):
    image = "image_id bigint, auditedat int, originalpath string, originalsha256 string"
    rows = [(1, 1, "A/x.png", "1"), (1, 2, "a/X.png", "2"), (2, 1, "b", "1"), (3, 1, "B", "2"), (4, 1, "c", "1"), (5, 1, None, "1"), (6, 1, "d", "9")]
    spark.createDataFrame(rows, image).write.parquet(str(tmp_path / "normalized_inventory.parquet"))
    files = [("a\\x.png", "image", 1, "2"), ("b", "image", 1, "1"), ("d", "image", 1, "9"), ("d", "image", 2, "8"), ("e", "image", 1, "1"), ("f", "metadata", 1, "1")]
    spark.createDataFrame(files, "path string, kind string, listedat int, sha256 string").write.parquet(str(tmp_path / "drive_inventory.parquet"))
    got = {tuple(r) for r in inventory.receipt_problems(spark, str(tmp_path)).collect()}
    assert got == {("b", "conflict"), ("c", "missing"), ("d", "sha256"), ("e", "unexpected")}
