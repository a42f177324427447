"""Sources and sinks on small files."""

import hashlib
import io
import os
import json
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestone.sources import documents as D
from lodestone.sources import files as S
from lodestone.sources import sinks as K


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + b"\x08\x02\0\0\0"


def jpeg(w, h, orientation=None):
    out = b"\xff\xd8"
    if orientation:
        tiff = b"MM\0*\0\0\0\x08\0\x01" + struct.pack(">HHIHH", 0x0112, 3, 1, orientation, 0)
        out += b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff
    return out + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0" + b"\xff\xd9"


def test_json_documents(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"kind": "inventory", "schemaVersion": 1, "n": 1.5}, indent=2))
    bad.write_text('{"kind": "x", "schemaVersion": 1, "n": NaN}')
    schema = "kind string, schemaVersion int, n double"
    assert D.read_document(spark, str(good), schema, "inventory").first().n == 1.5
    with pytest.raises(ValueError, match="kind"):
        D.read_document(spark, str(good), schema, "other")
    assert D.read_json(spark, str(bad), schema, fail=False).first().n is None
    with pytest.raises(Exception, match="(?i)malformed|NaN|parse"):
        D.read_json(spark, str(bad), schema).collect()
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    (tmp_path / "bom.json").write_text('\ufeff{"a": [1]}')
    rows = {r.path.rsplit("/", 1)[1]: r.ok for r in D.read_strict(spark, str(tmp_path)).select("path", F.col("value").isNotNull().alias("ok")).collect()}
    assert rows == {"good.json": True, "bad.json": False, "twice.json": False, "bom.json": True}


def test_mapping(spark, tmp_path):
    text = "\ufeff# names\n\nold/a.jpg -> new/a.jpg\r\nnew/b.jpg <- old\\b.jpg\nno arrow\na -> b -> c\n../x -> new/c.jpg\nq -> NEW/A.jpg\nz <- y -> x\n"
    (tmp_path / "m.txt").write_bytes(text.encode())
    rows = {r.line_no: (r.old_path, r.new_path, r.problem) for r in D.read_mapping(spark, str(tmp_path / "m.txt")).collect()}
    assert rows == {
        3: ("old/a.jpg", "new/a.jpg", "repeated"), 4: ("old/b.jpg", "new/b.jpg", None), 5: (None, None, "malformed"), 6: (None, None, "malformed"),
        7: (None, "new/c.jpg", "unsafe path"), 8: ("q", "NEW/A.jpg", "repeated"), 9: (None, None, "malformed"),
    }


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.png").write_bytes(png(32, 24))
    (tmp_path / "a/y.jpg").write_bytes(jpeg(40, 30, 6))
    (tmp_path / "a/z.jpg").write_bytes(png(5, 5))
    (tmp_path / "a/e.png").write_bytes(b"")
    (tmp_path / "w.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))
    (tmp_path / "t.part").write_bytes(b"x")
    listed = S.list_files(spark, str(tmp_path))
    assert {r.path for r in listed.collect()} == {"a/x.png", "a/y.jpg", "a/z.jpg", "w.webp", "t.part"}  # the empty file isn't scanned
    expected = spark.createDataFrame([("a/x.png",), ("gone",)], "path string")
    issues = {r.path: r.issue for r in S.tree_issues(listed.where("path not like 'a/_.jpg'"), expected).collect()}
    assert issues == {"gone": "missing", "t.part": "unfinished", "w.webp": "unexpected"}
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.inspect_images(spark, str(tmp_path)).collect()}
    assert (rows["x.png"].width, rows["x.png"].height, rows["x.png"].orientation, rows["x.png"].problem) == (32, 24, 1, None)
    assert (rows["y.jpg"].width, rows["y.jpg"].height, rows["y.jpg"].orientation, rows["y.jpg"].format) == (40, 30, 6, "JPEG")
    assert (rows["w.webp"].width, rows["w.webp"].height) == (100, 50)
    assert [rows[n].problem for n in ("z.jpg", "t.part")] == ["format isn't that of the extension", "unknown format"]


def test_metadata(spark, tmp_path):
    for n, c in {"a": b"fine\n", "b": b"  \n", "c": b"x\0y", "d": b"  <!DOCTYPE html><p>", "e": b"\xff\xfe\xfd"}.items():
        (tmp_path / n).write_bytes(c)
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.problem) for r in S.read_metadata(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("fine\n", None), "b": (None, "blank"), "c": (None, "holds NUL"), "d": (None, "HTML"), "e": (None, "not text")}


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name, data in (("a/b.json", b"{}"), ("../escape", b"x"), ("twice", b"1"), ("twice", b"2")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    rows = [(r.member, r.content and bytes(r.content), r.problem) for r in S.read_tar(spark, str(tmp_path / "t.tar.gz")).collect()]
    assert sorted(rows) == [("../escape", None, "unsafe name"), ("a/b.json", b"{}", None), ("link", None, "not a regular file"), *[("twice", None, "repeated name")] * 2]


def test_members_against_a_listing(spark, tmp_path):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    with tarfile.open(tmp_path / "t.tar", "w") as t:
        for name in ("same", "size", "bytes", "stray", "../out"):
            info = tarfile.TarInfo(name)
            info.size = 4
            t.addfile(info, io.BytesIO(b"data"))
    listed = spark.createDataFrame([("same", 4, digest(b"data")), ("size", 5, digest(b"data")), ("bytes", 4, digest(b"atad")), ("gone", 4, None)], "member string, bytes bigint, sha256 string")
    got = {tuple(r) for r in S.archive_problems(S.read_tar(spark, str(tmp_path / "t.tar")), listed).collect()}
    assert got == {("size", "bytes"), ("bytes", "sha256"), ("stray", "unexpected"), ("../out", "unsafe name"), ("gone", "missing")}


def test_tree_with_links_and_empty_files(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/deep.png").write_bytes(b"x")
    (tmp_path / "a/empty.png").write_bytes(b"")
    (tmp_path / "top.part").write_bytes(b"xy")
    (tmp_path / "a/link").symlink_to("/etc")
    os.mkfifo(tmp_path / "pipe")
    rows = S.list_tree(spark, str(tmp_path))
    assert {(r.path, r.length, r.kind) for r in rows.collect() if r.kind == "file"} == {("a/b/deep.png", 1, "file"), ("a/empty.png", 0, "file"), ("top.part", 2, "file")}
    assert {(r.path, r.kind) for r in rows.collect() if r.kind != "file"} == {("a/link", "link"), ("pipe", "other")}
    expected = spark.createDataFrame([("a/b/deep.png",), ("a/empty.png",), ("a/link",)], "path string")
    assert {tuple(r) for r in S.tree_issues(rows, expected).collect()} == {
        ("top.part", "unfinished"), ("pipe", "unexpected"), ("pipe", "not a regular file"), ("a/link", "symbolic link"), ("a/empty.png", "empty"),
    }
    assert {(r.path, r.kind) for r in S.list_tree(spark, f"file://{tmp_path}").collect()} == {(r.path, r.kind) for r in rows.collect()}
    (tmp_path / "nothing").mkdir()
    assert S.list_tree(spark, str(tmp_path / "nothing")).count() == 0


def test_labels(spark, tmp_path):
    (tmp_path / "s.txt").write_text("3 0.350000000 0.400000000 0.500000000 0.600000000\n\n1 0.5 0.5 0.2 0.2\nx 1\n")
    rows = S.read_labels(spark, str(tmp_path / "s.txt"))
    assert [(r.instance, r.class_id, r.problem) for r in rows.orderBy("instance").collect()] == [(0, 3, None), (1, 1, None), (2, None, "malformed line")]
    objects = spark.createDataFrame([("s", 0, 3, [0.1, 0.1, 0.5, 0.6]), ("s", 1, 1, [0.4, 0.4, 0.2, 0.3]), ("u", 0, 1, [0.4, 0.4, 0.2, 0.3])], "stem string, instance int, class_id int, bbox array<double>")
    assert {tuple(r) for r in S.label_differences(rows, objects).collect()} == {("s", 1, "other box"), ("s", 2, "extra line"), ("u", 0, "missing line")}


def test_label_files_round_trip(spark, tmp_path):
    m = spark.createDataFrame([("p", [(3, [0.1, 0.1, 0.5, 0.6]), (0, [0.0, 0.0, 0.1, 0.1])]), ("n", None)], "path string, objects array<struct<classid:int,bbox:array<double>>>")
    texts = {r.path: r.text for r in K.label_files(m).collect()}
    assert texts["n"] == "" and texts["p"].splitlines()[1] == "0 0.050000000 0.050000000 0.100000000 0.100000000"
    (tmp_path / "p.txt").write_text(texts["p"])
    objects = m.where("objects is not null").select(F.col("path").alias("stem"), F.posexplode("objects").alias("instance", "o")).select("stem", "instance", F.col("o.classid").alias("class_id"), "o.bbox")
    assert S.label_differences(S.read_labels(spark, str(tmp_path / "p.txt")), objects).count() == 0


def test_fetch(spark):
    def get(i, seen={}):  # noqa: B006 - counts within a worker
        seen[i] = seen.get(i, 0) + 1
        if i == "flaky" and seen[i] < 3:
            raise OSError("busy")
        if i == "gone":
            raise FileNotFoundError(i)
        return b"<html>" if i == "page" else i.encode()

    rows = spark.createDataFrame([("ok",), ("flaky",), ("gone",), ("page",)], "id string").coalesce(1)
    got = {r.id: (r.content and bytes(r.content), r.error) for r in S.fetch(rows, get, sleep=lambda s: None).collect()}
    assert got == {"ok": (b"ok", None), "flaky": (b"flaky", None), "gone": (None, "FileNotFoundError: gone"), "page": (None, "HTML")}


def test_reports_and_publishing(spark, tmp_path):
    K.write_report(tmp_path / "r/report.json", {"a": "ü"})
    with pytest.raises(ValueError, match="JSON"):
        K.write_report(tmp_path / "r/report.json", {"a": float("nan")})
    assert json.loads((tmp_path / "r/report.json").read_text()) == {"a": "ü"} and len(list((tmp_path / "r").iterdir())) == 1
    df = spark.createDataFrame([(1, "train", "x"), (2, "test", "y")], "i int, split string, class string")
    K.write_splits(df, str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set")).where("split = 'test'").collect()[0]["class"] == "y"
    with pytest.raises(FileExistsError):
        K.publish(df, str(tmp_path / "set"))
    assert not (tmp_path / "set.incoming").exists()
    files = [{"path": "b", "sha256": "1"}, {"path": "a", "sha256": "2"}]
    assert K.artifact_id(files) == K.artifact_id(files[::-1]) and len(K.artifact_id(files)) == 16
    have, need = (spark.createDataFrame(rows, "path string") for rows in ([("a",)], [("a",), ("c",)]))
    assert [r.path for r in K.missing_artifacts(have, need).collect()] == ["c"]
