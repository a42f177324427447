"""Files: listings, checks of their contents, image headers, archives, label files, fetching."""

from __future__ import annotations

import io
import os
import re
import stat
import struct
import tarfile
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.paths import archive_path, extension_format, magic_format
from lodestone.functions.text import strip
from lodestone.operators.quality import symmetric_difference, verify_receipts

#: Longest metadata text, in bytes.
METADATA_BYTES = 16 << 20
#: The shortest side an image may have, in pixels.
LEAST_SIDE = 16
#: First bytes of an image that are tried for its header before the whole file is.
HEAD_BYTES = 1 << 18


def _relative(path: str, root: str) -> Column:
    """The path without the folder ``root`` before it."""
    base = F.lit(root.rstrip("/") + "/")
    whole = F.regexp_replace(path, r"^file:/+", "/")
    plain = F.regexp_replace(base, r"^file:/+", "/")
    return F.when(whole.startswith(plain), F.substring(whole, F.length(plain) + 1, F.length(whole))).otherwise(whole)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified``: all files under a folder, ``path`` relative to it. Contents aren't read.

    Spark leaves empty files out of a scan, so an expected file that is empty shows as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(_relative("path", root).alias("path"), "length", F.col("modificationTime").alias("modified"))


TREE = "path string, length bigint, modified timestamp, kind string"


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified, kind``: everything under a folder but folders, ``path`` relative to it; nothing is read.

    ``kind`` is file, link (a symbolic link, whatever it leads to, which isn't followed; other file systems than the
    local one have none) or other (devices and the like). Unlike :func:`list_files` empty files are there too. A task
    walks each entry of the folder itself; the folder must be one that all executors see.
    """
    local = "://" not in root or root.startswith("file:")
    base = re.sub(r"^file:/+", "/", root).rstrip("/") if local else root.rstrip("/")
    if local:
        heads = sorted(os.listdir(base))
    else:
        fs, at = pafs.FileSystem.from_uri(base)
        heads = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(at)))

    def walk_local(head: str) -> Iterator[dict]:
        stack = [head]
        while stack:
            path = stack.pop()
            whole = f"{base}/{path}"
            st = os.lstat(whole)
            if stat.S_ISDIR(st.st_mode):
                stack += [f"{path}/{n}" for n in sorted(os.listdir(whole), reverse=True)]
                continue
            kind = "link" if stat.S_ISLNK(st.st_mode) else "file" if stat.S_ISREG(st.st_mode) else "other"
            yield {"path": path, "length": st.st_size, "modified": datetime.fromtimestamp(st.st_mtime, UTC), "kind": kind}

    def walk_remote(head: str) -> Iterator[dict]:
        fs, at = pafs.FileSystem.from_uri(base)
        top = fs.get_file_info(f"{at}/{head}")
        for f in fs.get_file_info(pafs.FileSelector(top.path, recursive=True)) if top.type == pafs.FileType.Directory else [top]:
            if f.type != pafs.FileType.Directory:
                yield {"path": f.path[len(at.rstrip("/")) + 1 :], "length": f.size, "modified": f.mtime, "kind": "file" if f.is_file else "other"}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("kind", pa.string())])
        for batch in batches:
            for head in batch.column(0).to_pylist():
                rows = (walk_local if local else walk_remote)(head)
                while some := list(islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist(some, schema)

    names = spark.createDataFrame([(h,) for h in heads], "head string")
    return names.repartition(max(1, min(len(heads), spark.sparkContext.defaultParallelism)), "head").mapInArrow(walk, TREE)


def tree_issues(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``path, issue``: files that aren't expected, expected ones that are missing, and unfinished downloads; of
    :func:`list_tree` also what isn't a regular file, and empty files, expected or not."""
    d = symmetric_difference(files.select("path").distinct(), expected.select("path").distinct())
    issue = F.when(F.col("side") == "right", "missing").when(F.col("path").endswith(".part"), "unfinished").otherwise("unexpected")
    issues = d.select("path", issue.alias("issue"))
    if "kind" in files.columns:
        odd = F.when(F.col("kind") == "link", "symbolic link").when(F.col("kind") != "file", "not a regular file").when(F.col("length") == 0, "empty")
        issues = issues.unionByName(files.select("path", odd.alias("issue")).where("issue is not null").distinct())
    return issues


def metadata_problem(content, length):
    """Why bytes aren't a metadata text: too long, not text, blank, holding NUL, or a page of HTML; null if they are."""
    text = F.try_validate_utf8(content.cast("string"))
    head = F.lower(F.substring(strip(text), 1, 15))
    return (
        F.when(length > METADATA_BYTES, "too long").when(text.isNull(), "not text").when(strip(text) == "", "blank")
        .when(text.contains("\x00"), "holds NUL").when(head.startswith("<!doctype html") | head.startswith("<html"), "HTML")
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, problem`` of metadata files."""
    f = spark.read.format("binaryFile").load(path)
    problem = metadata_problem(F.col("content"), F.col("length"))
    return f.withColumn("problem", problem).select("path", F.when(F.col("problem").isNull(), F.col("content").cast("string")).alias("text"), "problem")


def image_header(data: bytes) -> tuple[str, int, int, int] | None:
    """(format, width, height, EXIF orientation) from the bytes of a JPEG, PNG or WEBP or their beginning; None for anything else,
    and for a JPEG whose size lies beyond them."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "PNG", *struct.unpack(">II", data[16:24]), 1
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            w, h = (int.from_bytes(data[i : i + 3], "little") + 1 for i in (24, 27))
            return "WEBP", w, h, 1
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "WEBP", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1
        w, h = struct.unpack("<HH", data[26:30])
        return "WEBP", w & 0x3FFF, h & 0x3FFF, 1
    if data[:2] != b"\xff\xd8":
        return None
    at, orientation = 2, 1
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            found = _orientation(body[6:])
            orientation = orientation if found is None else found
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            h, w = struct.unpack(">HH", body[1:5])
            return "JPEG", w, h, orientation
        at += 2 + size
    return None


def _orientation(tiff: bytes) -> int | None:
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return None
    at = int.from_bytes(tiff[4:8], order)
    for i in range(int.from_bytes(tiff[at : at + 2], order)):
        entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
        if len(entry) == 12 and int.from_bytes(entry[:2], order) == 0x0112:
            return int.from_bytes(entry[8:10], order)
    return None


@F.arrow_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "orientation")]))
def _header(data: pa.Array) -> pa.Array:
    found = (image_header(x.as_py() or b"") for x in data)
    kind = pa.struct([(n, pa.int32()) for n in ("width", "height", "orientation")])
    return pa.array([x and dict(zip(("width", "height", "orientation"), x[1:], strict=True)) for x in found], kind)


def inspect_images(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256, format, width, height, orientation, problem`` of image files, without decoding pixels.

    Problems: format unknown, format not that of the extension, header damaged, a side below LEAST_SIDE, an EXIF
    orientation that isn't 1 to 8. Orientation is read from JPEG only and 1 for others. Empty files aren't scanned (see :func:`list_files`).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    # Most headers and their EXIF block lie within the first bytes. Long blocks may stand before the size in a JPEG; only
    # where its head gives no size does the whole file go to Python.
    rows = files.select("path", "length", F.sha2("content", 256).alias("sha256"), magic_format(F.col("content")).alias("format"), extension_format(F.col("path")).alias("named"), "content")
    rows = rows.withColumn("first", _header(F.substring("content", 1, HEAD_BYTES)))
    short = F.col("first").isNull() & (F.col("format") == "JPEG") & (F.col("length") > HEAD_BYTES)
    rows = rows.withColumn("whole", _header(F.when(short, F.col("content"))))
    header = F.coalesce("first", "whole")
    rows = rows.select("path", "length", "sha256", "format", "named", *(header[n].alias(n) for n in ("width", "height", "orientation")))
    problem = (
        F.when(F.col("format").isNull(), "unknown format")
        .when(~F.col("format").eqNullSafe(F.col("named")), "format isn't that of the extension").when(F.col("width").isNull(), "damaged header")
        .when(F.least("width", "height") < LEAST_SIDE, "too small").when(~F.col("orientation").between(1, 8), "invalid EXIF orientation")
    )
    return rows.withColumn("problem", problem).drop("named")


def manifest_file_violations(manifest: DataFrame, root: str) -> DataFrame:
    """``path, rule``: every rule that a row's image file under ``root`` breaks, beside those of
    :func:`lodestone.operators.quality.manifest_violations`. ``manifest``: ``path, sha256``.

    Rules: the file is there (an empty one counts as missing) and its header can be read; its digest is the stored one,
    unless that is null, and no other path has it; its EXIF orientation is 1; no side is below LEAST_SIDE.
    """
    seen = inspect_images(manifest.sparkSession, root).select(_relative("path", root).alias("path"), F.col("sha256").alias("found"), "width", "height", "orientation")
    rows = manifest.select("path", "sha256").distinct().join(seen, "path", "left")
    rules = F.array_compact(
        F.array(
            F.when(F.col("found").isNull(), "missing file"),
            F.when(F.col("found").isNotNull() & F.col("width").isNull(), "damaged header"),
            F.when(F.lower(strip("sha256")) != F.col("found"), "checksum mismatch"),
            F.when(F.col("orientation") != 1, "EXIF orientation"),
            F.when(F.least("width", "height") < LEAST_SIDE, "too small"),
        )
    )
    files = rows.where("found is not null").select("path", "found").distinct()
    twice = files.groupBy("found").count().where("count > 1").select("found")
    repeated = files.join(twice, "found", "left_semi").select("path", F.lit("repeated content").alias("rule"))
    return rows.select("path", F.explode(rules).alias("rule")).unionByName(repeated)


def read_tar(spark: SparkSession, path: str) -> DataFrame:
    """``archive, member, bytes, sha256, content, problem``: the members of tar archives. Links, devices and unsafe or
    repeated names have a problem and no content."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("bytes", pa.int64()), ("content", pa.binary()), ("kind", pa.string())])
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as tar:
                    for m in tar:
                        if m.isdir():
                            continue
                        data = tar.extractfile(m).read() if m.isreg() else None
                        yield pa.RecordBatch.from_pylist([{"archive": name, "member": m.name, "bytes": m.size, "content": data, "kind": "file" if m.isreg() else "other"}], schema)

    rows = files.mapInArrow(read, "archive string, member string, bytes bigint, content binary, kind string").withColumn("sha256", F.sha2("content", 256))
    twice = rows.groupBy("archive", "member").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(twice, ["archive", "member"])
    unsafe = archive_path(F.col("member")).isNull()
    problem = F.when(F.col("kind") != "file", "not a regular file").when(unsafe, "unsafe name").when(F.col("n") > 1, "repeated name")
    return rows.withColumn("problem", problem).select("archive", "member", "bytes", "sha256", F.when(F.col("problem").isNull(), F.col("content")).alias("content"), "problem")


def archive_problems(members: DataFrame, listed: DataFrame) -> DataFrame:
    """``member, problem``: members of :func:`read_tar` that are unsafe or not as listed (``member, bytes, sha256``): not
    listed (unexpected), missing, or of another size or digest. Null digests aren't compared with anything but null."""
    wrong = members.where("problem is not null").select("member", "problem")
    sound = members.where("problem is null").select("member", "bytes", "sha256")
    return wrong.unionByName(verify_receipts(listed, sound, "member", ["bytes", "sha256"]))


def parse_labels(lines: DataFrame) -> DataFrame:
    """``stem, instance, class_id, cx, cy, w, h, problem`` of label lines ``class cx cy w h`` (``stem, instance, line``).
    A line that hasn't exactly five numbers, the first a whole one, has a problem."""
    parts = F.split(strip(F.col("line")), r"\s+")
    num = lambda i: F.expr(f"try_cast(get(parts, {i}) as double)")
    rows = lines.withColumn("parts", parts).select(
        "stem", "instance", F.expr("try_cast(get(parts, 0) as int)").alias("class_id"), *(num(i).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)), (F.size("parts") == 5).alias("five")
    )
    bad = ~F.col("five") | F.col("class_id").isNull() | F.col("cx").isNull() | F.col("cy").isNull() | F.col("w").isNull() | F.col("h").isNull()
    return rows.withColumn("problem", F.when(bad, "malformed line")).drop("five")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The lines of label files, one for each object, as :func:`parse_labels` gives them; ``stem`` is the file's name."""
    whole = spark.read.text(path, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1)
    return parse_labels(whole.select(stem.alias("stem"), F.posexplode(F.filter(F.split("value", "\n"), lambda x: strip(x) != "")).alias("instance", "line")))


def label_differences(labels: DataFrame, objects: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """``stem, instance, problem``: label lines against objects (``stem, instance, class_id, bbox``)."""
    a, b = labels.alias("a"), objects.alias("b")
    both = a.join(b, (F.col("a.stem") == F.col("b.stem")) & (F.col("a.instance") == F.col("b.instance")), "full_outer")
    box = F.col("b.bbox")
    want = {"cx": box[0] + box[2] / 2, "cy": box[1] + box[3] / 2, "w": box[2], "h": box[3]}
    far = F.lit(False)
    for c, v in want.items():
        far = far | F.coalesce(F.abs(F.col(f"a.{c}") - v) > tolerance, F.lit(True))
    problem = (
        F.when(F.col("a.stem").isNull(), "missing line").when(F.col("b.stem").isNull(), "extra line")
        .when(~F.col("a.class_id").eqNullSafe(F.col("b.class_id")), "other class").when(far, "other box")
    )
    return both.select(F.coalesce("a.stem", "b.stem").alias("stem"), F.coalesce("a.instance", "b.instance").alias("instance"), problem.alias("problem")).where("problem is not null")


def fetch(rows: DataFrame, get: Callable[[str], bytes], *, retries: int = 3, backoff: float = 10.0, spacing: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``id, content, sha256, error``: the file of each ``id``, by any function that gets it.

    A failure is tried again after backoff, twice as long each time; a page of HTML is a failure. Each task waits
    ``spacing`` seconds between two files. ``rows``: ``id``.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            for i in b.column(0).to_pylist():
                if not first:
                    sleep(spacing)
                first, content, error = False, None, None
                for k in range(retries):
                    try:
                        content, error = get(i), None
                        if content[:512].lstrip().lower().startswith((b"<!doctype html", b"<html")):
                            content, error = None, "HTML"
                    except Exception as e:  # whatever the getter raises
                        content, error = None, f"{type(e).__name__}: {e}"
                    if content is not None:
                        break
                    if k + 1 < retries:
                        sleep(backoff * 2**k)
                yield pa.RecordBatch.from_pylist([{"id": i, "content": content, "error": error}], pa.schema([("id", pa.string()), ("content", pa.binary()), ("error", pa.string())]))

    out = rows.select(F.col("id").cast("string").alias("id")).mapInArrow(read, "id string, content binary, error string")
    return out.select("id", "content", F.sha2("content", 256).alias("sha256"), "error")
