"""Writing: reports, tables that are published once, label files, prepared splits."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.documents import fingerprint_value
from lodestone.functions.geometry import label_line


def write_report(path: str | Path, value: Any) -> None:
    """A small report as JSON, without NaN, in place of an older one at once or not at all."""
    path = Path(path)
    data = (json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False) + "\n").encode()
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise


def publish(df: DataFrame, target: str, partition_by: tuple[str, ...] = ()) -> None:
    """A table written beside its target and renamed to it, never over an existing one: readers see all of it or none."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    to, staged = jvm.org.apache.hadoop.fs.Path(target), jvm.org.apache.hadoop.fs.Path(f"{target}.incoming")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        raise FileExistsError(target)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(staged.toString())
    if fs.exists(to) or not fs.rename(staged, to):
        raise FileExistsError(target)


def label_files(manifest: DataFrame) -> DataFrame:
    """``path, text``: the label lines of each image, in the order of its objects; empty text for none."""
    objects = F.coalesce("objects", F.array().cast(manifest.schema["objects"].dataType))
    lines = F.transform(objects, lambda o: F.concat(label_line(o["classid"], o["bbox"]), F.lit("\n")))
    return manifest.select("path", F.array_join(lines, "").alias("text"))


def write_splits(df: DataFrame, target: str, columns: tuple[str, ...] = ("split", "class")) -> None:
    """A prepared dataset in folders ``split=.../class=...``, which scans by split or class then read alone."""
    publish(df.repartition(*columns), target, columns)


def artifact_id(files: list[dict[str, Any]]) -> str:
    """The identity of a bundle: the first 16 digits of the fingerprint of its files, in order of their paths."""
    return fingerprint_value(sorted(files, key=lambda f: f["path"]))[:16]


def missing_artifacts(files: DataFrame, required: DataFrame) -> DataFrame:
    """Required paths that a bundle lacks."""
    return required.select("path").distinct().join(files.select("path"), "path", "left_anti")
