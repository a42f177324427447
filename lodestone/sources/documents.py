"""JSON documents and text mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions.documents import strict_variant
from lodestone.functions.paths import safe_path
from lodestone.functions.text import same_text, strip


def read_json(spark: SparkSession, path: str, schema: StructType | str, *, fail: bool = True) -> DataFrame:
    """JSON documents (one a file) of a known schema. NaN and Infinity are faults; faults stop the reading, or with
    ``fail`` off give rows of nulls."""
    options = {"multiLine": True, "allowNonNumericNumbers": False, "mode": "FAILFAST" if fail else "PERMISSIVE"}
    return spark.read.schema(schema).options(**options).json(path)


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """``path, value variant``: whole files as variants; null where keys repeat, numbers aren't finite or text isn't
    JSON. A byte order mark is skipped."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), strict_variant(F.col("value")).alias("value"))


def read_document(spark: SparkSession, path: str, schema: StructType | str, kind: str, version: int = 1) -> DataFrame:
    """A document whose ``kind`` and ``schemaVersion`` must be as said."""
    df = read_json(spark, path, schema)
    wrong = df.where(~(F.col("kind").eqNullSafe(F.lit(kind)) & F.col("schemaVersion").eqNullSafe(F.lit(version))))
    if not wrong.isEmpty():
        raise ValueError(f"not a document of kind {kind}, version {version}: {path}")
    return df


def parse_mapping(lines: DataFrame) -> DataFrame:
    """``line_no, old_path, new_path, problem`` of lines ``old -> new`` or ``new <- old``.

    ``lines``: ``line_no, value``. Blank lines and those that begin with # are left out; a byte order mark is skipped.
    ``problem`` (null if none): ``malformed`` without exactly one arrow, ``unsafe path``, ``repeated`` for all lines of
    a destination that occurs again in any case.
    """
    text = strip(F.regexp_replace("value", "^\ufeff", ""))
    rows = lines.select("line_no", text.alias("t")).where("t <> '' and not startswith(t, '#')")
    arrows = F.size(F.split("t", "->", -1)) + F.size(F.split("t", "<-", -1)) - 2
    forward = F.col("t").contains("->")
    sides = F.split("t", F.lit("->|<-"), -1)
    old, new = F.when(forward, sides[0]).otherwise(F.get(sides, F.lit(1))), F.when(forward, F.get(sides, F.lit(1))).otherwise(sides[0])
    one = F.col("arrows") == 1
    rows = rows.withColumn("arrows", arrows).select(
        "line_no", "arrows", safe_path(strip(F.when(one, old))).alias("old_path"), safe_path(strip(F.when(one, new))).alias("new_path")
    )
    rows = rows.withColumn("__key", same_text("new_path"))
    again = rows.where("__key is not null").groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    problem = F.when(~one, "malformed").when(F.col("old_path").isNull() | F.col("new_path").isNull(), "unsafe path").when(F.col("__n") > 1, "repeated")
    return rows.join(again, "__key", "left").select("line_no", "old_path", "new_path", problem.alias("problem"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A mapping file; lines are numbered from 1 in their order, so it is read as one text."""
    whole = spark.read.text(path, wholetext=True)
    return parse_mapping(whole.select(F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("p", "value")).select((F.col("p") + 1).alias("line_no"), "value"))
