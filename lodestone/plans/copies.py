"""Problem 2: the drive's listing against the rename mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import same_path, same_text
from lodestone.operators.copydiff import compare_copies

#: Working names of the compared fields and the names the result gives them.
FIELDS = {
    "driveid": "driveid",
    "source_id": "source.id",
    "originalpath": "source.originalpath",
    "licensestatus": "source.licensestatus",
    "parent_key": "source.parentsuggestion.key",
}


def _side(df: DataFrame, path: str, order: str) -> DataFrame:
    return df.select(
        same_path(path).alias("filekey"),
        "driveid",
        same_text("source.id").alias("source_id"),
        same_path("source.originalpath").alias("originalpath"),
        same_text("source.licensestatus").alias("licensestatus"),
        same_text("source.parentsuggestion.key").alias("parent_key"),
        F.col(order).alias("noted"),
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    drive = spark.read.parquet(f"{sf_dir}/drive_inventory.parquet").where("kind = 'image'")
    mapping = spark.read.parquet(f"{sf_dir}/rename_mapping.parquet")
    return compare_copies(
        _side(drive, "path", "listedat"),
        _side(mapping, "newpath", "line_no"),
        "filekey",
        list(FIELDS),
        left_order="noted",
        right_order="noted",
        missing_in_left="missing_in_drive",
        missing_in_right="missing_in_mapping",
        names=FIELDS,
    )


_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)).replace("＇", "")
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "")
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"


def _same(column: str) -> str:
    """SQL has NFC only; of what NFKC does beyond it, the tables here need the full-width forms and the blanks."""
    return f"nullif(lower(trim(translate(nfc_normalize({column}), '{_WIDE}', '{_NARROW}'), {_BLANKS})), '')"


def _side_sql(path: str, order: str, table: str) -> str:
    return f"""select replace({_same(path)}, '\\', '/') as filekey, driveid, {_same("source.id")} as source_id,
    replace({_same("source.originalpath")}, '\\', '/') as originalpath, {_same("source.licensestatus")} as licensestatus,
    {_same("source.parentsuggestion.key")} as parent_key
  from {table} qualify row_number() over (partition by filekey order by {order} desc) = 1"""


P2_SQL = f"""
with drive as ({_side_sql("path", "listedat", "(select * from drive_inventory where kind = 'image')")}),
mapping as ({_side_sql("newpath", "line_no", "rename_mapping")}),
paired as (select d.filekey as dk, m.filekey as mk, d, m from drive d full join mapping m on d.filekey = m.filekey)
select coalesce(dk, mk) as filekey, case when mk is null then 'missing_in_mapping' else 'missing_in_drive' end as difference
from paired where dk is null or mk is null
""" + "".join(
    f"union all select dk, '{name}' from paired where dk is not null and mk is not null and d.{field} is distinct from m.{field}\n" for field, name in FIELDS.items()
)
