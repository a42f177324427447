"""Rules for single values, as boolean columns that are never null."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import strip


@F.arrow_udf(T.BooleanType())
def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.is_normalized("NFC", t) for t in texts.to_pylist()], pa.bool_())


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def plain_text(c: Column) -> Column:
    """Not blank, without white space at its ends and without control or unassigned characters."""
    return sure((c != "") & (strip(c) == c) & ~c.rlike(r"\p{C}"))


def whole_number(c: Column, least: int = 0) -> Column:
    return sure(c.cast("bigint") == c) & sure(c >= least)


def finite_number(c: Column, least: float = float("-inf"), most: float = float("inf")) -> Column:
    return sure(~F.isnan(c) & (F.abs(c) < float("inf")) & (c >= least) & (c <= most))


def task_id(text: Column) -> Column:
    """A positive whole number or a text of digits, as labelling tools name tasks."""
    return sure(text.rlike(r"^[0-9]*[1-9][0-9]*\z"))


def field_problem(json_object: Column, required: list[str], optional: list[str]) -> Column:
    """Why a JSON object hasn't exactly the fields it may have: not an object, missing or unknown ones; null if it has."""
    keys = F.json_object_keys(json_object)
    lacking = F.array_except(F.array(*(F.lit(r) for r in required)).cast("array<string>"), keys)
    unknown = F.array_except(keys, F.array(*(F.lit(r) for r in required + optional)).cast("array<string>"))
    return (
        F.when(keys.isNull(), "not an object").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ", ")))
    )


def composed_text(c: Column) -> Column:
    """In Unicode's composed form (NFC)."""
    return sure(_composed(c))
