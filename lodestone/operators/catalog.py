"""A searchable catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip


def search(items: DataFrame, texts: list[str], query: str, *, family: str | None = None, wanted: str | None = None) -> DataFrame:
    """Items of a family (all if none is wanted) whose texts, joined by blanks, hold the trimmed query in any case."""
    here = F.lower(F.concat_ws(" ", *texts)).contains(F.lower(strip(F.lit(query))))
    return items.where(here & (F.col(family) == wanted)) if family and wanted else items.where(here)


def families(items: DataFrame, family: str, order: str) -> DataFrame:
    """``family, first_seen``: each family once, with the least ``order`` of its items, by which a filter bar lists them."""
    return items.groupBy(family).agg(F.min(order).alias("first_seen"))


def describe(taxonomy: DataFrame, descriptions: DataFrame, key: str) -> DataFrame:
    """The taxonomy with the description of the same position; items without one stay."""
    return taxonomy.join(descriptions, key, "left")


def others(items: DataFrame, key: str, own: int, count: int = 4) -> DataFrame:
    """The first ``count`` items other than one's own: a short list beside it."""
    return items.where(F.col(key) != own).orderBy(key).limit(count)
