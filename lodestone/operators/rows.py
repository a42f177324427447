"""Current rows, and joins that a hot key doesn't hold up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than this share of the rows; so there are at most so many hot keys.
HOT_KEYS = 1000
#: Below so many rows no key can keep a task busy.
SMALL = 100_000


def current_rows(df: DataFrame, keys: list[str], order: str | Column, columns: list[str] | None = None) -> DataFrame:
    """One row for each key: the one with the highest order.

    Repeated copies count once; of different rows with an equal order the greatest by ``columns`` (default: all other
    columns, in their order) is taken, so that the result doesn't depend on the order of reading. Null keys form one
    group, as in SQL; a null order is the lowest. Rows are combined before the shuffle, so a key may have any number
    of copies. An empty table gives an empty one. Columns must be orderable (no maps).
    """
    rest = columns or [c for c in df.columns if c not in keys]
    order = F.col(order) if isinstance(order, str) else order
    best = df.groupBy(*keys).agg(F.max(F.struct(order.alias("__order"), *rest)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def hot_keys(df: DataFrame, key: str, rows: int) -> list:
    """The keys with more than ``rows / HOT_KEYS`` rows: fewer than HOT_KEYS by definition, so they may be collected."""
    if rows <= SMALL:
        return []
    counted = df.groupBy(key).count().where(f"{key} is not null and count > {max(SMALL // 10, rows // HOT_KEYS)}")
    return [r[0] for r in counted.select(key).collect()]


def lookup_join(big: DataFrame, table: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``big`` joined with a table in which ``key`` is unique, wherever the rows of ``big`` gather.

    The rows of hot keys, which hashing would put into one task, meet their few table rows by a broadcast of at most
    HOT_KEYS rows; all others by an ordinary join. ``rows``: the size of ``big``, if known. ``how``: inner or left.
    Null keys match nothing; a left join keeps them.
    """
    hot = hot_keys(big, key, big.count() if rows is None else rows)
    if not hot:
        return big.join(table, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return big.where(~is_hot).join(table, key, how).unionByName(
        big.where(is_hot).join(F.broadcast(table.where(F.col(key).isin(hot))), key, how)
    )
