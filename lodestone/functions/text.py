"""Text keys. NFKC and case folding have no JVM expression, so they run in Arrow UDFs over distinct values of a batch."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def same_text_value(s: str | None) -> str | None:
    """NFKC, trimmed, case folded; an empty result is None."""
    if s is None:
        return None
    t = s.strip().lower() if s.isascii() else unicodedata.normalize("NFKC", s).strip().casefold()
    return t or None


def same_path_value(s: str | None) -> str | None:
    """The same text once a backslash is read as a slash, also one that NFKC makes out of a wide backslash."""
    t = same_text_value(s)
    return t.replace("\\", "/") if t else None


def by_distinct(f: Callable[[str | None], str | None], values: pa.Array) -> pa.Array:
    """f of every value, worked out once for each distinct one."""
    coded = pc.dictionary_encode(values.cast(pa.string()))
    table = pa.array([f(x) for x in coded.dictionary.to_pylist()], pa.string())
    return table.take(coded.indices) if len(table) else pa.nulls(len(values), pa.string())


@F.arrow_udf(T.StringType())
def _same_text(a: pa.Array) -> pa.Array:
    return by_distinct(same_text_value, a)


@F.arrow_udf(T.StringType())
def _same_path(a: pa.Array) -> pa.Array:
    return by_distinct(same_path_value, a)


def same_text(c: Column | str) -> Column:
    """Key under which texts count as the same text; null for null and blank ones."""
    return _same_text(c)


def same_path(c: Column | str) -> Column:
    """Key under which paths count as the same path; null for null and blank ones."""
    return _same_path(c)


def strip(c: Column | str) -> Column:
    """Without white space at either end, Unicode white space included; unlike ``trim``, which knows the blank only."""
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"(?U)^\s+|\s+$", "")


def hex_digest(c: Column | str, digits: int) -> Column:
    """Lower-case hex of exactly so many digits; anything else counts as missing."""
    t = F.lower(strip(c))
    return F.when(t.rlike(f"^[0-9a-f]{{{digits}}}$"), t)
