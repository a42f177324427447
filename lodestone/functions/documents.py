"""Canonical JSON and its fingerprints. Spark's own JSON writer formats numbers and orders keys otherwise."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value: Any) -> str:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint_value(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def strict_value(text: str | None) -> Any:
    """JSON without duplicate keys, NaN or Infinity; a byte order mark is skipped. ValueError otherwise."""

    def pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
        out = dict(items)
        if len(out) < len(items):
            raise ValueError("duplicate key")
        return out

    def constant(name: str) -> Any:
        raise ValueError(f"{name} is not a number")

    return json.loads((text or "").removeprefix("\ufeff"), object_pairs_hook=pairs, parse_constant=constant)


@F.arrow_udf(T.StringType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    def one(t: str | None) -> str | None:
        try:
            return None if t is None else fingerprint_value(strict_value(t))
        except ValueError:
            return None

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


def fingerprint(json_text: Column | str) -> Column:
    """SHA-256 of the canonical form of a JSON text; null for null and for what isn't strict JSON."""
    return _fingerprint(json_text)


def strict_variant(text: Column) -> Column:
    """The text as a variant; null for duplicate keys, NaN and other faults. A byte order mark is skipped."""
    return F.try_parse_json(F.regexp_replace(text, "^\ufeff", ""))
