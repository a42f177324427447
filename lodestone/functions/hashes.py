"""64-bit image hashes as signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_long(hex16: Column | str) -> Column:
    """The 64 bits of 16 hex digits; ``conv`` to base -10 keeps the upper half of the range castable."""
    return F.conv(hex16, 16, -10).cast("bigint")


def hamming(a: Column | str, b: Column | str) -> Column:
    """Bits in which two hashes differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))
