"""A name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once.

    Inside lambdas the optimizer doesn't share equal subexpressions; a lambda's own variable is a value already.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
