"""Class scores: stable softmax, the two best classes, acceptance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.let import let

CLASSES = 10


def valid_logits(logits: Column, classes: int = CLASSES) -> Column:
    finite = F.forall(logits, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(logits) == classes) & finite, F.lit(False))


def softmax(logits: Column) -> Column:
    """Probabilities; the greatest logit is subtracted first, so that no exponential overflows."""
    def parts(powers: Column) -> Column:
        return let(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(powers, lambda p: p / total))

    return let(F.array_max(logits), lambda most: let(F.transform(logits, lambda v: F.exp(v - most)), parts))


def top_two(logits: Column) -> Column:
    """``class_id, confidence, margin``: of equal probabilities the lower class comes first; null without valid logits."""
    order = F.array_sort(F.transform(softmax(logits), lambda p, i: F.struct((0.0 - p).alias("p"), i.alias("i"))))

    def found(best: Column) -> Column:
        first, second = best[0], best[1]
        return F.struct(first["i"].alias("class_id"), (0.0 - first["p"]).alias("confidence"), (second["p"] - first["p"]).alias("margin"))

    return F.when(valid_logits(logits), let(order, found))


def accepted(best: Column, confidence: Column | float, margin: Column | float) -> Column:
    return F.coalesce((best["confidence"] >= confidence) & (best["margin"] >= margin), F.lit(False))
