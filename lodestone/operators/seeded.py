"""The reproducible split of few groups by a seeded shuffle."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rows import lookup_join

#: Groups that the driver shuffles at most. The shuffle is one sequence of random numbers over all of them.
MAX_GROUPS = 1_000_000


def deal(groups: dict[str, int], seed: int, classes: int, share: float = 0.15, trials: int = 1000) -> dict[str, str]:
    """A split for each group (with the bits of its classes): the first shuffle in which every split has all classes.

    The groups are sorted, then shuffled anew for each trial by one generator; of G groups the first
    round-half-even(share * G), at least one, are valid, as many next test, the rest train.
    """
    names, every = sorted(groups), (1 << classes) - 1
    if len(names) < 3:
        raise ValueError("three groups are needed")
    generator, n = random.Random(seed), max(1, round(share * len(names)))
    for _ in range(trials):
        order = names.copy()
        generator.shuffle(order)
        parts = {"valid": order[:n], "test": order[n : 2 * n], "train": order[2 * n :]}
        bits = dict.fromkeys(parts, 0)
        for s, members in parts.items():
            for g in members:
                bits[s] |= groups[g]
        if all(b == every for b in bits.values()):
            return {g: s for s, members in parts.items() for g in members}
    raise ValueError(f"no shuffle of {trials} gives every split all classes")


def seeded_split(rows: DataFrame, group: str, class_ids: str, *, seed: int = 42, classes: int = 10) -> DataFrame:
    """The rows with ``split``; each group lies in one. ``class_ids``: an array of classes from 0. Null groups are left
    out. More than MAX_GROUPS groups are refused: the split by largest differencing has no such bound.
    """
    bit = F.aggregate(F.coalesce(class_ids, F.array().cast("array<int>")), F.lit(0), lambda a, c: a.bitwiseOR(F.get(F.array(*(F.lit(1 << i) for i in range(classes))), c)))
    g = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.bit_or(bit).alias("bits"))
    found = g.limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    placed = deal({r[0]: r[1] for r in found}, seed, classes)
    table = rows.sparkSession.createDataFrame(list(placed.items()), f"{group} string, split string")
    return lookup_join(rows.drop("split"), table, group)
