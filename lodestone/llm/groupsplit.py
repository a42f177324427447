"""Splits that keep related records together.

Records are related if they share the value of a key (an author, a source, an entity) or are linked, directly or through
others: they are one component, found by :mod:`lodestone.llm.components`. A component's weight is its number of records.

Method: largest-differencing balance. In every partition components are dealt to bins: first as many of one weight as
fill all bins evenly (they differ by nothing), then the rest by differencing, which again and again combines the two most
uneven sets of bins, the fullest of one with the emptiest of the other. The bins of FAN partitions are then dealt to bins
the same way, level by level, until one set of bins is left. These, many and nearly equal, are allotted whole to the
splits by the shares wanted. So BINS rows reach the driver, whatever the number of components or partitions.

So that each split holds every class, some of the lightest components of each class are placed beforehand.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components, star_links
from lodestone.operators.rows import lookup_join
from lodestone.scratch import Scratch

#: Bins of one partition, and in the end.
BINS = 256
#: Partitions whose bins are combined at once.
FAN = 64
#: Components placed beforehand: of each class so many of the lightest are looked at first; more if these don't do.
LIGHTEST = 12


def difference(weights: np.ndarray, bins: int) -> np.ndarray:
    """A bin from 0 to bins - 1 for each weight, so that the sums of the bins are nearly equal.

    Of each weight, whole rounds of ``bins`` items are dealt out evenly; what remains, fewer than ``bins`` items of a
    weight, is balanced by largest differencing.
    """
    place = np.zeros(len(weights), np.int32)
    order = np.argsort(weights, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(weights[order]) != 0]) if len(order) else np.empty(0, int)
    rest: list[int] = []
    for lo, hi in zip(starts, np.r_[starts[1:], len(order)], strict=True) if len(order) else ():
        whole = (hi - lo) // bins * bins
        place[order[lo : lo + whole]] = np.arange(whole) % bins
        rest += order[lo + whole : hi].tolist()
    if not rest:
        return place
    # A set of bins: its sums, fullest first, and how it came about: an item in the first bin, or two sets and the order
    # that their joined bins were put in. The heap gives the most uneven set.
    tie = count()
    heap: list[tuple] = [(-int(weights[i]), next(tie), None, i) for i in rest]
    heapq.heapify(heap)

    def sums_of(entry: tuple) -> np.ndarray:
        if entry[2] is not None:
            return entry[2]
        single = np.zeros(bins, np.int64)
        single[0] = weights[entry[3]]
        return single

    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        joined = sums_of(a) + sums_of(b)[::-1]
        by = np.argsort(-joined, kind="stable")
        joined = joined[by] - joined[by[-1]]
        heapq.heappush(heap, (-int(joined[0]), next(tie), joined, (a[3], b[3], by.astype(np.int32))))
    stack = [(heap[0][3], np.arange(bins, dtype=np.int32))]
    while stack:
        came, bin_of = stack.pop()
        if isinstance(came, int):
            place[came] = bin_of[0]
            continue
        left, right, by = came
        first = np.empty(bins, np.int32)
        first[by] = bin_of
        stack.append((left, first))
        stack.append((right, first[::-1]))
    return place


def allot(weights: list[int], shares: dict[str, float], filled: dict[str, int]) -> list[str]:
    """A split for each bin: the heaviest first, each to the split that is furthest below its share."""
    total = sum(weights) + sum(filled.values())
    have = dict(filled)
    out = [""] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        name = max(shares, key=lambda s: (shares[s] * total - have.get(s, 0), s))
        out[i] = name
        have[name] = have.get(name, 0) + weights[i]
    return out


def cover(candidates: Iterable[tuple], shares: dict[str, float]) -> tuple[dict, set]:
    """Splits for some of (component, weight, set of classes), so that each split holds each class, and the classes
    that some split lacks still.

    The class with the fewest components comes first; each split that lacks it takes the component that brings it the
    most missing classes, the lightest of these. The smallest share chooses first.
    """
    of_class: dict[int, list[tuple]] = {}
    for x in candidates:
        for c in x[2]:
            of_class.setdefault(c, []).append(x)
    placed: dict = {}
    held: dict[str, set] = {s: set() for s in shares}
    short = set()
    for c in sorted(of_class, key=lambda c: (len(of_class[c]), c)):
        for name in sorted(shares, key=lambda s: (shares[s], s)):
            if c in held[name]:
                continue
            free = [x for x in of_class[c] if x[0] not in placed]
            if not free:
                short.add(c)
                continue
            best = min(free, key=lambda x: (-len(x[2] - held[name]), x[1], x[0]))
            placed[best[0]] = name
            held[name] |= best[2]
    return placed, short


def _placed_beforehand(weights: DataFrame, classes: DataFrame, shares: dict[str, float]) -> dict[int, tuple[str, int]]:
    """(split, weight) of the components placed so that each split holds each class.

    The lightest components of each class reach the driver, of each class a few; four times as many again as long as
    a class that has more is missing somewhere.
    """
    held = classes.join(weights, "component")
    held = held.groupBy("component", "weight").agg(F.collect_set("class").alias("classes"))  # no more than there are classes
    one = held.select("component", "weight", "classes", F.explode("classes").alias("class"))
    rank = F.row_number().over(Window.partitionBy("class").orderBy("weight", "component"))
    most = LIGHTEST
    while True:
        rows = one.withColumn("rank", rank).where(F.col("rank") <= most).collect()
        candidates = {r["component"]: (r["component"], r["weight"], frozenset(r["classes"])) for r in rows}
        placed, short = cover([candidates[c] for c in sorted(candidates)], shares)
        full = {r["class"] for r in rows if r["rank"] == most}
        if not short & full:
            return {c: (s, candidates[c][1]) for c, s in placed.items()}
        most *= 4


def _dealt(free: DataFrame, bins: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``component, bin`` and ``bin, weight`` of the bins that are left in the end."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = [], []
        for batch in batches:
            names.append(batch.column(0))
            weights.append(batch.column(1).to_numpy())
        if not names:
            return
        w = np.concatenate(weights)
        place, at = difference(w, bins), 0
        for n in names:
            yield pa.RecordBatch.from_arrays([n, pa.array(w[at : at + len(n)]), pa.array(place[at : at + len(n)])], ["component", "weight", "bin"])
            at += len(n)

    def again(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(next_bin=difference(rows["weight"].to_numpy(), bins))

    items = free.select("component", "weight").mapInArrow(deal, "component bigint, weight bigint, bin int")
    items = scratch.write(items.withColumn("part", F.spark_partition_id()), "dealt")
    full = scratch.write(items.groupBy("part", "bin").agg(F.sum("weight").alias("weight")), "bins0")
    level = 0
    while full.select("part").distinct().limit(2).count() > 1:
        # FAN * bins rows in a group.
        up = full.withColumn("next_part", F.expr(f"part div {FAN}").cast("int"))
        up = up.groupBy("next_part").applyInPandas(again, "part int, bin int, weight bigint, next_part int, next_bin int")
        up = scratch.write(up, f"up{level}")
        items = items.join(up.select("part", "bin", "next_part", "next_bin"), ["part", "bin"])
        items = items.select("component", "weight", F.col("next_part").alias("part"), F.col("next_bin").alias("bin"))
        level += 1
        full = scratch.write(up.groupBy(F.col("next_part").alias("part"), F.col("next_bin").alias("bin")).agg(F.sum("weight").alias("weight")), f"bins{level}")
    return items.select("component", "bin"), full.select("bin", "weight")


def grouped_split(records: DataFrame, shares: dict[str, float], *, keys: list[str] | None = None, links: DataFrame | None = None, bins: int = BINS) -> DataFrame:
    """``id, component, split, stored, torn boolean``: a new split for every record, the same within a component.

    ``records``: ``id bigint``, a text for each of ``keys`` (by default one, ``group``), ``stored string``, ``classes
    array<int>``, a row for each record; other columns are ignored. Records with the same text under a key are related,
    and those that ``links`` (``a bigint, b bigint``) names; a null or empty text relates none, and links of unknown
    records only what they connect. ``component`` is the least id of what is related in any number of steps. ``stored``
    is the split a record has so far, null if none; ``torn`` tells whether its component has records of more than one.

    Shares add up to 1 and are kept to within a bin, unless a component is larger than a share, which its split then
    exceeds. A class is in every split unless it has fewer components than there are splits, or those were needed for
    scarcer classes. Null ``classes`` is none; rows alike count once, and so does an id with several rows, in all its
    components, classes and stored splits. Empty tables give empty ones. Any number of records may share a text.
    """
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    keys = keys or ["group"]
    scratch = Scratch(records.sparkSession, "groupsplit")
    rows = records.where("id is not null").select("id", *(F.col(k).alias(f"key{i}") for i, k in enumerate(keys)), "stored", "classes")
    rows = scratch.write(rows.distinct(), "records")
    related = links.select("a", "b") if links is not None else None
    for i in range(len(keys)):
        star = star_links(rows.select("id", F.when(F.col(f"key{i}") != "", F.col(f"key{i}")).alias(f"key{i}")), [f"key{i}"], "id", scratch)
        related = star if related is None else related.unionByName(star)
    found = connected_components(related)
    of = rows.select("id", "stored", "classes").join(found.select(F.col("node").alias("id"), "component"), "id", "left")
    of = scratch.write(of.withColumn("component", F.coalesce("component", "id")), "components")

    weighed = of.groupBy("component").agg(F.countDistinct("id").alias("weight"), F.coalesce(F.min("stored") != F.max("stored"), F.lit(False)).alias("torn"))
    parts = scratch.write(weighed, "weights")
    classes = of.select("component", F.explode("classes").alias("class")).where("class is not null").distinct()
    placed = _placed_beforehand(parts.select("component", "weight"), classes, shares)

    free = parts.where(~F.col("component").isin(list(placed))) if placed else parts
    dealt, full = _dealt(free, bins, scratch)
    full = full.orderBy("bin").collect()
    filled = {s: sum(w for t, w in placed.values() if t == s) for s in shares}
    allotted = allot([r["weight"] for r in full], shares, filled)
    # No more than so many bins: a list of them is a literal.
    split = F.element_at(F.create_map(*(F.lit(x) for r, s in zip(full, allotted, strict=True) for x in (r["bin"], s))), F.col("bin")) if full else F.lit(None).cast("string")
    where = dealt.select("component", split.alias("split"))
    if placed:
        where = where.unionByName(records.sparkSession.createDataFrame([(c, s) for c, (s, _) in placed.items()], "component bigint, split string"))
    where = scratch.write(where.join(parts.select("component", "torn"), "component"), "placed")
    return lookup_join(of, where, "component", rows=of.count()).select("id", "component", "split", "stored", "torn").distinct()
