"""Items of varying length in containers of fixed capacity.

Method: hierarchical multi-length packing. Items are routed to tiers of context sizes (an eighth, a quarter, half of the
capacity and the whole), each to the shortest that holds it. Tiers are packed one by one from the longest: what is left
of a tier's items goes into windows of its context size, as many of which make a container as fit in. Gaps of the
windows of longer tiers are filled from the shorter ones, the longest items first, each into the tightest gap that takes
it. The shortest tier has several items in a window and fills its own gaps too. Containers are dealt to step groups so
that all steps hold nearly the same number of tokens.

Where the shorter tiers hold too little to fill the gaps of a tier, its own items may fill them as well. That is settled
beforehand: the plan is made with every choice of tiers that fill their own gaps, and the one with the fewest
containers is taken, of equal ones that with the fewest such tiers.

Lengths are whole numbers up to the capacity, so a plan is made from the counts of each length alone: at most
``capacity`` numbers, whatever the number of items. It maps ranges of the items of one length to ranges of containers;
items get their rank within their length in parallel and look their container up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.scratch import Scratch

#: Context sizes of the tiers below the longest, as parts of the capacity.
TIERS = (8, 4, 2)
#: Items of one length are ranked in parts of so many items on average.
PART_ROWS = 100_000


@dataclass
class Plan:
    """Ranges of items (length, from rank, number, from container), and of containers (first, number, free room)."""

    capacity: int
    placed: list[tuple[int, int, int, int]] = field(default_factory=list)
    containers: int = 0
    rooms: list[tuple[int, int, int]] = field(default_factory=list)
    #: Containers opened by each tier, from the longest: (first, number, tier).
    opened: list[tuple[int, int, int]] = field(default_factory=list)


class Gaps:
    """Ranges of containers by the room they have left."""

    def __init__(self) -> None:
        self.ranges: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []  # those that have ranges, in order

    def put(self, room: int, first: int, n: int) -> None:
        if room not in self.ranges:
            self.ranges[room] = []
            insort(self.sizes, room)
        self.ranges[room].append((first, n))

    def take(self, length: int, most: int) -> tuple[int, int, int] | None:
        """(room, first, number) of at most so many containers with the tightest gap for the length, now taken out."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        first, n = self.ranges[room].pop()
        if n > most:
            self.ranges[room].append((first + most, n - most))
            n = most
        if not self.ranges[room]:
            del self.ranges[room], self.sizes[at]
        return room, first, n


def contexts(capacity: int, tiers: tuple[int, ...] = TIERS) -> list[int]:
    """The context sizes, the shortest first; parts that come to nothing or to one size are left out."""
    return sorted({capacity // part for part in (*tiers, 1)} - {0})


def _plan(counts: dict[int, int], capacity: int, sizes: list[int], own: frozenset[int]) -> Plan:
    """The plan in which the tiers ``own`` fill their own gaps too."""
    plan, gaps = Plan(capacity), Gaps()
    routed: list[list[int]] = [[] for _ in sizes]
    for length in sorted(counts, reverse=True):
        if counts[length]:
            routed[bisect_left(sizes, length)].append(length)
    for tier in range(len(sizes) - 1, -1, -1):
        begin, windows = plan.containers, capacity // sizes[tier]
        fills = tier == 0 or tier in own
        closed: list[tuple[int, int, int]] = []  # this tier's containers (room, first, number), for the shorter tiers
        first_open, free, room_open = -1, 0, 0  # a container with windows still free
        for length in routed[tier]:
            rank, todo = 0, counts[length]

            def place(n: int, first: int, length: int = length) -> None:
                nonlocal rank, todo
                plan.placed.append((length, rank, n, first))
                rank, todo = rank + n, todo - n

            while todo and (gap := gaps.take(length, todo)):
                room, first, n = gap
                place(n, first)
                gaps.put(room - length, first, n)
            if fills:
                # Windows of the shortest tier hold what fits; a container is filled with one length and then with others.
                while todo:
                    each = min(capacity // length, todo)
                    n, first = todo // each, plan.containers
                    plan.containers += n
                    for _ in range(each):
                        place(n, first)
                    gaps.put(capacity - each * length, first, n)
                continue
            while todo and free:
                place(1, first_open)
                free, room_open = free - 1, room_open - length
            if n := todo // windows:
                first = plan.containers
                plan.containers += n
                for _ in range(windows):
                    place(n, first)
                closed.append((capacity - windows * length, first, n))
            if todo:
                if first_open >= 0:
                    closed.append((room_open, first_open, 1))
                first_open, free, room_open = plan.containers, windows, capacity
                plan.containers += 1
                while todo:
                    place(1, first_open)
                    free, room_open = free - 1, room_open - length
        if first_open >= 0:
            closed.append((room_open, first_open, 1))
        for room, first, n in closed:
            gaps.put(room, first, n)
        if plan.containers > begin:
            plan.opened.append((begin, plan.containers - begin, tier))
    plan.rooms = sorted((first, n, room) for room, ranges in gaps.ranges.items() for first, n in ranges)
    return plan


def make_plan(counts: dict[int, int], capacity: int, tiers: tuple[int, ...] = TIERS) -> Plan:
    """The plan with the fewest containers among those in which some tiers, as few as may be, fill their own gaps."""
    sizes = contexts(capacity, tiers)
    longer = range(1, len(sizes))
    plans = [_plan(counts, capacity, sizes, frozenset(own)) for k in range(len(sizes)) for own in combinations(longer, k)]
    return min(plans, key=lambda p: p.containers)


def step_groups(plan: Plan, size: int) -> list[tuple[int, int, int]]:
    """Ranges of containers (first, number, position of the first): positions order containers by falling load, so
    that dealing them out in turns gives all steps of ``size`` containers nearly equal loads."""
    out, at = [], 0
    for first, n, _ in sorted(plan.rooms, key=lambda r: (r[2], r[0])):
        out.append((first, n, at))
        at += n
    return sorted(out)


def pack(sizes: DataFrame, capacity: int = 2048, *, step: int = 64, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """``id, piece, first_unit, units, container, tier, context, step``: a row for each item, or each piece of a longer
    one.

    ``sizes``: ``id bigint, units bigint``; other columns are ignored. An item of more than ``capacity`` units is cut
    into whole containers and one rest (``piece`` counts from 0, ``first_unit`` is where the piece begins); no other
    item is cut. Containers count from 0. ``tier`` is the tier the piece was routed to, 0 the shortest; ``context`` the
    context size of the tier that opened its container; ``step`` the step group of its container, each of ``step``
    containers but for the rounding. Null ids or units and units below 1 are no items. A repeated id is packed as often
    as it occurs. An empty table gives an empty one. Any number of items may have one length: counts combine before the
    shuffle, and ranks are worked out in parts.

    What reaches the driver are the counts of at most ``capacity`` lengths; what is sent to the tasks are the plan's
    ranges: a range is used up, or a length, by each, so there are at most a few for each length.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "packing")
    rows = sizes.where("id is not null and units >= 1").select("id", F.col("units").cast("bigint").alias("total"))
    last = F.expr(f"(total - 1) div {capacity}")
    rows = rows.select("id", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    units = F.least(F.col("total") - F.col("piece") * capacity, F.lit(capacity)).cast("int")
    rows = scratch.write(rows.select("id", F.col("piece").cast("int").alias("piece"), units.alias("units")), "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("units").agg(F.count(F.lit(1))).collect()}
    plan = make_plan(counts, capacity, tiers)
    steps = max(1, -(-plan.containers // step))

    # Items of one length are ranked in parts, as many as the length needs; parts of a length follow one another.
    parts = F.element_at(F.lit([1 + counts.get(n, 0) // PART_ROWS for n in range(1, capacity + 1)]), F.col("units"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece"), parts.cast("bigint")).cast("int"))
    before = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("units", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = scratch.write(offsets.select("units", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")

    placed = sorted(plan.placed)
    length, rank, _, first = _columns(placed, 4)
    g_first, _, g_at = _columns(step_groups(plan, step), 3)
    o_first, _, o_tier = _columns(plan.opened, 3)
    context = np.array(contexts(capacity, tiers), np.int64)
    base = np.zeros(capacity + 2, np.int64)
    base[1:] = np.cumsum([counts.get(n, 0) for n in range(capacity + 1)])
    # Ranks of all lengths in one line, so that one search finds the range.
    line = base[length] + rank
    sent = spark.sparkContext.broadcast((line, rank, first, base, g_first, g_at, o_first, o_tier, context))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, rank, first, base, g_first, g_at, o_first, o_tier, context = sent.value
        for batch in batches:
            units = batch.column("units").to_numpy().astype(np.int64)
            mine = batch.column("rank").to_numpy()
            at = np.searchsorted(line, base[units] + mine, side="right") - 1
            container = first[at] + mine - rank[at]
            g = np.searchsorted(g_first, container, side="right") - 1
            turn, seat = np.divmod(g_at[g] + container - g_first[g], steps)
            group = np.where(turn % 2, steps - 1 - seat, seat)  # back and forth, so that no step is always first
            piece = batch.column("piece").to_numpy().astype(np.int64)
            tier = np.searchsorted(context, units).astype(np.int32)
            window = context[o_tier[np.searchsorted(o_first, container, side="right") - 1]].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("piece"), pa.array(piece * capacity), batch.column("units"), pa.array(container), pa.array(tier), pa.array(window), pa.array(group)],
                ["id", "piece", "first_unit", "units", "container", "tier", "context", "step"],
            )

    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("units", "part").orderBy("id", "piece")))
    ranked = ranked.join(offsets, ["units", "part"])
    ranked = ranked.select("id", "piece", "units", (F.col("before") + F.col("rn") - 1).cast("bigint").alias("rank"))
    return ranked.mapInArrow(place, "id bigint, piece int, first_unit bigint, units int, container bigint, tier int, context int, step bigint")


def _columns(rows: list[tuple], n: int) -> list[np.ndarray]:
    return [np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [[]] * n)]
