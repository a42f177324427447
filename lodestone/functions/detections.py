"""Detections of one frame as arrays of structs: suppression, matching and selection as higher-order functions.

These algorithms depend on order. It is made explicit by sorting, and state passes through ``aggregate``, so that
nothing is shuffled and no Python runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.geometry import iou, iou_corners

#: Fixed values of the protocol: candidates before suppression, boxes after it, objects of a frame, overlap of a match.
CANDIDATES, SURVIVORS, OBJECTS, MATCH_IOU = 300, 30, 5, 0.5
DETECTION = "struct<box:struct<x:double,y:double,w:double,h:double>,score:double,anchor:int,logits:array<double>>"


def ranked(dets: Column, score: Column | float, limit: int = CANDIDATES) -> Column:
    """The best valid detections of at least a score, by falling score and rising anchor."""
    good = F.filter(dets, lambda d: d["score"].isNotNull() & ~F.isnan(d["score"]) & (d["score"] >= score) & (d["score"] <= 1.0))
    order = F.array_sort(F.transform(good, lambda d: F.struct((0.0 - d["score"]).alias("s"), d["anchor"].alias("a"), d.alias("d"))))
    return F.transform(F.slice(order, 1, limit), lambda r: r["d"])


def suppress(dets: Column, score: Column | float, overlap: Column | float, limit: int = SURVIVORS) -> Column:
    """Greedy non-maximum suppression: a box stays unless one that stayed overlaps it by more than ``overlap``."""

    def step(kept: Column, d: Column) -> Column:
        out = (F.size(kept) >= limit) | F.exists(kept, lambda k: iou(k["box"], d["box"]) > overlap)
        return F.when(out, kept).otherwise(F.concat(kept, F.array(d)))

    return F.aggregate(ranked(dets, score), F.array().cast(f"array<{DETECTION}>"), step)


def match(dets: Column, truth: Column, least: float = MATCH_IOU) -> Column:
    """For each detection, in order, the position of the free truth it overlaps most, by at least ``least``, else -1.

    Of equal overlaps the first truth is taken; a taken truth is free no more. Classes play no part.
    """

    def step(taken: Column, d: Column) -> Column:
        near = F.transform(truth, lambda t, i: F.struct(iou(d["box"], t["box"]).alias("iou"), (-i).alias("back")))
        free = F.filter(near, lambda n: (n["iou"] >= least) & ~F.array_contains(taken, -n["back"]))
        return F.concat(taken, F.array(F.coalesce(-F.array_max(free)["back"], F.lit(-1))))

    # Most frames have no truth: nothing needs to be folded there.
    none = F.transform(dets, lambda _: F.lit(-1))
    return F.when(F.size(truth) == 0, none).otherwise(F.aggregate(dets, F.array().cast("array<int>"), step))


def reachable(dets: Column, scores: Sequence[float], overlaps: Sequence[float]) -> Column:
    """Anchors among the first objects that survive under any of the thresholds: all that need to be classified.

    Under a higher score the objects are those of the lowest without the weaker ones, so the lowest alone decides.
    """
    kept = [F.transform(suppress(dets, F.lit(float(min(scores))), F.lit(float(o)), OBJECTS), lambda d: d["anchor"]) for o in overlaps]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*kept))))


def decode(tensor: Column, geometry: Column, score: float) -> Column:
    """Detections of a detector's output ``[cx[], cy[], w[], h[], score[]]`` on a letterboxed square.

    Candidates below the score or without size are left out; boxes are taken back to the image, clamped to it and
    dropped if nothing is left; the best come first. Non-finite numbers and scores outside 0..1 are errors and give
    null for the whole frame.
    """
    row = lambda i: F.get(tensor, F.lit(i))
    n = F.size(row(4))
    ok = (F.size(tensor) == 5) & F.forall(F.flatten(tensor), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ok = ok & F.forall(row(4), lambda s: (s >= 0) & (s <= 1))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    good = F.filter(at, lambda i: (F.get(row(4), i) >= score) & (F.get(row(2), i) > 0) & (F.get(row(3), i) > 0))

    def one(i: Column) -> Column:
        unit = lambda v, pad, full: F.least(F.greatest((v - pad) / full, F.lit(0.0)), F.lit(1.0))
        cx, cy, w, h = (F.get(row(k), i).cast("double") for k in range(4))
        x1, x2 = (unit(cx + s * w / 2, geometry["left"], geometry["width"]) for s in (-1, 1))
        y1, y2 = (unit(cy + s * h / 2, geometry["top"], geometry["height"]) for s in (-1, 1))
        b = F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))
        return F.struct(b.alias("box"), F.get(row(4), i).cast("double").alias("score"), i.alias("anchor"), F.lit(None).cast("array<double>").alias("logits"))

    boxes = F.filter(F.transform(good, one), lambda d: (d["box"]["w"] > 0) & (d["box"]["h"] > 0))
    return F.when(ok, ranked(boxes, F.lit(score)))


def select_boxes(candidates: Column, width: Column, height: Column, *, sure: float = 0.3, of_best: float = 0.5, least: float = 0.1, most: int = OBJECTS) -> Column:
    """``mode, boxes``: the boxes worth labelling among ``struct<score, xyxy>`` in pixels.

    Best first, in their order where scores tie. Nothing if the best is below ``least``. A box must reach ``sure``
    and ``of_best`` times the best score, apart from the first kept; one smaller than 3 % of a side is skipped; one that
    overlaps a kept box (IoU above 0.5, or more than 0.85 of the smaller inside) too. Kept boxes are rounded to six
    decimals of the image and then kept inside it. Mode: confident if the best reaches ``sure``, else
    fallback.
    """
    order = F.array_sort(F.transform(candidates, lambda c, i: F.struct((0.0 - c["score"]).alias("s"), i.alias("i"), c["xyxy"].alias("r"))))
    best = 0.0 - F.get(order, F.lit(0))["s"]
    enough = F.greatest(F.lit(sure), best * of_best)
    state = "struct<kept:array<array<double>>,stop:boolean>"

    def clamp(r: Column) -> Column:
        return F.array(*(F.least(F.greatest(r[i].cast("double"), F.lit(0.0)), full.cast("double")) for i, full in enumerate((width, height, width, height))))

    def step(acc: Column, c: Column) -> Column:
        r = clamp(c["r"])
        small = (r[2] - r[0] < 0.03 * width) | (r[3] - r[1] < 0.03 * height)
        low = (F.size(acc["kept"]) > 0) & (0.0 - c["s"] < enough)

        def covers(k: Column) -> Column:
            overlap, inside = iou_corners(k, r)
            return (overlap > 0.5) | (inside > 0.85)

        full = F.size(acc["kept"]) >= most
        keep = F.when(F.exists(acc["kept"], covers), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(r)))
        new = F.struct(keep.alias("kept"), F.lit(False).alias("stop"))
        stop = F.struct(acc["kept"].alias("kept"), F.lit(True).alias("stop"))
        return F.when(acc["stop"] | full | small, acc).when(low, stop).otherwise(new)

    start = F.struct(F.array().cast("array<array<double>>").alias("kept"), F.lit(False).alias("stop")).cast(state)
    kept = F.aggregate(order, start, step)["kept"]

    def unit(r: Column) -> Column:
        six = lambda v: F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)), 6)
        x, y = six(r[0] / width), six(r[1] / height)
        return F.array(x, y, F.least(six((r[2] - r[0]) / width), 1 - x), F.least(six((r[3] - r[1]) / height), 1 - y))

    none = F.coalesce(best < least, F.lit(True))
    return F.struct(
        F.when(none, "none").when(best >= sure, "confident").otherwise("fallback").alias("mode"),
        F.when(none, F.array().cast("array<array<double>>")).otherwise(F.transform(kept, unit)).alias("boxes"),
    )
