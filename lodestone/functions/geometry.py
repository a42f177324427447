"""Boxes as structs ``x, y, w, h`` in parts of the image, and the geometry around them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.let import let


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def _overlap(a: Column, b: Column) -> Column:
    wide = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    high = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 if the union isn't positive."""
    # Without overlap nothing needs dividing, and most pairs of boxes don't overlap.
    areas = a["w"] * a["h"] + b["w"] * b["h"]
    return let(_overlap(a, b), lambda shared: F.when((shared > 0) & (areas - shared > 0), shared / (areas - shared)).otherwise(0.0))


def iou_corners(a: Column, b: Column) -> tuple[Column, Column]:
    """IoU and containment (overlap over the smaller area) of arrays ``x1, y1, x2, y2`` in pixels, each with 1e-9 added
    below the line; unlike :func:`iou`, which has no such guard."""

    def area(r: Column) -> Column:
        return (r[2] - r[0]) * (r[3] - r[1])

    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    shared = wide * high
    return shared / (area(a) + area(b) - shared + 1e-9), shared / (F.least(area(a), area(b)) + 1e-9)


def half_up(c: Column) -> Column:
    """floor(c + 0.5); Spark's round differs for values just below a half."""
    return F.floor(c + 0.5)


def letterbox(width: Column, height: Column, size: int = 416) -> Column:
    """``scale, width, height, left, top``: an image fitted into a square, with its padding on the left and the top."""
    scale = F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)
    w = F.greatest(F.lit(1), half_up(width * scale)).cast("int")
    h = F.greatest(F.lit(1), half_up(height * scale)).cast("int")
    half = lambda n: F.floor((F.lit(size) - n) / 2).cast("int")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), half(w).alias("left"), half(h).alias("top"))


def padded_crop(b: Column, width: Column, height: Column, margin: float = 0.1) -> Column:
    """``left, top, right, bottom`` in pixels: a box with a margin of its own size around it, widened to whole pixels
    and kept inside the image; null if nothing is left."""
    left = F.greatest(F.floor((b["x"] - b["w"] * margin) * width), F.lit(0)).cast("int")
    top = F.greatest(F.floor((b["y"] - b["h"] * margin) * height), F.lit(0)).cast("int")
    right = F.least(F.ceil((b["x"] + b["w"] * (1 + margin)) * width), width).cast("int")
    bottom = F.least(F.ceil((b["y"] + b["h"] * (1 + margin)) * height), height).cast("int")
    crop = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((right > left) & (bottom > top), crop)


def fit_preview(frame_ratio: Column, container_ratio: Column) -> Column:
    """``width, height`` in percent of a container that a frame of another ratio fills as far as it can."""
    wider = frame_ratio >= container_ratio
    return F.struct(
        F.when(wider, 100.0).otherwise(frame_ratio / container_ratio * 100).alias("width"),
        F.when(wider, container_ratio / frame_ratio * 100).otherwise(100.0).alias("height"),
    )


def box_inside(b: Column, tolerance: float = 1e-9) -> Column:
    """Whether an array of four numbers is a box of positive size within the image."""
    finite = F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = finite & (b[0] >= 0) & (b[1] >= 0) & (b[2] > 0) & (b[3] > 0) & (b[0] + b[2] <= 1 + tolerance) & (b[1] + b[3] <= 1 + tolerance)
    return F.when(b.isNotNull() & (F.size(b) == 4), F.coalesce(good, F.lit(False))).otherwise(False)


def label_line(class_id: Column | int, b: Column) -> Column:
    """``class cx cy w h`` with nine decimals, from an array ``x, y, w, h``."""
    cls = F.lit(class_id) if isinstance(class_id, int) else class_id
    return F.format_string("%d %.9f %.9f %.9f %.9f", cls, b[0] + b[2] / 2, b[1] + b[3] / 2, b[2], b[3])
