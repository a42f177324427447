"""Hashes and tensors of pixels that are already decoded: arrays of rows, or bytes of RGB."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference_hash(gray: Column) -> Column:
    """64 bits of an 8 by 9 grey image (8 rows of 9): a bit for each pixel brighter than its right neighbour, row by
    row, the first in the highest bit. Null unless the image has this shape."""
    bits = F.flatten(F.transform(gray, lambda row: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.get(row, i) > F.get(row, i + 1)).cast("bigint"))))
    word = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    shaped = (F.size(gray) == 8) & F.forall(gray, lambda row: F.size(row) == 9)
    return F.when(shaped, word)


def pixel_digest(width: Column, height: Column, rgb: Column) -> Column:
    """SHA-256 over ``RGB:width:height:`` and the pixels' bytes."""
    head = F.encode(F.concat_ws(":", F.lit("RGB"), width.cast("string"), height.cast("string"), F.lit("")), "UTF-8")
    return F.sha2(F.concat(head, rgb), 256)


def bgr_to_rgb(data: Column) -> Column:
    """The bytes of an image source's row, whose channels come in the order blue, green, red."""
    digits = F.hex(data)
    return F.unhex(F.regexp_replace(digits, "(..)(..)(..)", "$3$2$1"))


def normalized_tensor(rgb: Column, mean: tuple[float, float, float], deviation: tuple[float, float, float]) -> Column:
    """Rows of ``[r, g, b]`` in 0..255 as three planes of ``(value / 255 - mean) / deviation`` in single precision."""

    def plane(c: int) -> Column:
        return F.transform(rgb, lambda p: ((F.get(p, F.lit(c)) / 255.0 - mean[c]) / deviation[c]).cast("float"))

    return F.array(*(plane(c) for c in range(3)))


def largest_error(a: Column, b: Column) -> Column:
    """The greatest difference of two arrays of numbers, place by place; null if their lengths differ."""
    return F.when(F.size(a) == F.size(b), F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


def backdrop_alpha(rgb: Column) -> Column:
    """The opacity of pixels ``[r, g, b]`` before a blue backdrop: 255, less 16 for each step by which blue exceeds the
    mean of red and green by more than 4; from 0 to 255, halves to the even number. A null among them gives null."""
    blue = rgb[2] - (rgb[0] + rgb[1]) / F.lit(2.0) - 4
    return F.when(blue.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), F.bround(255 - F.greatest(blue, F.lit(0.0)) * 16).cast("int"))))
