"""Exact and near duplicates."""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.hashes import hamming
from lodestone.operators.rows import lookup_join


def exact_clusters(df: DataFrame, key: str, path: str, class_id: str) -> DataFrame:
    """``key, n, first_path, class_conflict`` of every value that several rows share; null values share nothing.

    Members aren't gathered: :func:`exact_members` names the cluster of each row.
    """
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(path).alias("first_path"), (F.min(class_id) != F.max(class_id)).alias("class_conflict")
    )
    return g.where("n > 1").withColumn("class_conflict", F.coalesce("class_conflict", F.lit(False)))


def exact_members(df: DataFrame, key: str, path: str, class_id: str) -> DataFrame:
    """``key, path, n, first_path``: the rows of the clusters."""
    clusters = exact_clusters(df, key, path, class_id).select(key, "n", "first_path")
    return lookup_join(df.where(F.col(key).isNotNull()).select(key, F.col(path).alias("path")), clusters, key)


def representatives(df: DataFrame, key: str, path: str) -> DataFrame:
    """The row with the least path of every key; null keys aren't compared, each such row stays."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(path))
    return df.where(F.col(key).isNotNull()).withColumn("__rank", rank).where("__rank = 1").drop("__rank").unionByName(df.where(F.col(key).isNull()))


def _bands(bits: int, m: int) -> list[tuple[int, int]]:
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def band_keys(h: Column, d: int, m: int) -> Column:
    """Keys of a 64-bit hash: one for each choice of m - d of m bands. Hashes that differ in at most d bits share one."""
    parts = [F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in _bands(64, m)]
    return F.array(*(F.xxhash64(F.lit(i), *(parts[b] for b in chosen)) for i, chosen in enumerate(combinations(range(m), m - d))))


def choose_bands(n: int, d: int) -> int:
    """The number of bands for which keys written plus pairs expected among n random hashes is least."""
    return min(range(max(2, d + 1), 2 * d + 4), key=lambda m: comb(m, d) * (n + n * n / 2 ** ((m - d) * (64 // m) + 1)))


def hamming_pairs(hashes: DataFrame, h: str, d: int, m: int | None = None) -> DataFrame:
    """``a, b, distance``: every two different values of ``h`` that differ in at most d of 64 bits, once.

    Banded equi-join instead of comparing all with all: of m bands, at least m - d agree, so hashes meet under one of
    their :func:`band_keys`. Every distance is then counted, so m changes the cost only; by default it grows with the
    number of hashes, so that the pairs that meet by chance stay in proportion to them. Equal hashes fall together
    before the join, however many rows share one; skewed keys are left to adaptive execution, which splits them.
    """
    values = hashes.where(F.col(h).isNotNull()).select(F.col(h).alias("v")).distinct()
    m = m or choose_bands(values.count(), d)
    keyed = values.select("v", F.explode(band_keys(F.col("v"), d, m)).alias("key"))
    a, b = keyed.select("key", F.col("v").alias("a")), keyed.select("key", F.col("v").alias("b"))
    near = a.join(b, "key").where((F.col("a") < F.col("b")) & (hamming("a", "b") <= d))
    return near.select("a", "b").distinct().withColumn("distance", hamming("a", "b"))


def near_duplicates(images: DataFrame, d: int) -> DataFrame:
    """``a, b, distance, path_a, path_b, pairs``: the near duplicates among images, in a row for each two hashes.

    ``images``: ``path, sha256, hash bigint``, a row for each image. Two images are near duplicates if their hashes
    differ in at most d bits, none included, and their bytes are not the same: equal ``sha256`` are exact duplicates,
    reported elsewhere; null ones are equal to none but one another. Images of one hash are a class
    (:func:`near_members` names it for each image), so copies aren't expanded: a row stands for ``pairs`` pairs of
    images and names the first path of each hash. A row of one hash (distance 0) names its first path and the first with
    other bytes.
    Null hashes and paths are left out.
    """
    rows = images.where("hash is not null and path is not null").select("hash", F.coalesce("sha256", F.lit("")).alias("sha"), "path")
    held = rows.groupBy("hash", "sha").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("path", "sha"))
    two = held.withColumn("rank", rank).where("rank <= 2").groupBy("hash").agg(F.min("path").alias("first"), F.max("path").alias("second"))
    sizes = held.groupBy("hash").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("same"), F.count(F.lit(1)).alias("kinds"))
    classes = sizes.join(two, "hash")
    inside = classes.where("kinds > 1").select(
        F.col("hash").alias("a"), F.col("hash").alias("b"), F.lit(0).alias("distance"), F.col("first").alias("path_a"), F.col("second").alias("path_b"),
        ((F.col("n") * (F.col("n") - 1) / 2).cast("bigint") - F.col("same")).alias("pairs"),
    )
    near = hamming_pairs(rows, "hash", d)
    # Images with the same bytes under two hashes are exact duplicates too.
    both = near.join(held.select(F.col("hash").alias("a"), "sha", F.col("n").alias("na")), "a").join(held.select(F.col("hash").alias("b"), "sha", F.col("n").alias("nb")), ["b", "sha"])
    both = both.groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("same"))
    for x in ("a", "b"):
        near = near.join(classes.select(F.col("hash").alias(x), F.col("first").alias(f"path_{x}"), F.col("n").alias(f"n{x}")), x)
    near = near.join(both, ["a", "b"], "left").withColumn("pairs", F.col("na") * F.col("nb") - F.coalesce("same", F.lit(0)))
    return inside.unionByName(near.select("a", "b", "distance", "path_a", "path_b", "pairs").where("pairs > 0"))


def near_members(images: DataFrame) -> DataFrame:
    """``path, sha256, hash, first_path, n``: the class of each image, by the first path of its hash, and its size."""
    rows = images.where("hash is not null and path is not null").select("path", "sha256", "hash")
    classes = rows.groupBy("hash").agg(F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n"))
    return lookup_join(rows, classes, "hash").select("path", "sha256", "hash", "first_path", "n")


def bounded_pairs(pairs: DataFrame, limit: int, order: list[str], count: Column | None = None) -> DataFrame:
    """The first pairs of a report that is bounded by design, beside ``total`` (of ``count``, by default of the rows) and
    ``truncated``, whether rows are left out."""
    total = pairs.agg(F.coalesce(F.sum(count), F.lit(0)).alias("total") if count is not None else F.count(F.lit(1)).alias("total"), F.count(F.lit(1)).alias("__rows"))
    return pairs.orderBy(*order).limit(limit).crossJoin(F.broadcast(total)).withColumn("truncated", F.col("__rows") > limit).drop("__rows")
