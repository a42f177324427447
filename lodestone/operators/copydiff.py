"""Differences between two copies of a table.

Method: column-by-bucket checksum matrix. Keys are hashed into buckets; for each bucket and column the wide hashes of
all cells are added up. Sums don't depend on order or partitioning and combine before the shuffle, so of the rows
nothing but the matrices travels. Where they agree, the copies agree. There are two levels: coarse buckets over all
rows, then fine ones over the rows of unequal coarse buckets. Only the rows of unequal fine buckets, and of these only
the columns that are unequal there, are read and joined.

A sum can't tell which of several rows with one key is the current one. So keys with several rows on a side, found by
their hashes alone, stay out of the matrices; their rows are read in any case, and their current rows compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.rows import current_rows, lookup_join
from lodestone.scratch import Scratch

#: Rows of a coarse and of a fine bucket, on average: larger ones make the matrices smaller and what is read larger.
COARSE_ROWS, FINE_ROWS = 32, 4
#: Most coarse buckets, so that the unequal ones, eight bytes each, can be sent to all tasks.
COARSE_BUCKETS = 1 << 20


def _bits(rows: int, buckets: int) -> int:
    """Bits of one part of a hash, so that the sums of a bucket can't overflow: it has far fewer rows than reckoned with."""
    return 63 - (8 * rows // buckets + 1024).bit_length()


def _cell(column: Column, name: str, key: Column, bits: int) -> list[Column]:
    """A cell's hash as two parts of so many bits. Names are part of it, so that swapped columns differ."""
    hashes = (F.xxhash64(F.lit(f"{salt}:{name}"), key, column.isNull(), column) for salt in ("a", "b"))
    return [F.shiftrightunsigned(h, 64 - bits) for h in hashes]


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key; a number of buckets that is a multiple of another divides its buckets."""
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col(key)), F.lit(buckets))


def checksum_matrix(df: DataFrame, key: str, fields: list[str], buckets: int, bits: int = 32) -> DataFrame:
    """``bucket``, ``n`` and for each of the key and the fields (m0, m1, ...) an array of two sums."""
    sums = []
    for i, c in enumerate([key, *fields]):
        sums.append(F.array(*(F.sum(p) for p in _cell(F.col(c), c, F.col(key), bits))).alias(f"m{i}"))
    return df.groupBy(bucket_of(key, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *sums)


def unequal_cells(left: DataFrame, right: DataFrame, key: str, fields: list[str], buckets: int, bits: int = 32) -> DataFrame:
    """``bucket`` and ``columns``, the numbers of its unequal columns (0: its keys, 1: the first field); equal buckets are
    left out."""
    a, b = (checksum_matrix(df, key, fields, buckets, bits) for df in (left, right))
    joined = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer")
    unequal = [F.when(~F.col(f"a.m{i}").eqNullSafe(F.col(f"b.m{i}")), F.lit(i)) for i in range(len(fields) + 1)]
    return joined.select(F.coalesce("a.bucket", "b.bucket").alias("bucket"), F.array_compact(F.array(*unequal)).alias("columns")).where("size(columns) > 0")


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: list[str],
    *,
    left_order: str,
    right_order: str,
    missing_in_left: str = "missing_in_left",
    missing_in_right: str = "missing_in_right",
    names: dict[str, str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """``key, difference``: a row for each key on one side only and for each field of a common key that disagrees.

    ``names`` gives the value of ``difference`` for a field, by default its name. Both sides keep the current row of
    each key (highest order; ties and repeated rows as in :func:`current_rows`). Null equals null and differs from any
    value; an empty string is a value. Rows with a null key belong to no file and are left out. Extra columns are
    ignored, whatever their names. Two empty tables give an empty result; one empty table makes all keys missing there.
    A key may have any number of copies (they combine before the shuffle), and buckets hash keys, so none is hot.
    There may be any number of fields. ``buckets``: of the coarse ones.

    Each side is read once and written as given, without a shuffle; the passes read that.
    """
    scratch = Scratch(left.sparkSession, "copydiff")
    names = names or {}
    work = [f"f{i}" for i in range(len(fields))]  # whatever the names, they can't clash
    sides = []
    for name, df, order in (("left", left, left_order), ("right", right, right_order)):
        rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(order).alias("noted"), *(F.col(f).alias(w) for f, w in zip(fields, work, strict=True)))
        sides.append(scratch.write(rows, name))
    n = max(s.count() for s in sides)
    coarse = buckets or min(COARSE_BUCKETS, max(1, n // COARSE_ROWS))
    fine = coarse * max(1, -(-n // (coarse * FINE_ROWS)))

    # Hashes of the keys with several rows on a side. Another key with such a hash is merely read too. Looked up so that
    # a key with very many rows holds up no task.
    several = [s.groupBy(F.xxhash64("key").alias("hash")).count().where("count > 1").select("hash") for s in sides]
    several = scratch.write(several[0].unionByName(several[1]).distinct().withColumn("several", F.lit(True)), "several")
    marked = [lookup_join(s.withColumn("hash", F.xxhash64("key")), several, "hash", "left", rows=s.count()) for s in sides]
    single = [s.where("several is null") for s in marked]

    first = scratch.write(unequal_cells(*single, "key", work, coarse, _bits(n, coarse)).select(F.col("bucket").alias("coarse")), "coarse")
    # No more than COARSE_BUCKETS rows, unless the caller asked for more.
    first = F.broadcast(first) if coarse <= COARSE_BUCKETS else first
    suspect = [s.join(first, bucket_of("key", coarse) == F.col("coarse"), "left_semi") for s in single]
    unequal = scratch.write(unequal_cells(*suspect, "key", work, fine, _bits(n, fine)), "unequal")
    # A number for each column that is unequal in some bucket. No other is read again.
    found = {r[0] for r in unequal.select(F.explode("columns")).distinct().collect()}
    wanted = [w for i, w in enumerate(work) if i + 1 in found]

    def struct(columns: list[Column], mark: str) -> Column:
        return F.struct(*columns, F.lit(True).alias("here")).alias(mark)

    def reread(side: DataFrame, mark: str) -> DataFrame:
        """The rows of unequal buckets, with null for what is equal there."""
        rows = side.select("key", *wanted).join(unequal, bucket_of("key", fine) == F.col("bucket"))
        return rows.select("key", struct([F.when(F.array_contains("columns", int(w[1:]) + 1), F.col(w)).alias(w) for w in wanted], mark))

    def current(side: DataFrame, mark: str) -> DataFrame:
        rows = current_rows(side.where("several"), ["key"], "noted", work)
        return rows.select("key", struct([F.col(w) for w in work], mark))

    def differences(a: DataFrame, b: DataFrame, compared: list[str]) -> DataFrame:
        both = a.join(b, "key", "full_outer")
        differs = [F.when(~F.col(f"l.{w}").eqNullSafe(F.col(f"r.{w}")), F.lit(names.get(f := fields[int(w[1:])], f))) for w in compared]
        here = (
            F.when(F.col("l.here").isNull(), F.array(F.lit(missing_in_left)))
            .when(F.col("r.here").isNull(), F.array(F.lit(missing_in_right)))
            .otherwise(F.array_compact(F.array(*differs)) if differs else F.array().cast("array<string>"))
        )
        return both.select(F.col("key").alias(key), F.explode(here).alias("difference"))

    once = differences(reread(single[0], "l"), reread(single[1], "r"), wanted)
    return once.unionByName(differences(current(marked[0], "l"), current(marked[1], "r"), work))
