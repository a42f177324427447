"""The same or nearly the same records on both sides of a split.

Method: suffix array over the partitioned concatenated texts of the records. A record's texts are its exact digest and
those of its perceptual hash. Equal texts are one entry with the sides that hold it. The digest's only suffix that
matters is the whole of it: it is shared if it is the same entry, on both sides. Suffixes of hash texts are sorted and
their common prefixes scanned by :mod:`lodestone.llm.nearhash`. Both give links of texts across the sides; their spans
are the bits in which the two agree, and the spans of all partners are merged into each record's coverage.

Links are of texts, not of records, so copies cost nothing. Only :func:`cross_split_overlaps` expands them, in blocks,
so that a text with very many records on both sides is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.nearhash import near_pairs
from lodestone.operators.rows import lookup_join
from lodestone.scratch import Scratch

TRAIN, HELD_OUT = 1, 2
#: Records of one side that meet those of the other in one cell of the join, on average.
BLOCK_ROWS = 2000


def _records(records: DataFrame, scratch: Scratch) -> DataFrame:
    rows = records.where(f"id is not null and side in ({TRAIN}, {HELD_OUT})").select("id", F.col("side").cast("int").alias("side"), "digest", "hash")
    return scratch.write(rows.distinct(), "records")


def _texts(rows: DataFrame) -> DataFrame:
    """``kind, text, id, side``: the texts of each record."""
    digests = rows.where("digest is not null").select(F.lit("digest").alias("kind"), F.col("digest").alias("text"), "id", "side")
    hashes = rows.where("hash is not null").select(F.lit("hash").alias("kind"), F.hex("hash").alias("text"), "id", "side")
    return digests.unionByName(hashes)


def _links(rows: DataFrame, max_distance: int, scratch: Scratch) -> DataFrame:
    """``kind, train, held, distance, train_rows, held_rows``: texts of train and held-out records that overlap, with
    the number of records that hold them; a text on both sides is linked to itself."""
    sides = _texts(rows).groupBy("kind", "text").agg(
        F.bit_or("side").cast("tinyint").alias("side"), F.count_if(F.col("side") == TRAIN).alias("train_rows"), F.count_if(F.col("side") == HELD_OUT).alias("held_rows")
    )
    sides = scratch.write(sides, "texts")
    hashes = sides.where("kind = 'hash'").select(F.conv("text", 16, -10).cast("bigint").alias("h"), "side")
    near = near_pairs(hashes, max_distance, cross=True, scratch=scratch)
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.select(F.hex("a").alias("train"), F.hex("b").alias("held"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))
    train, held = (sides.where(F.col("side").bitwiseAND(s) != 0) for s in (TRAIN, HELD_OUT))
    near = near.join(train.where("kind = 'hash'").select(F.col("text").alias("train"), "train_rows"), "train")
    near = near.join(held.where("kind = 'hash'").select(F.col("text").alias("held"), "held_rows"), "held")
    same = sides.where(f"side = {TRAIN | HELD_OUT}")
    same = same.select("kind", F.col("text").alias("train"), F.col("text").alias("held"), F.lit(0).alias("distance"), "train_rows", "held_rows")
    links = same.unionByName(near.select(F.lit("hash").alias("kind"), "train", "held", "distance", "train_rows", "held_rows"))
    return scratch.write(links, "links")


def overlap_links(records: DataFrame, max_distance: int = 4) -> DataFrame:
    """``kind, train_first, held_first, distance, train_rows, held_rows``: each two texts of kind digest or hash that
    overlap across the sides, by the least id that holds each, with the number of records that do.

    This says all that :func:`cross_split_overlaps` does, in a row for each two texts; null, repeated and extra values
    are treated alike.
    """
    scratch = Scratch(records.sparkSession, "overlap")
    rows = _records(records, scratch)
    links = _links(rows, max_distance, scratch)
    first = _texts(rows).groupBy("kind", "text", "side").agg(F.min("id").alias("first"))
    for name, side in (("train", TRAIN), ("held", HELD_OUT)):
        links = links.join(first.where(f"side = {side}").select("kind", F.col("text").alias(name), F.col("first").alias(f"{name}_first")), ["kind", name])
    return links.select("kind", "train_first", "held_first", "distance", "train_rows", "held_rows")


def _blocks(rows: str) -> Column:
    return F.ceil(F.col(rows) / BLOCK_ROWS).cast("bigint")


def cross_split_overlaps(records: DataFrame, max_distance: int = 4) -> DataFrame:
    """``train_id, held_id, digest_shared boolean, hash_distance int, shared_bits bigint``: each overlap of a train and a
    held-out record.

    ``records``: ``id bigint, side int`` (1 train, 2 held out), ``digest string, hash bigint``; other columns are
    ignored. Two different ids on different sides overlap if their digests are equal or their hashes differ in at
    most ``max_distance`` bits (``hash_distance``, and the bits in which they agree; null beyond that). A null digest or
    hash links nothing, and rows with a null id or side none either; repeated rows count once, an id on both sides meets
    all others, never itself. Of several hashes of one id the nearest two count. An empty table gives an empty one.

    No pair is lost, so a text with a train and b held-out records gives a * b rows. They are made in cells of about
    BLOCK_ROWS records a side: records are dealt to blocks of their text, and links are written for each two blocks.
    """
    scratch = Scratch(records.sparkSession, "overlap")
    rows = _records(records, scratch)
    links = _links(rows, max_distance, scratch)
    cells = links.withColumn("tb", F.explode(F.sequence(F.lit(0).cast("bigint"), _blocks("train_rows") - 1)))
    cells = cells.withColumn("hb", F.explode(F.sequence(F.lit(0).cast("bigint"), _blocks("held_rows") - 1)))
    # Only records whose text is linked at all travel, each with the block it is in.
    members, n = _texts(rows), rows.count() * 2
    found = cells.select("kind", "train", "held", "distance", "tb", "hb")
    for name, side, block in (("train", TRAIN, "tb"), ("held", HELD_OUT, "hb")):
        linked = links.groupBy("kind", name).agg(F.max(_blocks(f"{name}_rows")).alias("blocks"))
        linked = linked.select(F.concat("kind", F.lit(":"), name).alias("key"), "blocks")
        mine = members.where(f"side = {side}").select(F.concat("kind", F.lit(":"), "text").alias("key"), "kind", F.col("text").alias(name), F.col("id").alias(f"{name}_id"))
        mine = lookup_join(mine, linked, "key", rows=n)
        mine = mine.select("kind", name, f"{name}_id", F.pmod(F.xxhash64(f"{name}_id"), "blocks").alias(block))
        found = found.join(mine, ["kind", name, block])
    bits = F.bitwise_not(F.conv("train", 16, -10).cast("bigint").bitwiseXOR(F.conv("held", 16, -10).cast("bigint")))
    is_hash = F.col("kind") == "hash"
    found = found.where("train_id <> held_id").select(
        "train_id", "held_id", (~is_hash).alias("digest_shared"), F.when(is_hash, F.struct("distance", bits.alias("bits"))).alias("near")
    )
    pairs = found.groupBy("train_id", "held_id").agg(F.max("digest_shared").alias("digest_shared"), F.min("near").alias("near"))
    return pairs.select("train_id", "held_id", "digest_shared", F.col("near.distance").cast("int").alias("hash_distance"), F.col("near.bits").alias("shared_bits"))


def coverage(overlaps: DataFrame, digest_length: int = 64, hash_bits: int = 64) -> DataFrame:
    """``id, side, partners, covered``: of each overlapping record, the share of its texts that its partners hold too.

    The spans of all partners are merged: a digest is covered wholly or not at all, a hash in each bit in which some
    near partner agrees with it.
    """
    sides = overlaps.select(F.col("train_id").alias("id"), F.lit("train").alias("side"), "digest_shared", "shared_bits").unionByName(
        overlaps.select(F.col("held_id").alias("id"), F.lit("held_out").alias("side"), "digest_shared", "shared_bits")
    )
    whole = F.when(F.max("digest_shared"), digest_length).otherwise(0)
    near = F.coalesce(F.bit_count(F.bit_or("shared_bits")), F.lit(0))
    return sides.groupBy("id", "side").agg(F.count(F.lit(1)).alias("partners"), ((whole + near) / (digest_length + hash_bits)).alias("covered"))
