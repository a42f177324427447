"""Problems 1, 3 and 5: overlaps, splits and groups of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.hashes import hash_long
from lodestone.functions.text import hex_digest, same_path, same_text
from lodestone.llm.components import connected_components, numbered_components, star_links
from lodestone.llm.groupsplit import grouped_split
from lodestone.llm.nearhash import near_pairs
from lodestone.llm.overlap import HELD_OUT, TRAIN, coverage, cross_split_overlaps, overlap_links
from lodestone.operators.rows import current_rows, lookup_join
from lodestone.scratch import Scratch


def current_images(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``image_id`` and the columns asked for, of the latest audit of every image; no others are read."""
    known = {
        "digest": F.col("pixelsha256"), "hash": F.col("dhash"), "source_id": F.col("source.id"),
        "original_path": F.col("source.originalpath"), "parent_key": F.col("source.parentsuggestion.key"),
    }
    t = spark.read.parquet(f"{sf_dir}/normalized_inventory.parquet").where("image_id is not null")
    now = current_rows(t.select("image_id", "auditedat", *(known[c].alias(c) for c in columns)), ["image_id"], "auditedat", list(columns))
    # Hashes are checked after the choice: only current rows need it.
    checked = {"digest": hex_digest("digest", 64), "hash": hash_long(hex_digest("hash", 16))}
    return now.withColumns({c: checked[c] for c in columns if c in checked})


def manifest_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, split`` with split train, valid or test, once for each image; unplaced images are left out."""
    t = spark.read.parquet(f"{sf_dir}/manifest.parquet")
    split = same_text("split")
    rows = t.select("image_id", F.when(split.isin("val", "validation"), "valid").otherwise(split).alias("split"))
    return rows.where("image_id is not null and split in ('train', 'valid', 'test')").distinct()


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest_splits(spark, sf_dir).join(current_images(spark, sf_dir, "digest", "hash"), "image_id")
    side = F.when(F.col("split") == "train", TRAIN).otherwise(HELD_OUT)
    return rows.select(F.col("image_id").alias("id"), side.alias("side"), "digest", "hash")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_split_overlaps(_sides(spark, sf_dir))
    return found.select(F.least("train_id", "held_id").alias("image_id_a"), F.greatest("train_id", "held_id").alias("image_id_b")).distinct()


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same overlaps between texts, by the first image that holds each, with the number of images that do."""
    return overlap_links(_sides(spark, sf_dir))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping images per split and source, with the sum of their partners and their mean coverage."""
    records = coverage(cross_split_overlaps(_sides(spark, sf_dir)))
    splits = manifest_splits(spark, sf_dir).withColumn("side", F.when(F.col("split") == "train", "train").otherwise("held_out"))
    sources = current_images(spark, sf_dir, "source_id").select("image_id", same_text("source_id").alias("source_id"))
    rows = records.withColumnRenamed("id", "image_id").join(splits, ["image_id", "side"]).join(sources, "image_id", "left")
    return rows.groupBy("split", "source_id").agg(
        F.count(F.lit(1)).alias("images"), F.sum("partners").alias("partners"), F.round(F.avg("covered"), 6).alias("mean_covered")
    )


def image_links(images: DataFrame, scratch: Scratch, max_distance: int = 4) -> DataFrame:
    """``a, b``: links of images by original path, digest, parent suggestion and hash that connect all that are linked.

    Of the images that share a value each is linked to the least; near hashes are linked through the least image of
    each hash.
    """
    hashed = images.where("hash is not null")
    first = scratch.write(hashed.groupBy(F.col("hash").alias("h")).agg(F.min("image_id").alias("first")), "first")
    near = scratch.write(near_pairs(first.select("h", F.lit(3).alias("side")), max_distance, spanning=True, scratch=scratch), "near")
    n = near.count()
    for end in ("a", "b"):
        near = lookup_join(near, first.select(F.col("h").alias(end), F.col("first").alias(f"f{end}")), end, rows=n)
    links = near.select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    for key in (["hash"], ["digest"], ["path_key"], ["source_id", "parent_key"]):
        links = links.unionByName(star_links(images, key, "image_id", scratch))
    return links


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "groups")
    images = current_images(spark, sf_dir, "digest", "hash", "original_path", "source_id", "parent_key").select(
        "image_id", "digest", "hash", same_path("original_path").alias("path_key"), same_text("source_id").alias("source_id"), same_text("parent_key").alias("parent_key")
    )
    images = scratch.write(images, "images")
    found = connected_components(image_links(images, scratch))
    scratch.clear()  # the links were read; what the result reads lies elsewhere
    return found.select(F.col("node").alias("image_id"), F.col("component").alias("group_id"))


def p5_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every image, also of those alone, with its number by first appearance."""
    ids = spark.read.parquet(f"{sf_dir}/normalized_inventory.parquet").select(F.col("image_id").alias("node"))
    found = p5_found(spark, sf_dir).select(F.col("image_id").alias("node"), F.col("group_id").alias("component"))
    return numbered_components(ids, found).select(F.col("node").alias("image_id"), F.col("component").alias("group_id"), "number", "name")


#: Shares of the images.
SHARES = {"train": 0.7, "valid": 0.15, "test": 0.15}


def _manifest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = same_text("split")
    stored = F.when(split.isin("val", "validation"), "valid").otherwise(split)
    t = spark.read.parquet(f"{sf_dir}/manifest.parquet")
    return t.select(F.col("image_id").alias("id"), same_text("groupid").alias("group"), stored.alias("stored"), F.array_distinct("objects.classid").alias("classes"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of groups that the stored split tears apart: the torn components, each checked by its groups."""
    records = _manifest_records(spark, sf_dir)
    torn = grouped_split(records, SHARES).where("torn").select("id")
    rows = records.where("group is not null").select("id", "group", "stored").join(torn, "id", "left_semi").distinct()
    rows = Scratch(spark, "torn").write(rows, "rows")
    groups = rows.groupBy("group").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b").select("group")
    return lookup_join(rows.where("stored is not null"), groups, "group").select(F.col("id").alias("image_id")).distinct()


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every image."""
    split = grouped_split(_manifest_records(spark, sf_dir), SHARES)
    return split.select(F.col("id").alias("image_id"), "component", "split").distinct()


#: Unicode normalisation of SQL doesn't reach NFKC, so splits are matched by trimming and case; the tables spell them
#: no other way.
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"
_SPLIT = f"lower(trim(split, {_BLANKS}))"
SPLIT_SQL = f"case {_SPLIT} when 'val' then 'valid' when 'validation' then 'valid' else {_SPLIT} end"
_IMAGES_SQL = f"""
image as (
  select image_id, case when regexp_full_match(lower(trim(pixelsha256, {_BLANKS})), '[0-9a-f]{{64}}') then lower(trim(pixelsha256, {_BLANKS})) end as digest,
    case when regexp_full_match(lower(trim(dhash, {_BLANKS})), '[0-9a-f]{{16}}') then ('0x' || lower(trim(dhash, {_BLANKS})))::ubigint end as hash, source
  from normalized_inventory qualify row_number() over (partition by image_id order by auditedat desc) = 1)"""
P1_SQL = f"""
with {_IMAGES_SQL},
placed as (select distinct image_id, {SPLIT_SQL} as split from manifest),
record as (select * from placed join image using (image_id) where split in ('train', 'valid', 'test'))
select distinct least(a.image_id, b.image_id) as image_id_a, greatest(a.image_id, b.image_id) as image_id_b
from record a join record b on a.split = 'train' and b.split <> 'train' and a.image_id <> b.image_id
  and (a.digest = b.digest or bit_count(xor(a.hash, b.hash)) <= 4)
"""
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)).replace("＇", "")
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "")
#: SQL has NFC only; of what NFKC does beyond it, groups need the full-width forms, and of case folding no more than lower.
P3_SQL = f"""
with record as (select distinct image_id, {SPLIT_SQL} as split,
    lower(trim(translate(nfc_normalize(groupid), '{_WIDE}', '{_NARROW}'), {_BLANKS})) as grp from manifest),
torn as (select grp from record where grp <> '' group by grp having count(distinct split) > 1)
select distinct image_id from record where split is not null and grp in (select grp from torn)
"""


def _same(column: str) -> str:
    return f"nullif(lower(trim(translate(nfc_normalize({column}), '{_WIDE}', '{_NARROW}'), {_BLANKS})), '')"


P5_SQL = f"""
with recursive {_IMAGES_SQL},
keyed as (select image_id, digest, hash, replace({_same('source.originalpath')}, '\\', '/') as path_key,
    {_same('source.id')} || '|' || {_same('source.parentsuggestion.key')} as parent_key from image),
star as (
  select image_id as a, min(image_id) over (partition by digest) as b from keyed where digest is not null
  union select image_id, min(image_id) over (partition by path_key) from keyed where path_key is not null
  union select image_id, min(image_id) over (partition by parent_key) from keyed where parent_key is not null
  union select x.image_id, y.image_id from keyed x join keyed y on x.image_id > y.image_id and bit_count(xor(x.hash, y.hash)) <= 4),
edge as (select a, b from star where a <> b union select b, a from star where a <> b),
reach(node, root) as (select a, a from edge union select e.b, r.root from reach r join edge e on e.a = r.node)
select node as image_id, min(root) as group_id from reach group by node
"""
P5_NUMBERS_SQL = f"""
with x as (select i.image_id, coalesce(g.group_id, i.image_id) as group_id
  from (select distinct image_id from normalized_inventory where image_id is not null) i left join ({P5_SQL}) g on i.image_id = g.image_id)
select image_id, group_id, dense_rank() over (order by group_id) - 1 as number, format('g{{:05d}}', dense_rank() over (order by group_id) - 1) as name from x
"""
P1_LINKS_SQL = f"""
with {_IMAGES_SQL},
placed as (select distinct image_id, {SPLIT_SQL} as split from manifest),
record as (select image_id, split = 'train' as train, digest, hash from placed join image using (image_id) where split in ('train', 'valid', 'test')),
digests as (select digest, train, min(image_id) as first, count(*) as n from record where digest is not null group by all),
hashes as (select hash, train, min(image_id) as first, count(*) as n from record where hash is not null group by all)
select 'digest' as kind, a.first as train_first, b.first as held_first, 0 as distance, a.n as train_rows, b.n as held_rows
from digests a join digests b on a.digest = b.digest and a.train and not b.train
union all select 'hash', a.first, b.first, bit_count(xor(a.hash, b.hash))::int, a.n, b.n
from hashes a join hashes b on a.train and not b.train and bit_count(xor(a.hash, b.hash)) <= 4
"""
P1_REPORT_SQL = f"""
with {_IMAGES_SQL},
placed as (select distinct image_id, {SPLIT_SQL} as split from manifest),
record as (select *, {_same('source.id')} as source_id from placed join image using (image_id) where split in ('train', 'valid', 'test')),
pair as (select distinct a.image_id as t, b.image_id as h, coalesce(a.digest = b.digest, false) as whole,
    case when bit_count(xor(a.hash, b.hash)) <= 4 then ~xor(a.hash, b.hash) end as d
  from record a join record b on a.split = 'train' and b.split <> 'train' and a.image_id <> b.image_id
  and (a.digest = b.digest or bit_count(xor(a.hash, b.hash)) <= 4)),
side as (select t as image_id, true as train, whole, d from pair union all select h, false, whole, d from pair),
covered as (select image_id, train, count(*) as partners, (case when bool_or(whole) then 64 else 0 end + coalesce(bit_count(bit_or(d)), 0)) / 128.0::double as covered
  from side group by image_id, train)
select split, source_id, count(*) as images, sum(partners)::bigint as partners, round(avg(covered), 6) as mean_covered
from covered c join record r on c.image_id = r.image_id and c.train = (r.split = 'train') group by split, source_id
"""
