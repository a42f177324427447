"""Queries over inventories, manifests and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry, paths
from lodestone.functions.documents import fingerprint
from lodestone.functions.hashes import hash_long
from lodestone.functions.text import hex_digest, same_path, same_text
from lodestone.operators import catalog, duplicates, history, quality, seeded
from lodestone.operators.rows import current_rows, lookup_join
from lodestone.plans.frames import _iou

#: Sources that file names begin with in these tables, and those whose names hold a parent's.
PREFIXES = ["kebun_v5", "lereng_v2", "pasar_v7", "bumbu", "rfumbi", "sari", "umbi"]
WITH_PARENTS = ["kebun_v5", "lereng_v2", "pasar_v7"]
#: The folder of live scans.
LIVE = "pindai/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``image_id`` and the columns asked for, of the current row of every image; no others are read."""
    derived = {
        "digest": hex_digest("pixelsha256", 64), "hash": hash_long(hex_digest("dhash", 16)),
        "classid": F.col("classproposal.classid"), "slug": F.col("classproposal.slug"),
    }
    t = table(spark, sf_dir, "normalized_inventory").where("image_id is not null")
    t = t.select("image_id", "auditedat", *(derived.get(c, F.col(c)).alias(c) for c in columns))
    return current_rows(t, ["image_id"], "auditedat", list(columns)) if columns else t.select("image_id").distinct()


def drive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current listing of every path as it is spelled."""
    t = table(spark, sf_dir, "drive_inventory").where("kind = 'image'").select("path", "listedat", "driveid", "bytes", "sha256", "source.id", F.col("source.originalpath").alias("former"))
    return current_rows(t, ["path"], "listedat", ["driveid", "bytes", "sha256", "id", "former"])


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different rows of the manifest, with splits and groups as keys: train, valid or test whatever their spelling,
    other texts as they are, and null where there is none."""
    t, split = table(spark, sf_dir, "manifest"), same_text("split")
    keys = {"groupid": same_text("groupid"), "split": F.when(split.isin("val", "validation"), "valid").otherwise(split)}
    return t.withColumns({c: x for c, x in keys.items() if c in t.columns}).distinct()


def exact_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_clusters(images(spark, sf_dir, "digest", "path", "classid"), "digest", "path", "classid")


def exact_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.exact_members(images(spark, sf_dir, "digest", "path", "classid"), "digest", "path", "classid")


def dedupe_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.representatives(images(spark, sf_dir, "digest", "path").select("digest", "path", "image_id"), "digest", "path")


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_duplicates(images(spark, sf_dir, "path", "sha256", "hash"), 4)


def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.near_members(images(spark, sf_dir, "path", "sha256", "hash"))


def near_duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 10,000 rows, beside the number of pairs of images in all."""
    return duplicates.bounded_pairs(near_duplicate_pairs(spark, sf_dir), 10_000, ["path_a", "path_b", "a", "b"], F.col("pairs"))


def reconcile_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = images(spark, sf_dir, "slug").groupBy("slug").agg(F.count(F.lit(1)).alias("n"))
    listed = table(spark, sf_dir, "drive_inventory").where("kind = 'image'").select("path", F.col("classproposal.slug").alias("slug")).distinct()
    return quality.counts_against(listed, "slug", expected)


def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.array(*(F.lit(r.slug) for r in table(spark, sf_dir, "taxonomy").orderBy("classid").collect()))  # ten rows
    p = drive(spark, sf_dir).select(paths.provenance(F.col("former"), PREFIXES, classes, WITH_PARENTS).alias("p")).where("p is not null")
    return p.groupBy("p.id").agg(F.count(F.lit(1)).alias("n"), F.count("p.parent_key").alias("with_parent"), F.countDistinct("p.parent_key").alias("parents"))


def source_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drive(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("former")
    rows = drive(spark, sf_dir).select("former").where("former is not null").distinct()
    return rows.select("former", paths.safe_path(p).alias("safe"), paths.inner_path(p).alias("inner_path"), paths.archive_path(p).isNotNull().alias("archivable"))


def class_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drive(spark, sf_dir).select(paths.class_folder(F.col("path")).alias("slug"), paths.extension_format(F.col("path")).alias("format"))
    counted = rows.groupBy("slug", "format").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(table(spark, sf_dir, "taxonomy").select("slug", "classid")), "slug", "left")  # ten rows


def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.remaining(images(spark, sf_dir, "path").select("image_id", "path"), table(spark, sf_dir, "manifest"), "image_id")


def subset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = images(spark, sf_dir).select("image_id")
    wanted = table(spark, sf_dir, "manifest").select("image_id").distinct()
    return wanted.exceptAll(known).agg(F.count(F.lit(1)).alias("unknown"), (F.count(F.lit(1)) == 0).alias("is_subset"))


def sym_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.symmetric_difference(table(spark, sf_dir, "manifest").select("path").distinct(), images(spark, sf_dir, "path").select("path").distinct())


def receipt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, problem`` by filekey: audited files that the drive doesn't list, listed ones without an audit, those whose
    bytes changed since (``sha256``), and those whose audits disagree (``conflict``). The tables hold the number of
    bytes on the drive's side only, so there is none to compare."""
    t = table(spark, sf_dir, "drive_inventory").where("kind = 'image'").select(same_path("path").alias("path"), "listedat", "sha256")
    listed = current_rows(t.where("path is not null"), ["path"], "listedat", ["sha256"])
    audits = images(spark, sf_dir, "originalpath", "originalsha256").select(same_path("originalpath").alias("path"), "originalsha256")
    audited = audits.where("path is not null").groupBy("path").agg(F.max("originalsha256").alias("sha256"), (F.min("originalsha256") != F.max("originalsha256")).alias("conflict"))
    found = quality.verify_receipts(audited.where("conflict is not true"), listed, "path", ["sha256"])
    torn = audited.where("conflict").select("path", F.lit("conflict").alias("problem"))
    return found.join(torn.select("path"), "path", "left_anti").unionByName(torn)


def prediction_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, problem``: held-out images that are missing from the cached predictions or stand repeatedly in the manifest,
    frames that differ from the manifest in ``split``, ``group`` (as same text) or ``truth`` (number, order, class or box
    of the objects), and frames of no held-out image.

    A frame has the truth of all its current batches, and a split or group in which its batches disagree differs from
    any. A frame of no held-out image is ``live`` if it lies in the folder of live scans and isn't an image of the
    manifest at all; any other is ``unexpected``.
    """
    nothing = F.array().cast("array<struct<class_id:int,bbox:array<double>>>")
    images = manifest(spark, sf_dir).select(
        "path", "split", F.col("groupid").alias("grp"),
        F.coalesce(F.transform("objects", lambda o: F.struct(o["classid"].alias("class_id"), o["bbox"].alias("bbox"))), nothing).alias("truth"),
    )
    held = images.where("split in ('valid', 'test')").groupBy("path").agg(F.array_sort(F.collect_set(F.struct("split", "grp", "truth"))).alias("rows"))
    one = F.col("rows")[0]  # of a repeated path the least row is compared
    # Sets of structs, so that a null among a frame's batches counts as a value; an image's have one element.
    single = lambda c: F.array(F.struct(one[c].alias(c)))
    held = held.select("path", single("split").alias("split"), single("grp").alias("group"), one["truth"].alias("truth"), (F.size("rows") > 1).alias("repeated"))

    box = lambda b: F.when(b.isNotNull(), F.array(b["x"], b["y"], b["w"], b["h"]))
    t = table(spark, sf_dir, "frame_prediction").select(
        "path", "batch_no", "arrived_at", "group_id", "split", F.transform("truth", lambda o: F.struct(o["class_id"].alias("class_id"), box(o["box"]).alias("bbox"))).alias("truth")
    )
    now = current_rows(t, ["path", "batch_no"], "arrived_at", ["group_id", "split", "truth"]).withColumn("grp", same_text("group_id"))
    seen = now.groupBy("path").agg(
        F.collect_set(F.struct("split")).alias("split"), F.collect_set(F.struct("grp")).alias("group"),
        F.array_sort(F.collect_list(F.when(F.size("truth") > 0, F.struct("batch_no", "truth")))).alias("t"),
    )
    seen = seen.select("path", "split", "group", F.flatten(F.transform("t", lambda x: x["truth"])).alias("truth"), F.lit(False).alias("repeated"))
    known = images.select("path").distinct().withColumn("known", F.lit(True))
    found = quality.verify_receipts(held, seen, "path", ["split", "group", "truth", "repeated"]).join(known, "path", "left")
    live = (F.col("problem") == "unexpected") & F.col("path").startswith(LIVE) & F.col("known").isNull()
    return found.select("path", F.when(live, "live").otherwise(F.col("problem")).alias("problem"))


def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.manifest_violations(manifest(spark, sf_dir))


def manifest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.manifest_report(manifest(spark, sf_dir), table(spark, sf_dir, "taxonomy"))


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.split_summary(manifest(spark, sf_dir))


def class_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.class_spread(manifest(spark, sf_dir), table(spark, sf_dir, "taxonomy"))


def spelling_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "drive_inventory").select(F.col("source.id").alias("source_id"))
    return quality.spelling_conflicts(t, "source_id", same_text("source_id"))


def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = manifest(spark, sf_dir).select("path", F.posexplode("objects").alias("instance", "o"))
    return o.select("path", "instance", geometry.label_line(F.col("o.classid"), F.col("o.bbox")).alias("line"))


def letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = images(spark, sf_dir, "width", "height").select("width", "height").where("width > 0 and height > 0").distinct()
    g = geometry.letterbox(F.col("width"), F.col("height"))
    ratio = geometry.fit_preview(F.col("width") / F.col("height"), F.lit(4 / 3))
    cols = [F.col(f"g.{c}").alias(a) for c, a in (("width", "w"), ("height", "h"), ("left", "left"), ("top", "top"))]
    return sizes.withColumn("g", g).withColumn("p", ratio).select("width", "height", *cols, F.round("p.width", 6).alias("preview_w"), F.round("p.height", 6).alias("preview_h"))


def padded_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = manifest(spark, sf_dir).select("image_id", F.posexplode("objects").alias("instance", "o")).where("size(o.bbox) = 4")
    rows = o.join(images(spark, sf_dir, "width", "height").select("image_id", "width", "height"), "image_id")
    b = geometry.box(*(F.col("o.bbox")[i] for i in range(4)))
    return rows.select("image_id", "instance", F.inline_outer(F.array(geometry.padded_crop(b, F.col("width"), F.col("height")))))


def best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every current detection of a frame with truth, with its best IoU. A frame has the truth of all its current
    batches, whichever of them a detection came in; a frame without any truth gives no rows."""
    t = table(spark, sf_dir, "frame_prediction").where("path is not null")
    # A struct equals another where both hold a null, so a batch without a number finds itself again.
    t = t.select("path", F.struct("batch_no").alias("batch"), "arrived_at", F.col("truth.box").alias("truth"), "detections.box", "detections.anchor")
    now = current_rows(t, ["path", "batch"], "arrived_at", ["truth", "box", "anchor"])
    # Truth comes first among equal deliveries, so it can be chosen without the boxes and is that of the same delivery.
    truth = current_rows(t, ["path", "batch"], "arrived_at", ["truth"]).where("size(truth) > 0").groupBy("path").agg(F.flatten(F.collect_list("truth")).alias("truth"))
    # Only keys are moved to the truth of their path; boxes stay where the choice of current rows has put them.
    known = lookup_join(t.select("path", "batch").distinct(), truth, "path")
    t = now.select("path", "batch", F.arrays_zip("box", "anchor").alias("d")).join(known, ["path", "batch"])
    best = F.array_max(F.transform("truth", lambda x: geometry.iou(F.col("d.box"), x)))
    return t.select("path", "batch.batch_no", "truth", F.explode("d").alias("d")).select("path", "batch_no", "d.anchor", F.round(best, 9).alias("iou"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = history.class_weights(table(spark, sf_dir, "embeddings"), "label", 10)
    return w.select("label", "n", F.round("weight", 9).alias("weight"))


def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.expr("(year(o_orderdate) - 1992) * 12 + month(o_orderdate)").alias("epoch"), "o_totalprice")
    h = o.groupBy("run", "epoch").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return history.early_stopping(h, "run", "epoch", "score", 8)


def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return catalog.search(parts, ["p_name", "p_brand"], "  LARGE ring ", family="p_type", wanted="LARGE")


def catalog_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.families(table(spark, sf_dir, "part"), "p_type", "p_partkey")


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.systematic_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), ["doc_id"], 48)


def seeded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(spark, sf_dir).select("image_id", F.col("groupid").alias("grp"), "objects.classid")
    return seeded.seeded_split(rows, "grp", "classid").select("image_id", "grp", "split")


def json_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fingerprint("props").alias("fingerprint"))


def dataset_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the set of (path, sha256), whatever their order: the sums of four parts of each pair's SHA-256."""
    pair = F.sha2(F.concat_ws("\n", "path", F.coalesce("sha256", F.lit(""))), 256)
    rows = images(spark, sf_dir, "path", "sha256").select(pair.alias("p"))
    parts = (F.sum(F.conv(F.substring("p", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"part{i}") for i in range(4))
    return rows.agg(F.count(F.lit(1)).alias("files"), *parts)


def normalized_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir, "path").select("image_id", paths.quoted_path(F.col("path")).alias("address"))


QUERIES = {
    f.__name__: f
    for f in (
        exact_duplicate_clusters, exact_duplicate_members, dedupe_representative, near_duplicate_pairs, near_duplicate_members, near_duplicate_report, reconcile_inventory,
        provenance_counts, source_totals, path_rules, class_folders, resume_pending, subset_check, sym_difference, receipt_problems,
        prediction_consistency, manifest_violations, manifest_report, split_summary, class_spread, spelling_conflicts, yolo_lines, letterbox,
        padded_crop, best_overlap, class_weights, early_stopping, catalog_search, catalog_families, systematic_sample, seeded_split,
        json_fingerprints, dataset_identity, normalized_addresses,
    )
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)"
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)).replace("＇", "")
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "")


def _same(column: str) -> str:
    """SQL has NFC only; of what NFKC does beyond it, the tables here need the full-width forms and the blanks."""
    return f"nullif(lower(trim(translate(nfc_normalize({column}), '{_WIDE}', '{_NARROW}'), {_BLANKS})), '')"


_IMAGES = f"""image as (
  select image_id, path, sha256, width, height, originalpath, originalsha256, classproposal.classid as classid, classproposal.slug as slug,
    case when regexp_full_match(lower(trim(pixelsha256, {_BLANKS})), '[0-9a-f]{{64}}') then lower(trim(pixelsha256, {_BLANKS})) end as digest,
    case when regexp_full_match(lower(trim(dhash, {_BLANKS})), '[0-9a-f]{{16}}') then ('0x' || lower(trim(dhash, {_BLANKS})))::ubigint end as uhash,
    (case when uhash >= 9223372036854775808 then uhash::hugeint - 18446744073709551616 else uhash::hugeint end)::bigint as hash
  from normalized_inventory qualify row_number() over (partition by image_id order by auditedat desc) = 1)"""
_DRIVE = """drive as (select path, driveid, bytes, sha256, source.id as id, source.originalpath as former from drive_inventory where kind = 'image'
  qualify row_number() over (partition by path order by listedat desc, driveid desc nulls last, bytes desc nulls last, sha256 desc nulls last) = 1)"""
_PAIRS = f"""{_IMAGES}, h as (select hash, uhash, coalesce(sha256, '') as sha, path from image where hash is not null and path is not null),
first as (select hash, min(path) as first from h group by hash),
near as (select x.hash as a, y.hash as b, bit_count(xor(x.uhash, y.uhash))::int as distance, count(*) as pairs from h x join h y
    on bit_count(xor(x.uhash, y.uhash)) <= 4 and x.sha <> y.sha and (x.hash < y.hash or x.hash = y.hash and (x.path, x.sha) < (y.path, y.sha)) group by all),
second as (select x.hash, min(x.path) as second from h x join (select hash, arg_min(sha, {{'p': path, 's': sha}}) as sha from h group by hash) y on x.hash = y.hash and x.sha <> y.sha group by x.hash),
pair as (select a, b, distance, f.first as path_a, case when a = b then s.second else g.first end as path_b, pairs
  from near join first f on a = f.hash join first g on b = g.hash left join second s on a = s.hash)"""
_CLUSTERS = f"""{_IMAGES}, cluster as (select digest, count(*) as n, min(path) as first_path, coalesce(min(classid) <> max(classid), false) as class_conflict
  from image where digest is not null group by digest having count(*) > 1)"""
_SPLIT = f"case {_same('split')} when 'val' then 'valid' when 'validation' then 'valid' else {_same('split')} end"
_MANIFEST = f"""m as (select distinct image_id, path, sourceid, {_same('groupid')} as groupid, license, sha256, {_SPLIT} as split, objects from manifest)"""
_PORTABLE = "replace(former, '\\', '/')"
_FOLDER = "translate(lower(split_part(replace({p}, '\\', '/'), '/', 1)), ' _', '--')"
_NAME = f"list_last(string_split({_PORTABLE}, '/'))"
_SOURCE = f"""case when split_part({_PORTABLE}, '/', 1) = 'uploads' then 'uploads'
  when len(string_split({_PORTABLE}, '/')) = 3 and split_part({_PORTABLE}, '/', 1) = split_part({_PORTABLE}, '/', 2)
    and {_FOLDER.format(p='former')} in (select slug from taxonomy) and regexp_full_match({_NAME}, 'IMG_[0-9]+\\.[A-Za-z]+') then 'original'
  {' '.join(f"when starts_with({_NAME}, '{p}_') then '{p}'" for p in PREFIXES)} else 'unknown' end"""
_BAD_PART = (
    "p = '' or p in ('.', '..') or regexp_matches(p, '[ .]$') or regexp_matches(p, '[\\x00-\\x1f:*?\"<>|]') or upper(split_part(p, '.', 1)) in ("
    + ", ".join(f"'{r}'" for r in paths.RESERVED) + ")"
)


SQL = {
    "exact_duplicate_clusters": f"with {_CLUSTERS} select * from cluster",
    "exact_duplicate_members": f"with {_CLUSTERS} select digest, path, n, first_path from image join cluster using (digest)",
    "dedupe_representative": f"""with {_IMAGES} select digest, path, image_id from image
  qualify digest is null or row_number() over (partition by digest order by path) = 1""",
    "near_duplicate_pairs": f"with {_PAIRS} select * from pair",
    "near_duplicate_members": f"""with {_IMAGES}, h as (select * from image where hash is not null and path is not null)
select path, sha256, hash, min(path) over (partition by hash) as first_path, count(*) over (partition by hash) as n from h""",
    "near_duplicate_report": f"""with {_PAIRS} select *, (select sum(pairs) from pair)::bigint as total, (select count(*) from pair) > 10000 as truncated
  from pair order by path_a, path_b, a, b limit 10000""",
    "reconcile_inventory": f"""with {_IMAGES}, e as (select slug, count(*) as n from image group by 1),
f as (select slug, count(*) as n from (select distinct path, classproposal.slug as slug from drive_inventory where kind = 'image') group by 1)
select coalesce(f.slug, e.slug) as slug, coalesce(f.n, 0) as found, coalesce(e.n, 0) as expected, coalesce(f.n, 0) = coalesce(e.n, 0) as matches
from f full join e on f.slug is not distinct from e.slug""",
    "provenance_counts": f"""with {_DRIVE}, p as (select {_SOURCE} as id, {_NAME} as name from drive where former is not null),
q as (select id, case when id in ('kebun_v5', 'lereng_v2', 'pasar_v7') and contains(name, '.rf.') then split_part(name, '.rf.', 1) end as parent from p)
select id, count(*) as n, count(parent) as with_parent, count(distinct parent) as parents from q group by id""",
    "source_totals": f"with {_DRIVE} select id, count(*) as files, sum(bytes)::bigint as bytes from drive group by id",
    "path_rules": f"""with {_DRIVE}, f as (select distinct former from drive where former is not null),
g as (select former, {_PORTABLE} as p0, string_split({_PORTABLE}, '/') as parts from f)
select former, case when former <> '' and not starts_with(p0, '/') and len(list_filter(parts, lambda p: {_BAD_PART})) = 0 then p0 end as safe,
  case when not contains(p0, ':') and len(list_filter(parts, lambda p: p in ('', '.', '..'))) = 0 then p0 end as inner_path,
  not contains(former, '\\') and not contains(former, ':') and len(list_filter(string_split(former, '/'), lambda p: p in ('', '.', '..'))) = 0 as archivable from g""",
    "class_folders": f"""with {_DRIVE}, x as (select {_FOLDER.format(p='path')} as slug, case lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1))
    when 'jpg' then 'JPEG' when 'jpeg' then 'JPEG' when 'png' then 'PNG' when 'webp' then 'WEBP' end as format from drive)
select slug, format, count(*) as n, classid from x left join taxonomy using (slug) group by all""",
    "resume_pending": f"with {_IMAGES} select image_id, path from image where image_id not in (select image_id from manifest where image_id is not null)",
    "subset_check": f"""with {_IMAGES}, u as (select distinct image_id from manifest except select image_id from image)
select count(*) as unknown, count(*) = 0 as is_subset from u""",
    "sym_difference": f"""with {_IMAGES}, a as (select distinct path from manifest), b as (select distinct path from image)
select path, 'left' as side from (select path from a except select path from b) union all select path, 'right' from (select path from b except select path from a)""",
    "receipt_problems": f"""with {_IMAGES}, listed as (select replace({_same('path')}, '\\', '/') as path, sha256 from (select * from drive_inventory where kind = 'image')
  qualify row_number() over (partition by replace({_same('path')}, '\\', '/') order by listedat desc, sha256 desc nulls last) = 1),
audited as (select replace({_same('originalpath')}, '\\', '/') as path, max(originalsha256) as sha256, count(distinct originalsha256) > 1 as conflict from image group by 1)
select coalesce(a.path, l.path) as path, case when a.conflict then 'conflict' when l.path is null then 'missing' when a.path is null then 'unexpected' else 'sha256' end as problem
from (select * from audited where path is not null) a full join (select * from listed where path is not null) l on a.path = l.path
where a.conflict or a.path is null or l.path is null or a.sha256 is distinct from l.sha256""",
    "prediction_consistency": f"""with {_MANIFEST},
image as (select path, split, groupid, coalesce(list_transform(objects, lambda o: {{'class_id': o.classid, 'bbox': o.bbox}}), []) as truth from m),
held as (select path, count(*) > 1 as repeated, min({{'split': split, 'grp': groupid, 'truth': truth}}) as one
  from (select distinct * from image where split in ('valid', 'test')) group by path),
now as (select path, batch_no, split, {_same('group_id')} as grp, list_transform(truth, lambda o: {{'class_id': o.class_id, 'bbox': [o.box.x, o.box.y, o.box.w, o.box.h]}}) as truth
  from frame_prediction qualify row_number() over (partition by path, batch_no order by arrived_at desc) = 1),
seen as (select path, list(distinct coalesce(split, '-')) as splits, list(distinct coalesce(grp, '-')) as groups,
  coalesce(flatten(list(truth order by batch_no) filter (len(truth) > 0)), []) as truth from now group by path),
both_sides as (select coalesce(h.path, s.path) as path, h.path is null as no_image, s.path is null as no_frame, h.repeated as repeated, h.one as one, s.splits as splits, s.groups as groups, s.truth as truth
  from held h full join seen s on h.path = s.path)
select path, case when starts_with(path, 'pindai/') and path not in (select path from image where path is not null) then 'live' else 'unexpected' end as problem from both_sides where no_image
union all select path, 'missing' from both_sides where no_frame
union all select path, 'split' from both_sides where not no_image and not no_frame and splits <> [coalesce(one.split, '-')]
union all select path, 'group' from both_sides where not no_image and not no_frame and groups <> [coalesce(one.grp, '-')]
union all select path, 'truth' from both_sides where not no_image and not no_frame and truth <> one.truth
union all select path, 'repeated' from both_sides where not no_image and not no_frame and repeated""",
    "manifest_violations": f"""with {_MANIFEST}, rule as (
  select path, unnest(list_filter([
    case when coalesce(trim(sourceid, {_BLANKS}), '') = '' then 'blank source' end,
    case when groupid is null then 'blank group' end,
    case when split not in ('train', 'valid', 'test') then 'unknown split' end,
    case when len(list_filter(objects, lambda o: o.classid is null or o.classid not between 0 and 9)) > 0 then 'class out of range' end,
    case when len(list_filter(objects, lambda o: not coalesce(len(o.bbox) = 4 and o.bbox[1] >= 0 and o.bbox[2] >= 0 and o.bbox[3] > 0 and o.bbox[4] > 0
      and o.bbox[1] + o.bbox[3] <= 1 + 1e-9 and o.bbox[2] + o.bbox[4] <= 1 + 1e-9, false))) > 0 then 'box outside image' end], lambda r: r is not null)) as rule from m)
select path, rule from rule
union all select path, 'repeated path' from m where path in (select path from m group by path having count(*) > 1)
union all select path, 'repeated sha256' from m where sha256 in (select sha256 from m group by sha256 having count(*) > 1)
union all select path, 'group in several splits' from m where groupid in (select groupid from m group by groupid having count(distinct split) > 1)""",
    "manifest_report": f"""with {_MANIFEST}, o as (select unnest(objects).classid as classid from m)
select 'images' as measure, count(*) as value from m union all select 'groups', count(distinct groupid) from m
union all select 'negatives', count(*) from m where coalesce(len(objects), 0) = 0
union all select 'objects:' || slug, count(o.classid) from taxonomy left join o using (classid) group by slug""",
    "split_summary": f"""with {_MANIFEST}, x as (select split, groupid, sourceid, coalesce(len(objects), 0) as n,
    coalesce(len(list_distinct(list_transform(objects, lambda o: o.classid))), 0) as k from m)
select split, count(*) as images, count(distinct groupid) as groups, count(distinct sourceid) as sources, sum(n)::bigint as objects,
  count(*) filter (n = 0) as negatives, count(*) filter (n > 5) as above_cap, count(*) filter (k > 1) as mixed_class,
  {", ".join(f"count(*) filter (n = {i}) as with_{i}" for i in range(6))} from x group by split""",
    "class_spread": f"""with {_MANIFEST}, o as (select split, groupid, path, unnest(objects).classid as classid from m),
n as (select split, classid, count(*) as objects, count(distinct path) as images, count(distinct groupid) as groups from o group by all)
select s.split, t.classid, coalesce(objects, 0) as objects, coalesce(images, 0) as images, coalesce(groups, 0) as groups
from (select distinct split from m) s cross join taxonomy t left join n on s.split is not distinct from n.split and t.classid = n.classid""",
    "spelling_conflicts": f"""with x as (select source.id as s, {_same('source.id')} as key from drive_inventory)
select key, count(distinct s) as spellings, count(*) as n from x where key is not null group by key having count(distinct s) > 1""",
    "yolo_lines": f"""with {_MANIFEST}, o as (select path, objects, unnest(range(1, len(objects) + 1)) as k from m), b as (select path, k, objects[k].classid as c, objects[k].bbox as b from o)
select path, (k - 1)::int as instance, format('{{}} {{:.9f}} {{:.9f}} {{:.9f}} {{:.9f}}', c, b[1] + b[3] / 2, b[2] + b[4] / 2, b[3], b[4]) as line from b""",
    "letterbox": f"""with {_IMAGES}, s as (select distinct width, height, least(416.0::double / width, 416.0::double / height) as r, width::double / height as ratio from image where width > 0 and height > 0),
g as (select *, greatest(1, floor(width * r + 0.5))::int as w, greatest(1, floor(height * r + 0.5))::int as h from s)
select width, height, w, h, floor((416 - w) / 2)::int as left, floor((416 - h) / 2)::int as top,
  round(case when ratio >= 4.0::double / 3 then 100.0::double else ratio / (4.0::double / 3) * 100 end, 6) as preview_w,
  round(case when ratio >= 4.0::double / 3 then (4.0::double / 3) / ratio * 100 else 100.0::double end, 6) as preview_h from g""",
    "padded_crop": f"""with {_IMAGES}, {_MANIFEST}, o as (select image_id, objects, unnest(range(1, len(objects) + 1)) as k from m),
b as (select image_id, k, objects[k].bbox as b from o where len(objects[k].bbox) = 4),
c as (select image_id, k, greatest(floor((b[1] - b[3] * 0.1::double) * width), 0)::int as l, greatest(floor((b[2] - b[4] * 0.1::double) * height), 0)::int as t,
  least(ceil((b[1] + b[3] * 1.1::double) * width), width)::int as r, least(ceil((b[2] + b[4] * 1.1::double) * height), height)::int as bt from b join image using (image_id))
select image_id, (k - 1)::int as instance, case when r > l and bt > t then l end as left, case when r > l and bt > t then t end as top,
  case when r > l and bt > t then r end as right, case when r > l and bt > t then bt end as bottom from c""",
    "best_overlap": """with f as (select path, batch_no, truth, detections from frame_prediction where path is not null
    qualify row_number() over (partition by path, batch_no order by arrived_at desc) = 1),
t as (select path, flatten(list(truth)) as truth from f where len(truth) > 0 group by path),
d as (select path, batch_no, unnest(detections) as d from f)
select path, batch_no, d.anchor as anchor, round(list_max(list_transform(truth, lambda t: """
    + _iou("d.box", "t.box")
    + """)), 9) as iou from d join t using (path)""",
    "class_weights": """select label, count(*) as n, round((select count(*) from embeddings where label is not null) / (10.0::double * count(*)), 9) as weight
  from embeddings where label is not null group by label""",
    "early_stopping": """with h as (select o_orderpriority as run, ((year(o_orderdate) - 1992) * 12 + month(o_orderdate))::int as epoch, count(*)::double as score from orders group by all),
a as (select *, row_number() over w as pos, max(score) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as seen from h window w as (partition by run order by epoch)),
b as (select *, max(score) over w as best, max(case when seen is null or score > seen then pos end) over w as last, min((epoch = pos)::int) over w as ok from a
  window w as (partition by run order by epoch rows between unbounded preceding and current row))
select run, epoch, score, best, (pos - last)::int as stale, pos - last >= 8 as stop, ok = 1 as contiguous from b""",
    "catalog_search": """select p_partkey, p_name, p_type, p_brand from part where p_type = 'LARGE' and contains(lower(p_name || ' ' || p_brand), 'large ring')""",
    "catalog_families": "select p_type, min(p_partkey) as first_seen from part group by p_type",
    "systematic_sample": """with x as (select doc_id, source, row_number() over (order by doc_id) - 1 as pos, greatest(1, count(*) over () // 48) as k from documents)
select doc_id, source from x where pos % k = 0 and pos < 48 * k""",
    "json_fingerprints": "select event_id, sha256(replace(props, ' ', '')) as fingerprint from events",
    "dataset_identity": f"""with {_IMAGES}, p as (select sha256(path || chr(10) || coalesce(sha256, '')) as p from image)
select count(*) as files, {", ".join(f"sum(('0x' || substr(p, {1 + 8 * i}, 8))::bigint)::bigint as part{i}" for i in range(4))} from p""",
    "normalized_addresses": f"""with {_IMAGES} select image_id, replace(url_encode(path), '%2F', '/') as address from image""",
}
