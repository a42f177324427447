"""Queries over labels, reviews, pixels and rules for single values, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import checks, geometry, paths, pixels
from lodestone.functions.detections import decode, select_boxes
from lodestone.functions.documents import fingerprint, strict_variant
from lodestone.operators import catalog, quality, review
from lodestone.operators.positions import with_positions
from lodestone.operators.rows import current_rows
from lodestone.plans import inventory
from lodestone.plans.inventory import _BAD_PART, _IMAGES, _MANIFEST, _same, images, manifest, table
from lodestone.sources.documents import parse_mapping
from lodestone.sources.files import label_differences, metadata_problem, parse_labels


def _six(c):
    return F.round(c, 6)


def corner_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap and containment of each two objects of an image, by corners in pixels of 1000 by 1000."""
    o = manifest(spark, sf_dir).select("path", F.posexplode("objects").alias("i", "o")).where("size(o.bbox) = 4")
    b = F.col("o.bbox")
    o = o.select("path", "i", F.array(b[0] * 1000, b[1] * 1000, (b[0] + b[2]) * 1000, (b[1] + b[3]) * 1000).alias("r")).distinct()
    pairs = o.alias("x").join(o.alias("y"), (F.col("x.path") == F.col("y.path")) & (F.col("x.i") < F.col("y.i")))
    overlap, inside = geometry.iou_corners(F.col("x.r"), F.col("y.r"))
    return pairs.select("x.path", F.col("x.i").alias("a"), F.col("y.i").alias("b"), _six(overlap).alias("overlap"), _six(inside).alias("inside"))


def decoded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current batches as a detector's output on a square of 416 for images of 640 by 360, decoded from a score of 0.25."""
    t = table(spark, sf_dir, "frame_prediction").where("path is not null").select("path", "batch_no", "arrived_at", "detections.box", "detections.score")
    now = current_rows(t, ["path", "batch_no"], "arrived_at", ["box", "score"]).where("size(box) > 0")
    g = geometry.letterbox(F.lit(640), F.lit(360))
    rows = [
        F.transform("box", lambda b: g["left"] + (b["x"] + b["w"] / 2) * g["width"]), F.transform("box", lambda b: g["top"] + (b["y"] + b["h"] / 2) * g["height"]),
        F.transform("box", lambda b: b["w"] * g["width"]), F.transform("box", lambda b: b["h"] * g["height"]), F.col("score"),
    ]
    d = now.select("path", "batch_no", F.explode(decode(F.array(*rows), g, 0.25)).alias("d"))
    return d.select("path", "batch_no", "d.anchor", "d.score", *(_six(F.col(f"d.box.{c}")).alias(c) for c in "xywh"))


def selected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes worth labelling of each current batch, on images of 640 by 360."""
    t = table(spark, sf_dir, "frame_prediction").where("path is not null").select("path", "batch_no", "arrived_at", "detections")
    now = current_rows(t, ["path", "batch_no"], "arrived_at", ["detections"])
    good = F.filter("detections", lambda d: d["score"].isNotNull() & ~F.isnan(d["score"]) & d["score"].between(0.0, 1.0))
    b = lambda d: d["box"]
    c = F.transform(good, lambda d: F.struct(d["score"].alias("score"), F.array(b(d)["x"] * 640, b(d)["y"] * 360, (b(d)["x"] + b(d)["w"]) * 640, (b(d)["y"] + b(d)["h"]) * 360).alias("xyxy")))
    s = now.select("path", "batch_no", select_boxes(c, F.lit(640), F.lit(360)).alias("s"))
    return s.select("path", "batch_no", "s.mode", F.posexplode_outer("s.boxes").alias("k", "r")).select("path", "batch_no", "mode", "k", *(F.get("r", F.lit(i)).alias(n) for i, n in enumerate("xywh")))


def mapping_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rename mapping as lines of text, with arrows of both directions and comments, read back."""
    t = table(spark, sf_dir, "rename_mapping")
    old, new = F.col("source.originalpath"), F.col("newpath")
    kind = F.col("line_no") % 5
    line = F.when(kind == 0, F.concat(F.lit("# "), new)).when(kind == 1, F.concat(new, F.lit(" <- "), old)).otherwise(F.concat(old, F.lit(" -> "), new))
    return parse_mapping(t.select("line_no", F.coalesce(line, F.lit("?")).alias("value")))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's objects as label lines, by turns without their last number or with a word for one, read back."""
    lines = inventory.yolo_lines(spark, sf_dir).withColumnRenamed("path", "stem")
    turn = F.pmod(F.length("stem") + F.col("instance"), F.lit(6))
    line = F.when(turn == 0, F.regexp_replace("line", " [^ ]+$", "")).when(turn == 1, F.regexp_replace("line", "^[^ ]+", "x")).otherwise(F.col("line"))
    return parse_labels(lines.select("stem", "instance", line.alias("line")))


def label_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of images of one object against the manifest: by turns moved, of another class, or missing."""
    m = manifest(spark, sf_dir).where("size(objects) = 1 and size(objects[0].bbox) = 4 and path is not null")
    m = m.groupBy(F.col("path").alias("stem")).agg(F.min(F.struct(F.col("objects")[0]["classid"].alias("class_id"), F.col("objects")[0]["bbox"].alias("bbox"))).alias("o"))
    objects = m.select("stem", F.lit(0).alias("instance"), "o.class_id", "o.bbox")
    turn, b = F.pmod(F.length("stem"), F.lit(5)), F.col("bbox")
    labels = objects.where(turn != 0).select(
        "stem", "instance", F.when(turn == 1, F.col("class_id") + 1).otherwise(F.col("class_id")).alias("class_id"), (b[0] + b[2] / 2 + F.when(turn == 2, 0.001).otherwise(0.0)).alias("cx"),
        (b[1] + b[3] / 2).alias("cy"), b[2].alias("w"), b[3].alias("h"),
    )
    return label_differences(labels, objects)


def strict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as documents, by turns with a byte order mark, a key twice, NaN or cut short: which are valid."""
    turn, p = F.col("event_id") % 7, F.col("props")
    doc = F.when(turn == 0, F.concat(F.lit("\ufeff"), p)).when(turn == 1, F.concat(F.lit('{"k": 0, '), F.substring(p, 2, 1 << 20))).when(turn == 2, F.replace(p, F.lit("{"), F.lit('{"n": NaN, ')))
    doc = doc.when(turn == 3, F.substring(p, 1, 4)).otherwise(p)
    return table(spark, sf_dir, "events").select("event_id", strict_variant(doc).isNotNull().alias("valid"), fingerprint(doc).isNotNull().alias("fingerprinted"))


def metadata_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as metadata texts, by turns holding NUL or beginning as a page of HTML: how many have which problem."""
    turn = F.col("doc_id") % 9
    text = F.when(turn == 0, F.concat("text", F.lit("\x00"))).when(turn == 1, F.concat(F.lit(" <HTML>"), "text")).otherwise(F.col("text"))
    content = F.encode(text, "UTF-8")
    rows = table(spark, sf_dir, "documents").where("text is not null").select(metadata_problem(content, F.length(content)).alias("problem"))
    return rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def _gray(row):
    return F.transform(F.slice("embedding", row * 8 + 1, 8), lambda v: F.floor(F.abs(v.cast("double")) * 1000).cast("int"))


def difference_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as grey images of 8 rows, the ninth pixel of each being its first again, and their hashes."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.concat(_gray(r), F.slice(_gray(r), 1, 1)))
    return table(spark, sf_dir, "embeddings").select("vec_id", pixels.difference_hash(rows).alias("hash"))


def normalized_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as 21 pixels, as planes of a tensor: their least, greatest and mean value."""
    at = lambda i: F.floor(F.abs(F.get("embedding", i).cast("double")) * 255)
    rgb = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.array(at(p * 3), at(p * 3 + 1), at(p * 3 + 2)))
    t = pixels.normalized_tensor(rgb, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(t).alias("plane", "v"))
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return p.select("vec_id", "plane", *(F.round(c.cast("double"), 4).alias(n) for n, c in (("low", F.array_min("v")), ("high", F.array_max("v")), ("mean", mean))))


def output_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings against themselves with two decimals: the largest error, and whether it is within 2 % of their scale."""
    rounded = F.transform("embedding", lambda v: F.round(v.cast("double"), 2))
    exact = F.transform("embedding", lambda v: v.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", pixels.largest_error(exact, rounded).alias("error"), F.array_max(F.transform(exact, F.abs)).alias("scale"))
    return e.select("vec_id", F.round("error", 9).alias("error"), (F.col("error") <= 0.02 * F.col("scale")).alias("within"))


def pixel_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", pixels.pixel_digest(F.col("p_size"), F.lit(1), F.encode("p_name", "UTF-8")).alias("digest"))


def task_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a labelling task: SHA-256 of its path and digest as a canonical list."""
    m = table(spark, sf_dir, "manifest").select("path", "sha256").distinct()
    return m.select("path", "sha256", fingerprint(F.to_json(F.array("path", "sha256"), {"ignoreNullFields": "false"})).alias("task_key"))


def value_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for single values over the drive's listing: how many rows keep each."""
    t = table(spark, sf_dir, "drive_inventory").select("driveid", "bytes", F.col("source.id").alias("id"), F.col("source.originalpath").alias("former"))
    rules = {
        "plain_text": checks.plain_text(F.col("id")), "composed_text": checks.composed_text(F.col("id")), "whole_number": checks.whole_number(F.col("bytes").cast("double"), 1),
        "finite_number": checks.finite_number(F.col("bytes").cast("double"), 0, 1e6), "task_id": checks.task_id(F.col("bytes").cast("string")), "identifier": paths.identifier(F.col("driveid")),
    }
    return t.agg(*(F.count_if(c).alias(n) for n, c in rules.items()))


def field_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed fields of the events' properties: those that a name outside k and v makes invalid."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.replace("props", F.lit("k"), F.lit("q"))).otherwise(F.col("props")).alias("props"))
    return e.select("event_id", checks.field_problem(F.col("props"), ["k"], ["v"]).alias("problem"))


def catalog_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.others(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 2)


def catalog_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 7").select(F.col("n_nationkey").cast("int").alias("classid"), F.col("n_name").alias("description"))
    return catalog.describe(table(spark, sf_dir, "taxonomy"), nations, "classid")


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(images(spark, sf_dir, "path").select("image_id", "path"), ["path", "image_id"])


def exported_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the manifest as exported tasks, against the images of the inventory as expected ones."""
    return review.expected_tasks(table(spark, sf_dir, "manifest").select("image_id"), images(spark, sf_dir).select("image_id"), "image_id")


def reviewer_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the manifest whose images differ in split or source, as reviews of one task would."""
    return review.disagreements(manifest(spark, sf_dir).where("groupid is not null"), "groupid", ["split", "sourceid"])


def shared_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of the manifest that belong to more than one group, as annotations may to tasks."""
    return review.shared_ids(manifest(spark, sf_dir).where("sourceid is not null and groupid is not null"), "sourceid", "groupid")


def _export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Expected images and an export of their reviews: the manifest's objects as rectangles, and by turns of twelve each
    fault that a review may have."""
    o = manifest(spark, sf_dir).groupBy("image_id").agg(F.min(F.struct(F.coalesce("groupid", F.lit("")).alias("grp"), "objects")).alias("m"))
    sizes = images(spark, sf_dir, "width", "height").select("image_id", "width", "height")
    rows = o.join(sizes, "image_id").select("image_id", "m.grp", F.coalesce("m.objects", F.array().cast("array<struct<classid:int,bbox:array<double>>>")).alias("o"), "width", "height")
    turn, null = F.col("image_id") % 12, F.lit(None)
    slugs = F.lit([r.slug for r in table(spark, sf_dir, "taxonomy").orderBy("classid").collect()])  # ten rows

    def control(name: str, kind: str, values):
        rect = lambda c: values.get(c, null).cast("double").alias(c)
        words = lambda c: values.get(c, null).cast("array<string>").alias(c)
        value = F.struct(*(rect(c) for c in ("x", "y", "width", "height", "rotation")), *(words(c) for c in ("rectanglelabels", "choices", "text")))
        return F.struct(
            F.lit(name).alias("id"), F.lit(name).alias("from_name"), F.lit(kind).alias("type"), F.lit("manual").alias("origin"),
            F.col("width").alias("original_width"), F.col("height").alias("original_height"), F.lit(0.0).alias("image_rotation"), value.alias("value"),
        )

    def rectangle(b):
        label = F.when(turn == 9, F.lit("?")).otherwise(F.coalesce(F.get(slugs, b["classid"]), F.lit("?")))
        side = {c: F.get(b["bbox"], F.lit(i)) * 100 for i, c in enumerate(("x", "y", "width", "height"))}
        return control("bbox", "rectanglelabels", side | {"rotation": F.lit(0.0), "rectanglelabels": F.array(label)})

    def annotation(decision, name: str):
        exclude = decision == "exclude"
        boxes = F.when(exclude, F.slice("o", 1, 0)).otherwise(F.col("o"))
        group = F.when(~exclude & (turn != 7), F.array("grp")).otherwise(F.array().cast("array<string>"))
        reason = F.when(exclude & (turn != 5), F.array(F.lit(" blurred "))).otherwise(F.array().cast("array<string>"))
        rest = [control("decision", "choices", {"choices": F.array(decision)}), control("groupId", "textarea", {"text": group}), control("reason", "textarea", {"text": reason}),
                control("reviewed", "choices", {"choices": F.array(F.lit("yes"))})]
        return F.struct(F.lit(name).alias("id"), (turn == 10).alias("was_cancelled"), F.concat(F.transform(boxes, rectangle), F.array(*rest)).alias("result"))

    usual = F.when(turn == 6, "negative").when(turn.isin(4, 5), "exclude").when(F.size("o") > 0, "include").otherwise("negative")
    both = F.when(turn == 8, F.array(annotation(usual, "1"), annotation(F.lit("exclude"), "2"))).otherwise(F.array(annotation(usual, "1")))
    tasks = rows.where(turn != 0).select(
        F.col("image_id").cast("string").alias("key"), (turn != 2).alias("is_labeled"), F.when(turn == 3, 1).otherwise(0).alias("drafts"), both.alias("annotations")
    )
    export = tasks.unionByName(tasks.where(F.col("key").cast("bigint") % 12 == 1))
    return rows.select(F.col("image_id").cast("string").alias("key"), "width", "height"), export


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.lit([r.slug for r in table(spark, sf_dir, "taxonomy").orderBy("classid").collect()])  # ten rows
    return review.review_outcomes(*_export(spark, sf_dir), names)


def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _outcomes(spark, sf_dir)
    return r.select("key", "outcome", "reason", "review.decision", F.col("review.group_id").alias("group_id"), F.size("review.objects").alias("objects"))


def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_counts(_outcomes(spark, sf_dir))


def exclusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that weren't accepted, by reason."""
    r = _outcomes(spark, sf_dir).where("outcome <> 'accepted'")
    return r.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by how sure their boxes are and how many there are."""
    r = selected_boxes(spark, sf_dir).groupBy("path", "batch_no", "mode").agg(F.count("k").alias("boxes"))
    return r.groupBy("mode", "boxes").agg(F.count(F.lit(1)).alias("n"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = images(spark, sf_dir, "path", "source", "classid", "sha256", "width", "height")
    return t.withColumn("sourceid", F.col("source.id"))


def inventory_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.inventory_violations(_inventory(spark, sf_dir))


def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings about the inventory and the manifest: how many paths break each rule."""
    m = quality.manifest_violations(manifest(spark, sf_dir))
    return quality.report_of({"inventory": inventory_violations(spark, sf_dir), "manifest": m}, "path", "rule")


def reusable_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the drive whose audited derivative may be used again: same bytes, sides of 16 pixels, hashes in form."""
    listed = table(spark, sf_dir, "drive_inventory").where("kind = 'image' and path is not null").select("path", "listedat", "sha256")
    wanted = current_rows(listed, ["path"], "listedat", ["sha256"])
    cached = images(spark, sf_dir, "originalpath", "originalsha256", "width", "height", "digest", "hash", "exiforientation")
    cached = cached.select(F.col("originalpath").alias("path"), F.col("originalsha256").alias("sha256"), "width", "height", "digest", "hash")
    sound = (F.least("width", "height") >= 16) & F.col("width").isNotNull() & F.col("height").isNotNull() & F.col("digest").isNotNull() & F.col("hash").isNotNull()
    return quality.reusable(cached, wanted, "path", ["sha256"], sound)


def annotation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks of a labelling tool: address, key and proposed class of each image whose row keeps all rules."""
    rows = _inventory(spark, sf_dir)
    good = rows.join(quality.inventory_violations(rows).select("path").distinct(), "path", "left_anti")
    key = fingerprint(F.to_json(F.array(F.lit("annotation-v1"), "path", "sourceid", "sha256"), {"ignoreNullFields": "false"}))
    t = good.select("path", paths.quoted_path(F.col("path")).alias("address"), key.alias("task_key"), "classid", "width", "height")
    return t.join(F.broadcast(table(spark, sf_dir, "taxonomy").select("classid", "slug")), "classid", "left")  # ten rows


def import_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the inventory that the manifest doesn't hold yet, in batches of a hundred."""
    return review.import_batches(images(spark, sf_dir).select("image_id"), table(spark, sf_dir, "manifest"), "image_id")


def backdrop_alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings read as 21 pixels, and the opacity of each before a blue backdrop."""
    at = lambda i: F.floor(F.abs(F.get("embedding", i).cast("double")) * 255)
    rgb = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.array(at(p * 3), at(p * 3 + 1), at(p * 3 + 2)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.transform(rgb, pixels.backdrop_alpha)).alias("pixel", "alpha"))
    return e


QUERIES = {
    f.__name__: f
    for f in (
        corner_overlaps, decoded_boxes, selected_boxes, mapping_lines, difference_hashes, normalized_planes, output_parity, pixel_digests, task_keys, value_checks,
        field_problems, catalog_others, catalog_described, canonical_order, exported_tasks, reviewer_disagreements, shared_sources, review_outcomes, review_counts,
        exclusion_counts, label_histogram, inventory_violations, audit_report, reusable_derivatives, annotation_tasks, import_batches, backdrop_alphas,
        label_lines, label_problems, strict_documents, metadata_problems,
    )
}

_NOW = """now as (select path, batch_no, detections from frame_prediction where path is not null
  qualify row_number() over (partition by path, batch_no order by arrived_at desc) = 1)"""


def _safe(column: str) -> str:
    """The portable form of a safe path, after white space at its ends is gone."""
    p = f"replace({column}, '\\', '/')"
    return f"""case when {column} <> '' and not starts_with({p}, '/') and len(list_filter(string_split({p}, '/'), lambda p: {_BAD_PART})) = 0 then {p} end"""


def _covered(k: str, r: str) -> str:
    shared = f"(greatest(least({k}[3], {r}[3]) - greatest({k}[1], {r}[1]), 0.0::double) * greatest(least({k}[4], {r}[4]) - greatest({k}[2], {r}[2]), 0.0::double))"
    area = lambda b: f"(({b}[3] - {b}[1]) * ({b}[4] - {b}[2]))"
    return f"({shared} / ({area(k)} + {area(r)} - {shared} + 1e-9) > 0.5 or {shared} / (least({area(k)}, {area(r)}) + 1e-9) > 0.85)"


_KEPT = f"""list_reduce(list_concat([[]::double[][]], list_transform(c, lambda x: [[x.s], x.r])), lambda acc, x: case
    when len(acc) >= 5 or x[2][3] - x[2][1] < 0.03 * 640 or x[2][4] - x[2][2] < 0.03 * 360 or (len(acc) > 0 and x[1][1] < greatest(0.3, best * 0.5))
      or len(list_filter(acc, lambda k: {_covered('k', 'x[2]')})) > 0 then acc else list_append(acc, x[2]) end)"""
_CLAMP = "[least(greatest(d.box.x * 640, 0), 640), least(greatest(d.box.y * 360, 0), 360), least(greatest((d.box.x + d.box.w) * 640, 0), 640), least(greatest((d.box.y + d.box.h) * 360, 0), 360)]"
_PIXEL = "floor(abs(embedding[{i}]::double) * 1000)"
_PLANE = "list_transform(range(0, 21), lambda p: ((floor(abs(embedding[p * 3 + {c} + 1]::double) * 255) / 255.0::double - {m}) / {d})::float)"
_LETTERBOX = (416, 234, 0, 91)  # width, height, left and top of 640 by 360 in a square of 416
#: The white space that texts hold at their ends.
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(5760) || chr(8232) || chr(8233) || chr(8239) || chr(12288)"
_REVIEWED = f"""{_IMAGES}, {_MANIFEST},
one as (select image_id, arg_min(m, {{'g': coalesce(groupid, ''), 'o': objects}}) as m from m group by image_id),
r as (select image_id, image_id % 12 as turn, coalesce(one.m.groupid, '') as grp, coalesce(one.m.objects, []) as o from one join image using (image_id)),
s as (select *, case when turn = 6 then 'negative' when turn in (4, 5) then 'exclude' when len(o) > 0 then 'include' else 'negative' end as decision,
    len(list_filter(o, lambda b: turn = 9 or b.classid is null or b.classid not between 0 and 9 or not coalesce(b.bbox[1] >= 0 and b.bbox[2] >= 0 and b.bbox[3] > 0 and b.bbox[4] > 0
      and b.bbox[1] * 100 / 100 + b.bbox[3] * 100 / 100 <= 1 + 1e-9 and b.bbox[2] * 100 / 100 + b.bbox[4] * 100 / 100 <= 1 + 1e-9, false))) as bad from r),
e as (select *, case when turn = 0 then 'error:not exported' when turn = 1 then 'error:exported twice' when turn = 2 then 'pending:not labelled' when turn = 3 then 'pending:draft'
    when turn = 10 then 'pending:no annotation' when decision <> 'exclude' and bad > 0 then 'error:rectangle' when turn = 5 then 'pending:no reason'
    when decision <> 'exclude' and (turn = 7 or grp = '') then 'pending:no group' when decision = 'negative' and len(o) > 0 then 'error:negative with boxes'
    when turn = 8 then 'error:reviews differ' end as wrong from s),
outcome as (select image_id::varchar as key, case when wrong is not null then split_part(wrong, ':', 1) when decision = 'exclude' then 'excluded' else 'accepted' end as outcome,
  nullif(split_part(wrong, ':', 2), '') as reason, case when wrong is null then decision end as decision, case when wrong is null and decision <> 'exclude' then grp end as group_id,
  case when wrong is null then case when decision = 'exclude' then 0 else len(o) end end::int as objects from e)"""

_ROWS = f"""rows as (select image_id, path, source.id as sourceid, classproposal.classid as classid, classproposal.slug as slug, sha256, width, height from normalized_inventory
  qualify row_number() over (partition by image_id order by auditedat desc) = 1),
safe as (select *, {_safe('path')} as safe from rows),
inventory_rule as (select path, unnest(list_filter([case when safe is null then 'unsafe path' end,
    case when not coalesce(sourceid <> '' and trim(sourceid, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) = sourceid and not regexp_matches(sourceid, '\\p{{C}}'), false) then 'source isn''t plain text' end,
    case when not coalesce(classid between 0 and 9, false) then 'class out of range' end,
    case when not coalesce(regexp_full_match(sha256, '[0-9a-f]{{64}}'), false) then 'invalid sha256' end,
    case when not coalesce(width >= 16 and height >= 16, false) then 'too small' end], lambda r: r is not null)) as rule from safe
  union all select path, 'repeated path' from safe where safe in (select safe from safe group by safe having count(*) > 1)
  union all select path, 'repeated sha256' from safe where sha256 in (select sha256 from safe group by sha256 having count(*) > 1))"""

SQL = {
    "corner_overlaps": f"""with {_MANIFEST}, o as (select path, objects, unnest(range(1, len(objects) + 1)) as i from m),
b as (select distinct path, i - 1 as i, [objects[i].bbox[1] * 1000, objects[i].bbox[2] * 1000, (objects[i].bbox[1] + objects[i].bbox[3]) * 1000, (objects[i].bbox[2] + objects[i].bbox[4]) * 1000] as r
  from o where len(objects[i].bbox) = 4),
p as (select x.path, x.i::int as a, y.i::int as b, x.r as k, y.r as r, greatest(least(x.r[3], y.r[3]) - greatest(x.r[1], y.r[1]), 0) * greatest(least(x.r[4], y.r[4]) - greatest(x.r[2], y.r[2]), 0) as s
  from b x join b y on x.path = y.path and x.i < y.i),
q as (select *, (k[3] - k[1]) * (k[4] - k[2]) as ka, (r[3] - r[1]) * (r[4] - r[2]) as ra from p)
select path, a, b, round(s / (ka + ra - s + 1e-9), 6) as overlap, round(s / (least(ka, ra) + 1e-9), 6) as inside from q""",
    "decoded_boxes": f"""with {_NOW}, ok as (select * from now where len(detections) > 0
  and len(list_filter(detections, lambda d: d.score is null or isnan(d.score) or not d.score between 0 and 1 or d.box is null)) = 0),
d as (select path, batch_no, k - 1 as anchor, detections[k].score as score, detections[k].box as b from (select *, unnest(range(1, len(detections) + 1)) as k from ok)),
g as (select *, {_LETTERBOX[2]} + (b.x + b.w / 2) * {_LETTERBOX[0]} as cx, {_LETTERBOX[3]} + (b.y + b.h / 2) * {_LETTERBOX[1]} as cy, b.w * {_LETTERBOX[0]} as w, b.h * {_LETTERBOX[1]} as h from d where score >= 0.25),
c as (select path, batch_no, anchor, score, least(greatest((cx - w / 2 - {_LETTERBOX[2]}) / {_LETTERBOX[0]}, 0), 1) as x1, least(greatest((cx + w / 2 - {_LETTERBOX[2]}) / {_LETTERBOX[0]}, 0), 1) as x2,
  least(greatest((cy - h / 2 - {_LETTERBOX[3]}) / {_LETTERBOX[1]}, 0), 1) as y1, least(greatest((cy + h / 2 - {_LETTERBOX[3]}) / {_LETTERBOX[1]}, 0), 1) as y2 from g where w > 0 and h > 0)
select path, batch_no, anchor::int as anchor, score, round(x1, 6) as x, round(y1, 6) as y, round(x2 - x1, 6) as w, round(y2 - y1, 6) as h from c where x2 > x1 and y2 > y1""",
    "selected_boxes": f"""with {_NOW}, good as (select path, batch_no, list_filter(detections, lambda d: d.score is not null and not isnan(d.score) and d.score between 0 and 1) as ds from now),
ranked as (select path, batch_no, list_transform(list_sort(list_transform(range(1, len(ds) + 1), lambda i: {{'n': -ds[i].score, 'i': i}})), lambda x: ds[x.i]) as ds from good),
c as (select path, batch_no, list_transform(ds, lambda d: {{'s': d.score, 'r': {_CLAMP}}}) as c, ds[1].score as best from ranked),
k as (select path, batch_no, case when coalesce(best, 0) < 0.1 then 'none' when best >= 0.3 then 'confident' else 'fallback' end as mode,
  case when coalesce(best, 0) < 0.1 then [] else {_KEPT} end as kept from c),
e as (select path, batch_no, mode, k, kept[k + 1] as r from (select *, unnest(case when len(kept) > 0 then range(0, len(kept)) else [null] end) as k from k)),
u as (select path, batch_no, mode, k::int as k, round(r[1] / 640, 6) as x, round(r[2] / 360, 6) as y, round((r[3] - r[1]) / 640, 6) as w, round((r[4] - r[2]) / 360, 6) as h from e)
select path, batch_no, mode, k, x, y, least(w, 1 - x) as w, least(h, 1 - y) as h from u""",
    "mapping_lines": f"""with l as (select line_no, coalesce(case line_no % 5 when 0 then '# ' || newpath when 1 then newpath || ' <- ' || source.originalpath else source.originalpath || ' -> ' || newpath end, '?') as t,
    source.originalpath as o, newpath as n from rename_mapping),
w as (select line_no, t = '?' as bad, trim(o, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) as o, trim(n, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) as n from l where not starts_with(t, '#')),
p as (select line_no, bad, case when not bad then {_safe('o')} end as old_path, case when not bad then {_safe('n')} end as new_path from w),
k as (select *, replace({_same('new_path')}, '\\', '\\') as key from p)
select line_no, old_path, new_path, case when bad then 'malformed' when old_path is null or new_path is null then 'unsafe path'
  when key is not null and count(*) over (partition by key) > 1 then 'repeated' end as problem from k""",
    "difference_hashes": "select vec_id, ("
    + " + ".join(
        f"((case when {_PIXEL.format(i=r * 8 + c + 1)} > {_PIXEL.format(i=r * 8 + (c + 1) % 8 + 1)} then 1 else 0 end)::hugeint << {63 - r * 8 - c})" for r in range(8) for c in range(8)
    )
    + " - case when "
    + f"{_PIXEL.format(i=1)} > {_PIXEL.format(i=2)} then 18446744073709551616::hugeint else 0 end)::bigint as hash from embeddings",
    "normalized_planes": "with p as ("
    + " union all ".join(f"select vec_id, {c} as plane, {_PLANE.format(c=c, m=m, d=d)} as v from embeddings" for c, m, d in ((0, 0.485, 0.229), (1, 0.456, 0.224), (2, 0.406, 0.225)))
    + ") select vec_id, plane, round(list_min(v)::double, 4) as low, round(list_max(v)::double, 4) as high, round(list_sum(list_transform(v, lambda x: x::double)) / len(v), 4) as mean from p",
    "output_parity": """with e as (select vec_id, list_max(list_transform(embedding, lambda v: abs(v::double - round(v::double, 2)))) as error, list_max(list_transform(embedding, lambda v: abs(v::double))) as scale from embeddings)
select vec_id, round(error, 9) as error, error <= 0.02::double * scale as within from e""",
    "pixel_digests": "select p_partkey, sha256('RGB:' || p_size || ':1:' || p_name) as digest from part",
    "task_keys": "select distinct path, sha256, sha256(to_json([path, sha256])::varchar) as task_key from manifest",
    "value_checks": """with t as (select driveid, bytes, source.id as id from drive_inventory)
select count(*) filter (id <> '' and trim(id, ' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) = id and not regexp_matches(id, '\\p{C}')) as plain_text, count(*) filter (nfc_normalize(id) = id) as composed_text,
  count(*) filter (bytes >= 1) as whole_number, count(*) filter (bytes between 0 and 1000000) as finite_number, count(*) filter (bytes > 0) as task_id,
  count(*) filter (regexp_full_match(driveid, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}')) as identifier from t""",
    "field_problems": "select event_id, case when props is null then 'not an object' when event_id % 7 = 0 then 'missing: k' end as problem from events",
    "catalog_others": "select p_partkey, p_name from part where p_partkey <> 2 order by p_partkey limit 4",
    "catalog_described": "select t.*, n_name as description from taxonomy t left join nation on classid = n_nationkey and n_nationkey < 7",
    "canonical_order": f"with {_IMAGES} select image_id, path, row_number() over (order by path, image_id) - 1 as position from image",
    "exported_tasks": """with e as (select distinct image_id from normalized_inventory where image_id is not null), n as (select image_id, count(*) as exported from manifest group by 1)
select coalesce(e.image_id, n.image_id) as image_id, coalesce(exported, 0) as exported,
  case when e.image_id is null then 'unknown' when exported is null then 'missing' when exported > 1 then 'repeated' else 'found' end as state from e full join n on e.image_id = n.image_id""",
    "reviewer_disagreements": f"""with {_MANIFEST}, v as (select groupid, split, sourceid, count(*) as n from m where groupid is not null group by all)
select groupid, sum(n)::bigint as reviews, count(*) as versions from v group by groupid having count(*) > 1""",
    "shared_sources": f"""with {_MANIFEST} select sourceid, count(distinct groupid) as tasks from m where sourceid is not null and groupid is not null group by sourceid having count(distinct groupid) > 1""",
    "review_outcomes": f"with {_REVIEWED} select * from outcome",
    "review_counts": f"""with {_REVIEWED} select count(*) as expected, count(*) filter (outcome = 'accepted') as accepted, count(*) filter (decision = 'include') as included,
  count(*) filter (decision = 'negative') as negative, count(*) filter (outcome = 'excluded') as excluded, count(*) filter (outcome = 'pending') as pending, count(*) filter (outcome = 'error') as error from outcome""",
}
SQL |= {
    "exclusion_counts": f"with {_REVIEWED} select outcome, reason, count(*) as n from outcome where outcome <> 'accepted' group by all",
    "label_histogram": f"with boxes as ({SQL['selected_boxes']}), b as (select path, batch_no, mode, count(k) as boxes from boxes group by all) select mode, boxes, count(*) as n from b group by all",
    "inventory_violations": f"with {_ROWS} select path, rule from inventory_rule",
    "audit_report": f"""with {_ROWS}, manifest_rule as ({inventory.SQL['manifest_violations']})
select 'inventory' as part, rule, count(distinct path) as n from inventory_rule group by all union all select 'manifest', rule, count(distinct path) from manifest_rule group by all""",
    "reusable_derivatives": f"""with {_IMAGES}, listed as (select path, sha256 from (select * from drive_inventory where kind = 'image' and path is not null)
  qualify row_number() over (partition by path order by listedat desc, sha256 desc nulls last) = 1),
c as (select originalpath as path, originalsha256 as sha256, width >= 16 and height >= 16 and digest is not null and hash is not null as sound from image where originalpath is not null)
select l.path, coalesce(bool_or(c.sound and c.sha256 = l.sha256), false) as reuse from listed l left join c on l.path = c.path group by l.path""",
    "annotation_tasks": f"""with {_ROWS} select path, replace(url_encode(path), '%2F', '/') as address, sha256(to_json(['annotation-v1', path, sourceid, sha256])::varchar) as task_key,
  r.classid, width, height, t.slug from rows r left join taxonomy t on r.classid = t.classid where path not in (select path from inventory_rule)""",
    "import_batches": """with i as (select distinct image_id from normalized_inventory where image_id is not null and image_id not in (select image_id from manifest where image_id is not null))
select image_id, (row_number() over (order by image_id) - 1) // 100 as batch from i""",
    "backdrop_alphas": """with p as (select vec_id, unnest(range(0, 21)) as k, embedding from embeddings),
c as (select vec_id, k, floor(abs(embedding[k * 3 + 1]::double) * 255) as r, floor(abs(embedding[k * 3 + 2]::double) * 255) as g, floor(abs(embedding[k * 3 + 3]::double) * 255) as b from p)
select vec_id, k::int as pixel, greatest(0, least(255, round_even(255 - greatest(0, b - (r + g) / 2.0::double - 4) * 16, 0)))::int as alpha from c""",
    "label_lines": f"""with l as ({inventory.SQL['yolo_lines']}),
p as (select path as stem, instance, string_split(line, ' ') as p, (len(path) + instance) % 6 as turn from l)
select stem, instance, case when turn <> 1 then p[1]::int end as class_id, p[2]::double as cx, p[3]::double as cy, p[4]::double as w, case when turn <> 0 then p[5]::double end as h,
  case when turn in (0, 1) then 'malformed line' end as problem from p""",
    "label_problems": f"""with {_MANIFEST}, o as (select path as stem, min({{'c': objects[1].classid, 'b': objects[1].bbox}}) as o from m where len(objects) = 1 and len(objects[1].bbox) = 4 and path is not null group by path)
select stem, 0 as instance, case len(stem) % 5 when 0 then 'missing line' when 1 then 'other class' else 'other box' end as problem from o where len(stem) % 5 in (0, 1, 2)""",
    "strict_documents": """select event_id, event_id % 7 not in (1, 2, 3) as valid, event_id % 7 not in (1, 2, 3) as fingerprinted from events""",
    "metadata_problems": f"""with d as (select case doc_id % 9 when 0 then text || chr(0) when 1 then ' <HTML>' || text else text end as t from documents where text is not null)
select case when trim(t, {_WHITE}) = '' then 'blank' when contains(t, chr(0)) then 'holds NUL' when starts_with(lower(trim(t, {_WHITE})), '<!doctype html') or starts_with(lower(trim(t, {_WHITE})), '<html') then 'HTML' end as problem,
  count(*) as n from d group by 1""",
}
