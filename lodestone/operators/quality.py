"""Inventories and manifests: differences, rules, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.checks import plain_text
from lodestone.functions.geometry import box_inside
from lodestone.functions.paths import safe_path
from lodestone.functions.text import strip
from lodestone.operators.rows import lookup_join

SPLITS = ("train", "valid", "test")


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with ``side``; as often as the difference is."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def is_subset(part: DataFrame, whole: DataFrame) -> bool:
    return part.exceptAll(whole).isEmpty()


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work that is wanted and not done: rows whose key isn't among the done ones. A null key is never done."""
    return wanted.join(done.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def verify_receipts(rows: DataFrame, files: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """``key, problem``: rows whose file is missing, files without a row, and pairs that differ in one of ``checks``."""
    a, b = rows.select(key, F.struct(*checks).alias("a")), files.select(key, F.struct(*checks).alias("b"))
    both = a.join(b, key, "full_outer")
    unequal = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in checks]
    found = F.when(F.col("b").isNull(), F.array(F.lit("missing"))).when(F.col("a").isNull(), F.array(F.lit("unexpected"))).otherwise(F.array_compact(F.array(*unequal)))
    return both.select(key, F.explode(found).alias("problem"))


def counts_against(rows: DataFrame, key: str, expected: DataFrame) -> DataFrame:
    """``key, found, expected, matches``: counts of a key beside ``expected`` (key, n), with those on one side only."""
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    both = found.join(expected.select(F.col(key).alias("__k"), F.col("n").cast("bigint").alias("expected")), F.col(key).eqNullSafe(F.col("__k")), "full_outer")
    out = both.select(F.coalesce(key, "__k").alias(key), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return out.withColumn("matches", F.col("found") == F.col("expected"))


def blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c)) == "", F.lit(True))


def manifest_violations(manifest: DataFrame, classes: int = 10) -> DataFrame:
    """``path, rule``: every broken rule of every row; messages of rules over several rows name each row of them.

    Rows: ``path, sourceid, groupid, sha256, split, objects``, with ``split`` and ``groupid`` as keys: equal where they
    count as equal, null where there is none. Rules: path and sha256 unique; source and group not blank; split known
    or null; classes in range; boxes of positive size within the image; no group in two splits. Null objects are none.
    """
    objects = F.coalesce("objects", F.array().cast(manifest.schema["objects"].dataType))
    here = F.array_compact(
        F.array(
            F.when(blank("sourceid"), "blank source"),
            F.when(blank("groupid"), "blank group"),
            F.when(F.col("split").isNotNull() & ~F.col("split").isin(*SPLITS), "unknown split"),
            F.when(F.exists(objects, lambda o: ~F.coalesce(o["classid"].between(0, classes - 1), F.lit(False))), "class out of range"),
            F.when(F.exists(objects, lambda o: ~box_inside(o["bbox"])), "box outside image"),
        )
    )
    found = manifest.select("path", F.explode(here).alias("rule"))
    n = manifest.count()

    def of_keys(key: str, keys: DataFrame, rule: str) -> DataFrame:
        rows = manifest.where(F.col(key).isNotNull()).select("path", F.col(key).alias("__key"))
        return lookup_join(rows, keys.select(F.col(key).alias("__key")), "__key", rows=n).select("path", F.lit(rule).alias("rule"))

    for key in ("path", "sha256"):
        found = found.unionByName(of_keys(key, manifest.groupBy(key).count().where(f"count > 1 and {key} is not null"), f"repeated {key}"))
    torn = manifest.where(~blank("groupid")).groupBy("groupid").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return found.unionByName(of_keys("groupid", torn, "group in several splits"))


def inventory_violations(images: DataFrame, classes: int = 10, least_side: int = 16) -> DataFrame:
    """``path, rule``: every broken rule of every row of an inventory, as it must be before annotation.

    Rows: ``path, sourceid, classid, sha256, width, height``. Rules: the path is safe and no other row's in its portable
    form; the source is a plain text; the class is one of ``classes``; the digest is 64 hex digits and no other row's;
    both sides have ``least_side`` pixels. Null values break their rule.
    """
    rows = images.select("path", "sourceid", "classid", "sha256", "width", "height").withColumn("__safe", safe_path(F.col("path")))
    here = F.array_compact(
        F.array(
            F.when(F.col("__safe").isNull(), "unsafe path"),
            F.when(~plain_text(F.col("sourceid")), "source isn't plain text"),
            F.when(~F.coalesce(F.col("classid").between(0, classes - 1), F.lit(False)), "class out of range"),
            F.when(~F.coalesce(F.col("sha256").rlike(r"^[0-9a-f]{64}\z"), F.lit(False)), "invalid sha256"),
            F.when(~F.coalesce((F.col("width") >= least_side) & (F.col("height") >= least_side), F.lit(False)), "too small"),
        )
    )
    found = rows.select("path", F.explode(here).alias("rule"))
    n = rows.count()
    for key, rule in (("__safe", "repeated path"), ("sha256", "repeated sha256")):
        twice = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(F.col(key).alias("__key"))
        again = lookup_join(rows.where(F.col(key).isNotNull()).select("path", F.col(key).alias("__key")), twice, "__key", rows=n)
        found = found.unionByName(again.select("path", F.lit(rule).alias("rule")))
    return found


def reusable(cached: DataFrame, wanted: DataFrame, key: str, equal: list[str], sound: Column) -> DataFrame:
    """``key, reuse boolean``: whether what was derived before from each wanted row may be used again: it is there, its
    ``equal`` columns are as wanted (a null is like nothing), and it is ``sound``, a rule over its own columns."""
    have = cached.where(F.col(key).isNotNull()).select(key, *(F.col(c).alias(f"__c_{c}") for c in equal), F.coalesce(sound, F.lit(False)).alias("__sound"))
    both = wanted.select(key, *equal).join(have, key, "left")
    alike = F.col("__sound")
    for c in equal:
        alike = alike & (F.col(f"__c_{c}") == F.col(c))
    return both.groupBy(key).agg(F.coalesce(F.bool_or(alike), F.lit(False)).alias("reuse"))


def report_of(parts: dict[str, DataFrame], key: str, rule: str) -> DataFrame:
    """``part, rule, n``: the findings of several checks (each with columns ``key`` and ``rule``) in one table."""
    out = None
    for name, df in parts.items():
        one = df.groupBy(F.col(rule if rule in df.columns else "problem").alias("rule")).agg(F.countDistinct(key).alias("n")).select(F.lit(name).alias("part"), "rule", "n")
        out = one if out is None else out.unionByName(one)
    return out


def manifest_report(manifest: DataFrame, classes: DataFrame) -> DataFrame:
    """``measure, value``: images, groups, images without objects, and the objects of each class, zeros included.

    ``classes``: ``classid, slug``.
    """
    m = manifest.agg(
        F.count(F.lit(1)).alias("images"), F.countDistinct("groupid").alias("groups"), F.count_if(F.coalesce(F.size("objects"), F.lit(0)) <= 0).alias("negatives")
    )
    heads = m.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in m.columns))).alias("x")).select("x.*")
    objects = manifest.select(F.explode("objects").alias("o")).groupBy("o.classid").agg(F.count(F.lit(1)).alias("n"))
    per_class = classes.select("classid", "slug").join(objects, "classid", "left")
    return heads.unionByName(per_class.select(F.concat(F.lit("objects:"), "slug").alias("measure"), F.coalesce("n", F.lit(0)).cast("bigint").alias("value")))


def split_summary(manifest: DataFrame, most: int = 5) -> DataFrame:
    """A row for each split (as it stands: give keys): images, groups, sources, objects, images without objects, above ``most`` or of several
    classes, and images by their number of objects from 0 to ``most``."""
    n = F.greatest(F.coalesce(F.size("objects"), F.lit(0)), F.lit(0))
    kinds = F.size(F.array_distinct(F.coalesce("objects.classid", F.array().cast("array<int>"))))
    rows = manifest.withColumn("__n", n).withColumn("__k", kinds)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), F.countDistinct("groupid").alias("groups"), F.countDistinct("sourceid").alias("sources"), F.sum("__n").alias("objects"),
        F.count_if(F.col("__n") == 0).alias("negatives"), F.count_if(F.col("__n") > most).alias("above_cap"), F.count_if(F.col("__k") > 1).alias("mixed_class"),
        *(F.count_if(F.col("__n") == i).alias(f"with_{i}") for i in range(most + 1)),
    )


def class_spread(manifest: DataFrame, classes: DataFrame) -> DataFrame:
    """``split, classid, objects, images, groups`` for every split (as it stands: give keys) and class, zeros included."""
    splits = manifest.select("split").distinct()
    o = manifest.select("split", "groupid", "path", F.explode("objects").alias("o")).select("split", "groupid", "path", "o.classid")
    n = o.groupBy("split", "classid").agg(F.count(F.lit(1)).alias("objects"), F.countDistinct("path").alias("images"), F.countDistinct("groupid").alias("groups"))
    dense = splits.crossJoin(F.broadcast(classes.select("classid")))  # a handful of splits by the classes
    on = (F.col("d.split").eqNullSafe(F.col("n.split"))) & (F.col("d.classid") == F.col("n.classid"))
    joined = dense.alias("d").join(n.alias("n"), on, "left")
    return joined.select("d.split", "d.classid", *(F.coalesce(f"n.{c}", F.lit(0)).cast("bigint").alias(c) for c in ("objects", "images", "groups")))


def spelling_conflicts(df: DataFrame, column: str, key: Column) -> DataFrame:
    """``key, spellings, n``: values that count as the same text in more than one spelling; n is their rows."""
    per = df.where(F.col(column).isNotNull()).withColumn("__key", key).where("__key is not null")
    per = per.groupBy("__key", column).agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(F.col("__key").alias("key")).agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("n"))
    return g.where("spellings > 1")
