"""Frames evaluated against their truth: confusion, detector and frame measures, and the choice of thresholds."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.detections import CANDIDATES, MATCH_IOU, OBJECTS, match, suppress
from lodestone.functions.let import let
from lodestone.functions.logits import CLASSES, accepted, top_two
from lodestone.operators.positions import with_running
from lodestone.operators.rows import current_rows

#: Columns and rows of the confusion matrix beyond the classes.
BACKGROUND, REJECTED, MISSED = CLASSES, CLASSES, CLASSES + 1


@dataclass(frozen=True)
class Thresholds:
    detector: float = 0.25
    overlap: float = 0.45
    classifier: float = 0.65
    margin: float = 0.1


#: The thresholds tried, in their order.
GRID = {"detector": (0.15, 0.25, 0.35, 0.5), "overlap": (0.3, 0.45, 0.6), "classifier": (0.5, 0.65, 0.8), "margin": (0.0, 0.1, 0.2)}


def assemble(batches: DataFrame, *, least: float = 0.0, logits: bool = True, detections: bool = True) -> DataFrame:
    """``path, group_id, split, truth, detections``: one row for each frame from its batches.

    Of each batch the latest delivery counts. A frame has the truth of all its batches, in their order, and its best
    CANDIDATES valid detections with a score of at least ``least``, the most that suppression looks at: they are chosen
    before anything is gathered, so a frame of any number of batches fits. Null paths are no frames.

    Only what is asked for is read and moved: detections below ``least`` are left out before the first shuffle, their
    logits (then null) and all of them where they aren't needed.
    """
    fields = ["box", "score", "anchor", *(["logits"] if logits else [])]
    pairs = F.arrays_zip(*(F.col(f"detections.{f}").alias(f) for f in fields))
    good = F.filter(pairs, lambda d: d["score"].isNotNull() & ~F.isnan(d["score"]) & d["score"].between(least, 1.0))
    whole = F.transform(good, lambda d: F.struct(*(d[f].alias(f) for f in fields), *(() if logits else (F.lit(None).cast("array<double>").alias("logits"),))))
    columns = ["group_id", "split", "truth"]
    rows = batches.where("path is not null")
    if detections:
        rows = rows.select("path", "batch_no", "arrived_at", *columns, whole.alias("detections"))
        columns = [*columns, "detections"]
    # Arrays of structs with doubles are orderable, so copies and ties fall together.
    now = current_rows(rows, ["path", "batch_no"], "arrived_at", columns)
    heads = now.groupBy("path").agg(
        F.max("group_id").alias("group_id"),
        F.max("split").alias("split"),
        F.array_sort(F.collect_list(F.when(F.size("truth") > 0, F.struct("batch_no", "truth")))).alias("t"),
    )
    heads = heads.select("path", "group_id", "split", F.flatten(F.transform("t", lambda x: x["truth"])).alias("truth"))
    if not detections:
        return heads
    each = now.select("path", F.explode("detections").alias("d"))
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("d.score"), "d.anchor"))
    best = each.withColumn("rank", rank).where(F.col("rank") <= CANDIDATES).groupBy("path").agg(F.collect_list("d").alias("detections"))
    return heads.join(best, "path", "left").withColumn("detections", F.coalesce("detections", F.array().cast(best.schema["detections"].dataType)))


def judged(frames: DataFrame, detector: Column | float, overlap: Column | float) -> DataFrame:
    """Frames with ``survivors`` of suppression, ``objects`` (their first OBJECTS), and for both the matched truths."""
    f = _settled(frames, survivors=suppress(F.col("detections"), detector, overlap))
    f = _settled(f, objects=F.slice("survivors", 1, OBJECTS), matched_all=match(F.col("survivors"), F.col("truth")))
    return f.withColumn("matched", F.slice("matched_all", 1, OBJECTS))


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """With further columns that are worked out once for each row. The optimizer would write a plain projection into
    every place that uses it, also into lambdas, which then repeat it for each element; it doesn't merge a generator."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def outcomes(frames: DataFrame, classifier: Column | float, margin: Column | float) -> DataFrame:
    """Judged frames with ``cases``: for each object ``row`` (true class or BACKGROUND), ``col`` (predicted class or
    REJECTED) and ``accepted``; then for each truth without an object its class and MISSED.

    An object without valid logits can't be accepted.
    """

    def case(d: Column, i: Column) -> Column:
        best = top_two(d["logits"])
        yes = accepted(best, classifier, margin)
        t = F.get("matched", i)
        row = F.when(t >= 0, F.get("truth", t)["class_id"]).otherwise(BACKGROUND)
        return F.struct(row.alias("row"), F.when(yes, best["class_id"]).otherwise(REJECTED).alias("col"), yes.alias("accepted"), t.alias("t"))

    frames = _settled(frames, seen=F.transform("objects", case))
    missed = F.filter(
        F.transform("truth", lambda t, i: F.struct(t["class_id"].alias("row"), F.lit(MISSED).alias("col"), F.lit(False).alias("accepted"), i.alias("t"))),
        lambda m: ~F.array_contains("matched", m["t"]),
    )
    return _settled(frames, cases=F.concat("seen", missed))


def frame_cases(frames: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """A row for each frame: its objects, survivors, acceptances, whether it overflowed and was fully recognised."""
    f = outcomes(judged(frames, t.detector, t.overlap), t.classifier, t.margin)
    count = lambda good: F.size(F.filter("cases", good))
    right = count(lambda c: c["accepted"] & (c["row"] == c["col"]))
    wrong = count(lambda c: c["accepted"] & (c["row"] == BACKGROUND))
    return f.select(
        "path", "group_id", "split",
        F.size("truth").alias("truths"), F.size("survivors").alias("survivors"), F.size("objects").alias("objects"),
        F.size(F.filter("matched_all", lambda m: m >= 0)).alias("hits_all"), F.size(F.filter("matched", lambda m: m >= 0)).alias("hits"),
        count(lambda c: c["accepted"]).alias("accepted"), right.alias("correct"), wrong.alias("accepted_background"),
        (F.size("survivors") > OBJECTS).alias("overflow"),
        ((F.size("truth") > 0) & (right == F.size("truth")) & (wrong == 0)).alias("fully_recognized"),
    )


def confusion(frames: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``row, col, n``: the matrix of true against predicted classes, its empty cells included."""
    f = outcomes(judged(frames, t.detector, t.overlap), t.classifier, t.margin)
    cells = f.select(F.explode("cases").alias("c")).groupBy("c.row", "c.col").agg(F.count(F.lit(1)).alias("n"))
    return dense(cells, CLASSES + 1, CLASSES + 2)


def dense(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    grid = cells.sparkSession.range(rows * cols).select(F.expr(f"int(id div {cols})").alias("row"), F.expr(f"int(id % {cols})").alias("col"))
    return grid.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def class_measures(matrix: DataFrame) -> DataFrame:
    """``class_id, support, predicted, correct, precision, recall, f1`` of a matrix; support counts rejected and missed
    ones, predicted those on background. Without a denominator a measure is 0."""
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    ids = matrix.sparkSession.range(CLASSES).select(F.col("id").cast("int").alias("class_id"))
    support = matrix.groupBy(F.col("row").alias("class_id")).agg(F.sum("n").alias("support"))
    predicted = matrix.groupBy(F.col("col").alias("class_id")).agg(F.sum("n").alias("predicted"), F.sum(F.when(F.col("row") == F.col("col"), F.col("n")).otherwise(0)).alias("correct"))
    m = ids.join(support, "class_id", "left").join(predicted, "class_id", "left").na.fill(0)
    m = m.withColumn("precision", safe(F.col("correct"), F.col("predicted"))).withColumn("recall", safe(F.col("correct"), F.col("support")))
    return m.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_f1(measures: DataFrame) -> DataFrame:
    """The mean F1 of all classes, added up in the order of classes, so that equal inputs give equal sums."""
    order = F.array_sort(F.collect_list(F.struct("class_id", "f1")))
    return measures.agg((F.aggregate(order, F.lit(0.0), lambda a, m: a + m["f1"]) / CLASSES).alias("macro_f1"))


def detector_measures(cases: DataFrame) -> DataFrame:
    """Hits, misses and false alarms before and after the object cap; ratios are null without a denominator."""

    def stage(name: str, hits: str, boxes: str) -> DataFrame:
        sums = cases.agg(F.sum(hits).alias("hits"), F.sum(boxes).alias("boxes"), F.sum("truths").alias("truths"))
        return sums.select(
            F.lit(name).alias("stage"), "hits", (F.col("boxes") - F.col("hits")).alias("false_alarms"), (F.col("truths") - F.col("hits")).alias("misses"),
            F.try_divide("hits", "boxes").alias("precision"), F.try_divide("hits", "truths").alias("recall"),
        )

    return stage("after_suppression", "hits_all", "survivors").unionByName(stage("after_cap", "hits", "objects"))


def negative_frames(cases: DataFrame) -> DataFrame:
    """Frames without truth: how many accepted something, and how many boxes."""
    n = cases.where("truths = 0")
    return n.agg(
        F.count(F.lit(1)).alias("frames"), F.countDistinct("group_id").alias("groups"), F.count_if(F.col("accepted") > 0).alias("accepting_frames"),
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted_boxes"), F.try_divide(F.count_if(F.col("accepted") > 0), F.count(F.lit(1))).alias("rate"),
    )


def strata(cases: DataFrame) -> DataFrame:
    """Frames with 2 to 5 truths, for each number: frames, how many truths were recognised, frames recognised wholly."""
    ids = cases.sparkSession.range(2, OBJECTS + 1).select(F.col("id").cast("int").alias("truths"))
    s = cases.where(f"truths between 2 and {OBJECTS}").groupBy("truths").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("correct").alias("correct"), F.count_if("fully_recognized").alias("fully_recognized")
    )
    s = ids.join(s, "truths", "left").na.fill(0)
    return s.select("*", F.try_divide("correct", F.col("frames") * F.col("truths")).alias("coverage"), F.try_divide("fully_recognized", "frames").alias("full_rate"))


def totals(cases: DataFrame) -> DataFrame:
    s = cases.agg(
        F.count(F.lit(1)).alias("frames"), F.sum("truths").alias("truths"), F.sum("accepted").alias("accepted"), F.sum("correct").alias("correct"),
        F.count_if("overflow").alias("overflow_frames"), F.count_if("fully_recognized").alias("fully_recognized"),
    )
    return s.select("*", F.try_divide("correct", "accepted").alias("precision"), F.try_divide("correct", "truths").alias("coverage"))


def crop_samples(frames: DataFrame) -> DataFrame:
    """Every truth as a crop of its own: ``class_id`` and the two best classes of its logits."""
    return frames.select(F.explode("truth").alias("t")).select("t.class_id", top_two(F.col("t.logits")).alias("best"))


def crop_matrix(samples: DataFrame, t: Thresholds | None) -> DataFrame:
    """The matrix of crops: of all predictions, or with thresholds of accepted ones, others as REJECTED."""
    col = F.coalesce(F.col("best.class_id"), F.lit(REJECTED))
    if t:
        col = F.when(accepted(F.col("best"), t.classifier, t.margin), col).otherwise(REJECTED)
    cells = samples.groupBy(F.col("class_id").alias("row"), col.alias("col")).agg(F.count(F.lit(1)).alias("n"))
    return dense(cells, CLASSES, CLASSES + 1)


def threshold_grid(spark: SparkSession, grid: dict[str, tuple] = GRID) -> DataFrame:
    rows = [(i, *map(float, x)) for i, x in enumerate(product(*(grid[k] for k in ("detector", "overlap", "classifier", "margin"))))]
    return spark.createDataFrame(rows, "grid_idx int, detector double, overlap double, classifier double, margin double")


def grid_scores(frames: DataFrame, grid: dict[str, tuple] = GRID) -> DataFrame:
    """``grid_idx``, the thresholds, ``macro_f1, coverage, negative_accepts`` of every combination.

    Suppression and matching go from the best box down, so what they decide about a box doesn't depend on weaker ones:
    under a higher detector threshold the same boxes stay, without those below it. So both run once for each overlap
    with the lowest detector threshold, and for the objects only. Each object gives its best class, confidence and
    margin once, and equal outcomes are counted together before the other two thresholds are applied to the counts.
    """
    spark = frames.sparkSession
    overlaps = F.array(*(F.lit(float(o)) for o in grid["overlap"]))
    f = frames.select("path", "truth", "detections", F.explode(overlaps).alias("overlap"))
    f = _settled(f, objects=suppress(F.col("detections"), float(min(grid["detector"])), F.col("overlap"), OBJECTS))
    f = _settled(f, matched=match(F.col("objects"), F.col("truth")))
    inner = [(float(c), float(m)) for c, m in product(grid["classifier"], grid["margin"])]
    keys = ["detector", "overlap", "classifier", "margin"]
    # Bit i of ``yes``: the object is accepted under the i-th pair of classifier and margin.
    yes = lambda b: sum((F.when(accepted(b, c, m), 1 << i).otherwise(0) for i, (c, m) in enumerate(inner[1:], 1)), F.when(accepted(b, *inner[0]), 1).otherwise(0))

    def case(d: Column, i: Column) -> Column:
        t = F.get("matched", i)
        row = F.when(t >= 0, F.get("truth", t)["class_id"]).otherwise(BACKGROUND)
        best = top_two(d["logits"])
        return let(best, lambda b: F.struct(row.alias("row"), b["class_id"].alias("cls"), yes(b).alias("yes"), d["score"].alias("score"), t.alias("t")))

    f = _settled(f, all_seen=F.transform("objects", case)).select("overlap", "truth", "all_seen", F.explode(F.array(*(F.lit(float(d)) for d in grid["detector"]))).alias("detector"))
    f = _settled(f, seen=F.filter("all_seen", lambda s: s["score"] >= F.col("detector")))
    hits = F.transform("seen", lambda s: s["t"])
    f = f.select(
        "detector", "overlap", "seen", (F.size("truth") == 0).alias("negative"),
        F.filter(F.transform("truth", lambda t, i: F.struct(t["class_id"].alias("row"), i.alias("i"))), lambda m: ~F.array_contains(hits, m["i"])).alias("missed"),
    )
    f = f.withColumn("cells", F.transform("seen", lambda s: F.struct(s["row"].alias("row"), s["cls"].alias("cls"), s["yes"].alias("yes"))))
    none = F.array().cast("array<struct<row:int,cls:int,yes:int>>")
    cell = lambda row, cls, bits: F.struct(F.lit(row).cast("int").alias("row"), F.lit(cls).cast("int").alias("cls"), bits.cast("int").alias("yes"))
    any_yes = F.aggregate("cells", F.lit(0), lambda a, c: a.bitwiseOR(c["yes"]))
    cells = F.concat(
        F.col("cells").cast("array<struct<row:int,cls:int,yes:int>>"),
        F.transform("missed", lambda m: cell(m["row"], MISSED, F.lit(-1))),
        F.when(F.col("negative"), F.array(cell(-1, -1, any_yes))).otherwise(none),
    )
    n = f.select("detector", "overlap", F.explode(cells).alias("c")).groupBy("detector", "overlap", "c.row", "c.cls", "c.yes").agg(F.count(F.lit(1)).alias("n"))
    # From here on only counts are left, whatever the number of frames.
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("classifier"), F.lit(m).alias("margin")) for i, (c, m) in enumerate(inner)))
    n = n.withColumn("q", F.explode(pairs)).select("*", F.expr("shiftright(yes, q.i) & 1 = 1").alias("ok"), "q.classifier", "q.margin")
    m = n.where("row >= 0 or ok").select(*keys, "row", "n", F.when(F.col("ok") | (F.col("cls") < 0), F.col("cls")).otherwise(REJECTED).alias("col"))
    sums = m.groupBy(*keys).agg(
        *(F.sum(F.when(F.col("row") == c, F.col("n")).otherwise(0)).alias(f"s{c}") for c in range(CLASSES)),
        *(F.sum(F.when((F.col("col") == c) & (F.col("row") >= 0), F.col("n")).otherwise(0)).alias(f"p{c}") for c in range(CLASSES)),
        *(F.sum(F.when((F.col("row") == c) & (F.col("col") == c), F.col("n")).otherwise(0)).alias(f"c{c}") for c in range(CLASSES)),
        F.sum(F.when(F.col("row") == -1, F.col("n")).otherwise(0)).alias("negative_accepts"),
    )
    # 2tp / (support + predicted) is F1 up to rounding; the measures are kept apart so that equal cases stay equal.
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    f1 = F.lit(0.0)
    for c in range(CLASSES):
        p, r = safe(F.col(f"c{c}"), F.col(f"p{c}")), safe(F.col(f"c{c}"), F.col(f"s{c}"))
        f1 = f1 + safe(2 * p * r, p + r)
    correct, truths = (sum((F.col(f"{x}{c}") for c in range(1, CLASSES)), F.col(f"{x}0")) for x in "cs")
    scored = sums.select(*keys, (f1 / CLASSES).alias("macro_f1"), F.try_divide(correct, truths).alias("coverage"), "negative_accepts")
    return threshold_grid(spark, grid).join(scored, keys, "left").select("grid_idx", *keys, F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"), "coverage", F.coalesce("negative_accepts", F.lit(0)).alias("negative_accepts"))


def best_thresholds(scores: DataFrame) -> DataFrame:
    """The first combination with the greatest macro F1, then coverage (none counts as 0), then fewest false accepts."""
    return scores.orderBy(F.desc("macro_f1"), F.desc(F.coalesce("coverage", F.lit(0.0))), "negative_accepts", "grid_idx").limit(1)


def calibrate(frames: DataFrame, grid: dict[str, tuple] = GRID) -> DataFrame:
    """Thresholds chosen on validation frames only; any other split is refused, so that test frames can't be tuned on."""
    if frames.where("split <> 'valid' or split is null").limit(1).count():
        raise ValueError("thresholds are chosen on valid frames only")
    return best_thresholds(grid_scores(frames, grid))


#: The overlaps over which a detector's precision is averaged.
AP_OVERLAPS = tuple(i / 100 for i in range(50, 100, 5))


def average_precision(frames: DataFrame, least: tuple[float, ...] = (MATCH_IOU,), score: float = 0.001, overlap: float = 0.7) -> DataFrame:
    """``least, truths, boxes, hits, ap`` for each overlap that a match needs: the area under precision over recall of
    the detector alone, at 101 levels of recall.

    Boxes that survive suppression are matched frame by frame and then ranked by score over all frames, for all overlaps
    at once. The precision at a level is the best one at that recall or beyond. Only 101 numbers for each overlap are
    left before the last step. Null without truths.
    """
    spark = frames.sparkSession
    f = _settled(frames, survivors=suppress(F.col("detections"), score, overlap, CANDIDATES))
    f = _settled(f, **{f"hits{i}": match(F.col("survivors"), F.col("truth"), t) for i, t in enumerate(least)})
    tried = F.array(*(F.struct(F.lit(float(t)).alias("least"), F.transform(f"hits{i}", lambda h: (h >= 0).cast("int")).alias("hits")) for i, t in enumerate(least)))
    boxes = f.select("path", F.transform("survivors", lambda d: F.struct(d["score"].alias("score"), d["anchor"].alias("anchor"))).alias("s"), F.explode(tried).alias("t"))
    boxes = boxes.select("path", "t.least", F.explode(F.arrays_zip("s", F.col("t.hits").alias("hit"))).alias("b"))
    boxes = boxes.select("path", "least", "b.s.score", "b.s.anchor", "b.hit")
    ranked = with_running(boxes, ["least", F.desc("score"), "path", "anchor"], {"hits": "hit"})
    # What was counted under smaller overlaps, a row for each overlap.
    sums = [F.min(F.col("hits") - F.col("hit")).alias("__h"), F.min("position").alias("__p"), F.count(F.lit(1)).alias("boxes"), F.sum("hit").alias("found")]
    before = ranked.groupBy("least").agg(*sums)
    ranked = ranked.join(F.broadcast(before), "least")
    truths = frames.agg(F.coalesce(F.sum(F.size("truth")), F.lit(0)).alias("truths"))
    hits = F.col("hits") - F.col("__h")
    points = ranked.crossJoin(F.broadcast(truths)).where("hit = 1").select("least", (hits / (F.col("position") - F.col("__p") + 1)).alias("precision"), F.floor(hits * 100 / F.col("truths")).alias("level"))
    # The last level that a point's recall reaches: level i stands for i of 100.
    best = points.groupBy("least", "level").agg(F.max("precision").alias("precision"))
    all_least = spark.createDataFrame([(float(t),) for t in least], "least double")
    levels = all_least.crossJoin(spark.range(101).select(F.col("id").alias("level")))
    beyond = Window.partitionBy("least").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # 101 rows
    reached = levels.join(best, ["least", "level"], "left").select("least", F.max("precision").over(beyond).alias("p"))
    ap = reached.groupBy("least").agg((F.sum(F.coalesce("p", F.lit(0.0))) / 101).alias("ap"))
    n = before.select("least", "boxes", F.col("found").alias("hits"))
    out = ap.join(n, "least", "left").crossJoin(F.broadcast(truths)).na.fill(0, ["boxes", "hits"])
    return out.select("least", "truths", "boxes", "hits", F.when(F.col("truths") > 0, F.col("ap")).alias("ap"))
