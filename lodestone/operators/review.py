"""Annotations of a labelling tool as tables: rectangles, choices, texts, agreement of reviewers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators.positions import with_positions
from lodestone.operators.quality import remaining

#: One result of an annotation, with the fields of all kinds of controls.
RESULT = (
    "struct<id:string,from_name:string,type:string,origin:string,original_width:int,original_height:int,image_rotation:double,"
    "value:struct<x:double,y:double,width:double,height:double,rotation:double,rectanglelabels:array<string>,choices:array<string>,text:array<string>>>"
)


def rectangles(results: Column, names: Column, width: Column, height: Column, control: str = "bbox") -> Column:
    """``class_id, bbox, problem`` of the rectangles of an annotation, in their order.

    Percents become parts of the image (-0 becomes 0); the label's position in ``names`` is the class. Problems: a
    label that isn't exactly one known, a rotation, other dimensions than the image's, a box not inside it.
    """

    def one(r: Column) -> Column:
        v = r["value"]
        bbox = F.array(*(v[c] / F.lit(100.0) + F.lit(0.0) for c in ("x", "y", "width", "height")))
        at = F.array_position(names, F.get(v["rectanglelabels"], F.lit(0))).cast("int") - 1
        inside = (v["x"] >= 0) & (v["y"] >= 0) & (v["width"] > 0) & (v["height"] > 0) & (bbox[0] + bbox[2] <= 1 + 1e-9) & (bbox[1] + bbox[3] <= 1 + 1e-9)
        problem = (
            F.when(~F.coalesce((F.size(v["rectanglelabels"]) == 1) & (at >= 0), F.lit(False)), "label")
            .when((F.coalesce(v["rotation"], F.lit(0.0)) != 0) | (F.coalesce(r["image_rotation"], F.lit(0.0)) != 0), "rotation")
            .when(~F.coalesce((r["original_width"] == width) & (r["original_height"] == height), F.lit(False)), "dimensions")
            .when(~F.coalesce(inside, F.lit(False)), "box")
        )
        return F.struct(at.alias("class_id"), bbox.alias("bbox"), problem.alias("problem"))

    return F.transform(F.filter(results, lambda r: r["from_name"] == control), one)


def single_choice(results: Column, control: str) -> Column:
    """The choice of a control that has exactly one, else null."""
    mine = F.filter(results, lambda r: r["from_name"] == control)
    choices = F.get(mine, F.lit(0))["value"]["choices"]
    return F.when((F.size(mine) == 1) & (F.size(choices) == 1), F.get(choices, F.lit(0)))


def single_text(results: Column, control: str) -> Column:
    """The trimmed text of a control that has exactly one, else null; blank is null too."""
    mine = F.filter(results, lambda r: r["from_name"] == control)
    texts = F.get(mine, F.lit(0))["value"]["text"]
    t = F.when((F.size(mine) == 1) & (F.size(texts) == 1), strip(F.get(texts, F.lit(0))))
    return F.when(t != "", t)


def disagreements(reviews: DataFrame, task: str, columns: list[str]) -> DataFrame:
    """``task, reviews, versions``: tasks whose reviews aren't all alike; arrays compare as they are ordered."""
    alike = reviews.groupBy(task, *columns).agg(F.count(F.lit(1)).alias("n"))
    g = alike.groupBy(task).agg(F.sum("n").alias("reviews"), F.count(F.lit(1)).alias("versions"))
    return g.where("versions > 1")


def expected_tasks(export: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``key, exported, state``: each expected task with how often it was exported (found, missing, repeated), and
    exported ones that aren't expected (unknown)."""
    n = export.groupBy(key).agg(F.count(F.lit(1)).alias("exported"))
    both = expected.select(key).distinct().withColumn("__e", F.lit(True)).join(n, key, "full_outer")
    state = F.when(F.col("__e").isNull(), "unknown").when(F.col("exported").isNull(), "missing").when(F.col("exported") > 1, "repeated").otherwise("found")
    return both.select(key, F.coalesce("exported", F.lit(0)).alias("exported"), state.alias("state"))


def shared_ids(annotations: DataFrame, annotation_id: str, task: str) -> DataFrame:
    """Annotation ids that belong to more than one task."""
    pairs = annotations.select(annotation_id, task).distinct()
    return pairs.groupBy(annotation_id).agg(F.count(F.lit(1)).alias("tasks")).where("tasks > 1")


def import_batches(tasks: DataFrame, known: DataFrame, key: str, size: int = 100) -> DataFrame:
    """``key, batch``: the tasks that the labelling tool doesn't know yet, in batches of ``size`` in the order of the key.
    What was imported is known the next time, so importing again goes on where it ended. Null keys are no tasks."""
    new = remaining(tasks.where(F.col(key).isNotNull()).select(key).distinct(), known, key)
    return with_positions(new, [key]).select(key, F.expr(f"position div {size}").alias("batch"))


#: One annotation of a task, and a task as a labelling tool exports it.
ANNOTATION = f"struct<id:string,was_cancelled:boolean,result:array<{RESULT}>>"
TASK = f"key string, is_labeled boolean, drafts int, annotations array<{ANNOTATION}>"
DECISIONS = ("include", "negative", "exclude")


def _first(*cases: tuple[Column, str, str]) -> Column:
    """The outcome and reason of the first condition that holds, else null; an unknown condition doesn't hold."""
    out = F.lit(None).cast("struct<outcome:string,reason:string>")
    for condition, outcome, reason in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def _judged(annotation: Column, names: Column, width: Column, height: Column) -> Column:
    """What is wrong with one annotation that isn't cancelled, and the review it gives."""
    results = annotation["result"]
    boxes = rectangles(results, names, width, height)
    decision, group, reason = single_choice(results, "decision"), single_text(results, "groupId"), single_text(results, "reason")
    some, exclude = F.size(boxes) > 0, decision == "exclude"
    problem = _first(
        (annotation["was_cancelled"].isNull(), "error", "no cancelled flag"),
        (F.exists(boxes, lambda b: b["problem"].isNotNull()), "error", "rectangle"),
        (~F.coalesce(single_choice(results, "reviewed") == "yes", F.lit(False)), "pending", "not reviewed"),
        (decision.isNull(), "pending", "no decision"),
        (~decision.isin(*DECISIONS), "error", "unknown decision"),
        (exclude & reason.isNull(), "pending", "no reason"),
        (exclude & some, "error", "excluded with boxes"),
        (~exclude & group.isNull(), "pending", "no group"),
        (~exclude & reason.isNotNull(), "error", "reason without exclusion"),
        ((decision == "include") & ~some, "pending", "no boxes"),
        ((decision == "negative") & some, "error", "negative with boxes"),
    )
    objects = F.array_sort(F.transform(boxes, lambda b: F.struct(b["class_id"].alias("class_id"), b["bbox"].alias("bbox"))))
    review = F.struct(decision.alias("decision"), group.alias("group_id"), reason.alias("reason"), objects.alias("objects"))
    return F.struct(problem.alias("problem"), review.alias("review"))


def review_outcomes(expected: DataFrame, export: DataFrame, names: Column) -> DataFrame:
    """``key, outcome, reason, review``: what came of each expected image: accepted, excluded, pending or error.

    ``expected``: ``key, width, height``, a row for each image; ``export``: tasks of form TASK. The first rule that
    fails decides, in this order: the task was exported, once; it is labelled and has no draft; then for each
    annotation that isn't cancelled, in its order: its rectangles are sound, it is reviewed and has a known decision; an
    exclusion has a reason and no boxes; any other has a group and no reason, boxes if included and none if negative.
    At least one such annotation is there, and all give the same review: decision, group, reason and boxes, whatever
    their order. ``review`` is null unless accepted or excluded. Null keys are no images; unknown tasks give nothing.
    """
    rows = export.where("key is not null")
    # Of a task exported several times none counts, so that one row is enough.
    tasks = rows.groupBy("key").agg(F.count(F.lit(1)).alias("__n"), *(F.first(c).alias(f"__{c}") for c in ("is_labeled", "drafts", "annotations")))
    both = expected.where("key is not null").select("key", "width", "height").join(tasks, "key", "left")
    live = F.filter("__annotations", lambda a: ~F.coalesce(a["was_cancelled"], F.lit(False)))
    both = both.withColumn("__seen", F.transform(live, lambda a: _judged(a, names, F.col("width"), F.col("height"))))
    wrong = F.get(F.filter("__seen", lambda s: s["problem"].isNotNull()), F.lit(0))["problem"]
    reviews = F.array_distinct(F.transform("__seen", lambda s: s["review"]))
    outcome = F.coalesce(
        _first(
            (F.col("__n").isNull(), "error", "not exported"), (F.col("__n") > 1, "error", "exported twice"),
            (~F.coalesce("__is_labeled", F.lit(False)), "pending", "not labelled"), (F.col("__drafts") > 0, "pending", "draft"),
        ),
        wrong,
        _first((F.coalesce(F.size("__seen"), F.lit(0)) <= 0, "pending", "no annotation"), (F.size(reviews) > 1, "error", "reviews differ")),
    )
    both = both.withColumn("__o", outcome).withColumn("__r", F.when(F.col("__o").isNull(), F.get(reviews, F.lit(0))))
    done = F.when(F.col("__r.decision") == "exclude", "excluded").otherwise("accepted")
    return both.select("key", F.coalesce("__o.outcome", done).alias("outcome"), F.col("__o.reason").alias("reason"), F.col("__r").alias("review"))


def review_counts(outcomes: DataFrame) -> DataFrame:
    """One row: expected images, accepted ones and of these included and negative, excluded, pending and erroneous ones."""
    decision = F.col("review.decision")
    of = {"accepted": F.col("outcome") == "accepted", "included": decision == "include", "negative": decision == "negative"}
    of |= {o: F.col("outcome") == o for o in ("excluded", "pending", "error")}
    return outcomes.agg(F.count(F.lit(1)).alias("expected"), *(F.count_if(c).alias(n) for n, c in of.items()))
