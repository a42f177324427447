"""Queries over the predictions of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.detections import reachable
from lodestone.functions.logits import accepted, top_two
from lodestone.operators import evaluation as ev
from lodestone.operators.rows import current_rows


def frames(spark: SparkSession, sf_dir: str, **needed) -> DataFrame:
    return ev.assemble(spark.read.parquet(f"{sf_dir}/frame_prediction.parquet"), **needed)


#: The usual thresholds, and the lowest of the grid.
USUAL, LOWEST = ev.Thresholds().detector, min(ev.GRID["detector"])


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ev.judged(frames(spark, sf_dir, least=USUAL, logits=False), F.lit(0.25), F.lit(0.45))
    return f.select("path", F.posexplode("survivors").alias("rank", "d")).select("path", "rank", "d.anchor", "d.score")


def match_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ev.judged(frames(spark, sf_dir, least=USUAL, logits=False), F.lit(0.25), F.lit(0.45))
    pairs = f.select("path", F.explode(F.arrays_zip("survivors", F.col("matched_all").alias("m"))).alias("p"))
    return pairs.where("p.m >= 0").select("path", "p.survivors.anchor", F.col("p.m").alias("truth"))


def softmax_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir, detections=False).select("path", F.posexplode("truth").alias("truth", "t")).select("path", "truth", top_two(F.col("t.logits")).alias("b"))
    nine = lambda c: F.round(c, 9)
    return t.select("path", "truth", "b.class_id", nine("b.confidence").alias("confidence"), nine("b.margin").alias("margin"), accepted(F.col("b"), 0.65, 0.1).alias("accepted"))


def detection_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best classes of every current detection, also of those that suppression never looks at; null without
    valid logits."""
    t = spark.read.parquet(f"{sf_dir}/frame_prediction.parquet").where("path is not null")
    # Ranked before the current rows are chosen, so that logits aren't shuffled.
    t = t.select("path", "batch_no", "arrived_at", F.transform("detections", lambda d: F.struct(d["anchor"].alias("anchor"), top_two(d["logits"]).alias("b"))).alias("d"))
    t = current_rows(t, ["path", "batch_no"], "arrived_at").select("path", "batch_no", F.explode("d").alias("d"))
    nine = lambda c: F.round(c, 9)
    return t.select(
        "path", "batch_no", "d.anchor", "d.b.class_id", nine("d.b.confidence").alias("confidence"), nine("d.b.margin").alias("margin"), accepted(F.col("d.b"), 0.65, 0.1).alias("accepted")
    )


def evaluate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.frame_cases(frames(spark, sf_dir, least=USUAL))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(frames(spark, sf_dir, least=USUAL))


def per_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ev.class_measures(confusion_matrix(spark, sf_dir))
    return m.select("class_id", "support", "predicted", "correct", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def crop_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = ev.crop_samples(frames(spark, sf_dir, detections=False))
    out = None
    for name, t in (("all", None), ("accepted", ev.Thresholds())):
        m = ev.class_measures(ev.crop_matrix(samples, t))
        m = m.select(F.lit(name).alias("kind"), "class_id", "support", "predicted", "correct", F.round("f1", 9).alias("f1"))
        out = m if out is None else out.unionByName(m)
    return out


def _nine(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def detector_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(ev.detector_measures(evaluate_frames(spark, sf_dir)), "precision", "recall")


def negative_false_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(ev.negative_frames(evaluate_frames(spark, sf_dir)), "rate")


def multiobject_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(ev.strata(evaluate_frames(spark, sf_dir)), "coverage", "full_rate")


def frame_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(ev.totals(evaluate_frames(spark, sf_dir)), "precision", "coverage")


def reachable_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = reachable(F.col("detections"), ev.GRID["detector"], ev.GRID["overlap"])
    return frames(spark, sf_dir, least=LOWEST, logits=False).select("path", F.explode(anchors).alias("anchor"))


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = frames(spark, sf_dir, least=LOWEST).where("split = 'valid'")
    return _nine(ev.grid_scores(valid), "macro_f1", "coverage")


def best_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = frames(spark, sf_dir, least=LOWEST).where("split = 'valid'")
    return _nine(ev.best_thresholds(ev.grid_scores(valid)), "macro_f1", "coverage")


def detector_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each overlap from 0.5 to 0.95 that a match needs; the mean of all is the usual summary."""
    return _nine(ev.average_precision(frames(spark, sf_dir, least=0.001, logits=False), ev.AP_OVERLAPS), "ap")


def detector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the precision at an overlap of 0.5, and the mean over all overlaps."""
    ap = ev.average_precision(frames(spark, sf_dir, least=0.001, logits=False), ev.AP_OVERLAPS)
    return _nine(ap.agg(F.max(F.when(F.col("least") == 0.5, F.col("ap"))).alias("map50"), F.avg("ap").alias("map50_95")), "map50", "map50_95")


QUERIES = {
    "detector_ap": detector_ap,
    "detector_map": detector_map,
    "nms": nms,
    "match_detections": match_detections,
    "softmax_top2": softmax_top2,
    "detection_top2": detection_top2,
    "evaluate_frames": evaluate_frames,
    "confusion_matrix": confusion_matrix,
    "per_class_metrics": per_class_metrics,
    "crop_metrics": crop_metrics,
    "detector_pr": detector_pr,
    "negative_false_accept": negative_false_accept,
    "multiobject_strata": multiobject_strata,
    "frame_totals": frame_totals,
    "reachable_anchors": reachable_anchors,
    "threshold_grid": threshold_grid,
    "best_thresholds": best_thresholds,
}

_FRAMES = """
now as (select * from frame_prediction where path is not null qualify row_number() over (partition by path, batch_no order by arrived_at desc) = 1),
head as (select path, max(group_id) as group_id, max(split) as split, coalesce(flatten(list(truth order by batch_no) filter (len(truth) > 0)), []) as truth
  from now group by path),
best as (select path, list(d order by d.score desc, d.anchor) as detections from (
    select path, d from (select path, unnest(detections) as d from now) where d.score is not null and not isnan(d.score) and d.score between 0 and 1
    qualify row_number() over (partition by path order by d.score desc, d.anchor) <= 300) group by path),
frame as (select head.*, coalesce(detections, []) as detections from head left join best using (path))"""


def _iou(a: str, b: str) -> str:
    shared = (
        f"(greatest(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x), 0.0::double)"
        f" * greatest(least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y), 0.0::double))"
    )
    union = f"({a}.w * {a}.h + {b}.w * {b}.h - {shared})"
    return f"(case when {union} > 0 then {shared} / {union} else 0.0::double end)"


def _survivors(detector: str, overlap: str, limit: int = 30) -> str:
    return f"""list_reduce(list_concat([[]], list_transform(list_filter(detections, lambda d: d.score >= {detector}), lambda d: [d])),
    lambda acc, x: case when len(acc) >= {limit} or len(list_filter(acc, lambda k: {_iou('k.box', 'x[1].box')} > {overlap})) > 0 then acc else list_append(acc, x[1]) end)"""


#: For each survivor the position of its truth from 1, or 0.
_MATCH = f"""list_reduce(list_concat([[]::bigint[]], list_transform(range(1, len(survivors) + 1), lambda i: [i])), lambda acc, x: list_append(acc, coalesce(
    list_sort(list_transform(list_filter(range(1, len(truth) + 1), lambda j: not list_contains(acc, j) and {_iou('survivors[x[1]].box', 'truth[j].box')} >= 0.5),
      lambda j: {{'i': -{_iou('survivors[x[1]].box', 'truth[j].box')}, 'j': j}}))[1].j, 0)))"""
_POWERS = "list_transform({l}, lambda v: exp(v - list_max({l})))"
_SOFTMAX = f"list_transform({_POWERS}, lambda p: p / list_sum({_POWERS}))"


def _best(logits: str) -> str:
    s = _SOFTMAX.replace("{l}", logits)
    return f"""case when len({logits}) = 10 then list_sort(list_transform(range(1, 11), lambda k: {{'p': -({s})[k], 'c': k - 1}})) end"""


_JUDGED = f"""{_FRAMES},
kept as (select *, {_survivors('0.25', '0.45')} as survivors from frame),
judged as (select *, {_MATCH} as matched_all from kept),
object as (select path, k, matched_all[k] as t, truth[matched_all[k]].class_id as cls, survivors[k].logits as logits
  from (select *, unnest(range(1, least(len(survivors), 5) + 1)) as k from judged)),
scored as (select *, {_best('logits')} as b from object),
seen as (select path, k, t, case when t > 0 then cls else 10 end as row,
    coalesce(-b[1].p >= 0.65 and b[2].p - b[1].p >= 0.1, false) as accepted,
    case when coalesce(-b[1].p >= 0.65 and b[2].p - b[1].p >= 0.1, false) then b[1].c else 10 end as col from scored),
missed as (select path, truth[j].class_id as row, 11 as col from (select *, unnest(range(1, len(truth) + 1)) as j from judged)
  where not list_contains(matched_all[1:5], j)),
cell as (select row, col, count(*) as n from (select row, col from seen union all select row, col from missed) group by all),
matrix as (select r.i as row, c.i as col, coalesce(n, 0) as n from range(11) r(i) cross join range(12) c(i) left join cell on row = r.i and col = c.i),
tally as (select path, count(*) filter (accepted) as accepted, count(*) filter (accepted and row = col) as correct,
    count(*) filter (accepted and row = 10) as accepted_background from seen group by path),
cases as (select path, group_id, split, len(truth)::int as truths, len(survivors)::int as survivors, least(len(survivors), 5)::int as objects,
    len(list_filter(matched_all, lambda m: m > 0))::int as hits_all, len(list_filter(matched_all[1:5], lambda m: m > 0))::int as hits,
    coalesce(accepted, 0)::int as accepted, coalesce(correct, 0)::int as correct, coalesce(accepted_background, 0)::int as accepted_background,
    len(survivors) > 5 as overflow,
    len(truth) > 0 and coalesce(correct, 0) = len(truth) and coalesce(accepted_background, 0) = 0 as fully_recognized
  from judged left join tally using (path))"""


def _measures(matrix: str) -> str:
    return f"""select c.i::int as class_id, coalesce(sum(n) filter (row = c.i), 0)::bigint as support, coalesce(sum(n) filter (col = c.i), 0)::bigint as predicted,
    coalesce(sum(n) filter (row = c.i and col = c.i), 0)::bigint as correct from range(10) c(i) cross join {matrix} group by c.i"""


_P = "case when predicted > 0 then correct::double / predicted else 0 end"
_R = "case when support > 0 then correct::double / support else 0 end"
_F1 = f"case when ({_P}) + ({_R}) > 0 then 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) else 0 end"


def _ratio(a: str, b: str) -> str:
    return f"round(case when ({b}) > 0 then ({a})::double / ({b}) end, 9)"


def _crops(kind: str, col: str) -> str:
    return f"""select '{kind}' as kind, class_id, support, predicted, correct, round({_F1}, 9) as f1 from (
  {_measures(f"(select cls as row, {col} as col, count(*) as n from crop group by all) x")})"""


SQL = {
    "nms": f"with {_FRAMES}, kept as (select path, {_survivors('0.25', '0.45')} as s from frame) "
    "select path, (k - 1)::int as rank, s[k].anchor as anchor, s[k].score as score from (select *, unnest(range(1, len(s) + 1)) as k from kept)",
    "match_detections": f"""with {_JUDGED} select path, survivors[k].anchor as anchor, (matched_all[k] - 1)::int as truth
  from (select *, unnest(range(1, len(survivors) + 1)) as k from judged) where matched_all[k] > 0""",
    "softmax_top2": f"""with {_FRAMES}, t as (select path, k, truth[k].logits as logits from (select path, truth, unnest(range(1, len(truth) + 1)) as k from frame)),
b as (select path, k, {_best('logits')} as b from t)
select path, (k - 1)::int as truth, b[1].c::int as class_id, round(-b[1].p, 9) as confidence, round(b[2].p - b[1].p, 9) as margin,
  coalesce(-b[1].p >= 0.65 and b[2].p - b[1].p >= 0.1, false) as accepted from b""",
    "detection_top2": f"""with {_FRAMES}, d as (select path, batch_no, unnest(detections) as d from now), b as (select path, batch_no, d.anchor as anchor, {_best('d.logits')} as b from d)
select path, batch_no, anchor, b[1].c::int as class_id, round(-b[1].p, 9) as confidence, round(b[2].p - b[1].p, 9) as margin,
  coalesce(-b[1].p >= 0.65 and b[2].p - b[1].p >= 0.1, false) as accepted from b""",
    "evaluate_frames": f"with {_JUDGED} select * from cases",
    "confusion_matrix": f"with {_JUDGED} select row::int as row, col::int as col, n::bigint as n from matrix",
    "per_class_metrics": f"""with {_JUDGED}, m as ({_measures('matrix')})
select class_id, support, predicted, correct, round({_P}, 9) as precision, round({_R}, 9) as recall, round({_F1}, 9) as f1 from m""",
    "crop_metrics": f"""with {_FRAMES}, t as (select unnest(truth) as t from frame), crop as (select t.class_id as cls, {_best('t.logits')} as b from t)
{_crops("all", "coalesce(b[1].c, 10)")} union all {_crops("accepted", "case when coalesce(-b[1].p >= 0.65 and b[2].p - b[1].p >= 0.1, false) then b[1].c else 10 end")}""",
    "detector_pr": f"""with {_JUDGED}, x as (select 'after_suppression' as stage, sum(hits_all) as hits, sum(survivors) as boxes, sum(truths) as truths from cases
  union all select 'after_cap', sum(hits), sum(objects), sum(truths) from cases)
select stage, hits::bigint as hits, (boxes - hits)::bigint as false_alarms, (truths - hits)::bigint as misses, {_ratio('hits', 'boxes')} as precision, {_ratio('hits', 'truths')} as recall from x""",
    "negative_false_accept": f"""with {_JUDGED} select count(*) as frames, count(distinct group_id) as groups, count(*) filter (accepted > 0) as accepting_frames,
  coalesce(sum(accepted), 0)::bigint as accepted_boxes, {_ratio('count(*) filter (accepted > 0)', 'count(*)')} as rate from cases where truths = 0""",
    "multiobject_strata": f"""with {_JUDGED}, x as (select r.i::int as truths, count(path) as frames, coalesce(sum(correct), 0)::bigint as correct,
  count(*) filter (fully_recognized) as fully_recognized from range(2, 6) r(i) left join cases on truths = r.i group by r.i)
select *, {_ratio('correct', 'frames * truths')} as coverage, {_ratio('fully_recognized', 'frames')} as full_rate from x""",
    "frame_totals": f"""with {_JUDGED}, x as (select count(*) as frames, sum(truths)::bigint as truths, sum(accepted)::bigint as accepted, sum(correct)::bigint as correct,
  count(*) filter (overflow) as overflow_frames, count(*) filter (fully_recognized) as fully_recognized from cases)
select *, {_ratio('correct', 'accepted')} as precision, {_ratio('correct', 'truths')} as coverage from x""",
    "reachable_anchors": f"""with {_FRAMES}, s as (select path, {_survivors('th.det', 'th.ov')} as s from frame cross join
  (select det, ov from unnest([0.15, 0.25, 0.35, 0.5]::double[]) a(det) cross join unnest([0.3, 0.45, 0.6]::double[]) b(ov)) th)
select distinct path, unnest(list_transform(s[1:5], lambda d: d.anchor)) as anchor from s""",
}

_GRID = f"""{_FRAMES},
th as (select det, ov from unnest([0.15, 0.25, 0.35, 0.5]::double[]) a(det) cross join unnest([0.3, 0.45, 0.6]::double[]) b(ov)),
inner_th as (select cl, mg from unnest([0.5, 0.65, 0.8]::double[]) a(cl) cross join unnest([0.0, 0.1, 0.2]::double[]) b(mg)),
kept as (select det, ov, path, truth, {_survivors('th.det', 'th.ov')}[1:5] as survivors from frame cross join th where split = 'valid'),
judged as (select *, {_MATCH} as matched from kept),
object as (select det, ov, path, len(truth) = 0 as negative, matched[k] as t, truth[matched[k]].class_id as cls, survivors[k].logits as logits
  from (select *, unnest(range(1, len(survivors) + 1)) as k from judged)),
scored as (select *, {_best('logits')} as b from object),
seen as (select det, ov, cl, mg, path, negative, case when t > 0 then cls else 10 end as row,
  coalesce(-b[1].p >= cl and b[2].p - b[1].p >= mg, false) as accepted, b[1].c as top from scored cross join inner_th),
missed as (select det, ov, truth[j].class_id as row from (select *, unnest(range(1, len(truth) + 1)) as j from judged) where not list_contains(matched, j)),
cell as (select det, ov, cl, mg, row, case when accepted then top else 10 end as col, count(*) as n from seen group by all
  union all select det, ov, cl, mg, row, 11, count(*) from missed cross join inner_th group by all),
m as (select det, ov, cl, mg, c.i as class_id, coalesce(sum(n) filter (row = c.i), 0) as support, coalesce(sum(n) filter (col = c.i), 0) as predicted,
  coalesce(sum(n) filter (row = c.i and col = c.i), 0) as correct from cell cross join range(10) c(i) group by all),
f as (select det, ov, cl, mg, list_sum(list({_F1} order by class_id)) / 10 as macro, sum(correct) as correct, sum(support) as support from m group by all),
neg as (select det, ov, cl, mg, count(distinct path) as na from seen where negative and accepted group by all),
grid as (select (row_number() over (order by th.det, th.ov, cl, mg) - 1)::int as grid_idx, th.det as detector, th.ov as overlap, inner_th.cl as classifier, inner_th.mg as margin,
  coalesce(macro, 0) as macro, case when support > 0 then correct::double / support end as cov, coalesce(na, 0)::bigint as negative_accepts
  from th cross join inner_th left join f using (det, ov, cl, mg) left join neg using (det, ov, cl, mg))"""
_SHOWN = "grid_idx, detector, overlap, classifier, margin, round(macro, 9) as macro_f1, round(cov, 9) as coverage, negative_accepts"
SQL |= {
    "threshold_grid": f"with {_GRID} select {_SHOWN} from grid",
    "best_thresholds": f"with {_GRID} select {_SHOWN} from grid order by macro desc, coalesce(cov, 0) desc, negative_accepts, grid_idx limit 1",
}
_AP = f"""{_FRAMES},
kept as (select path, truth, {_survivors('0.001', '0.7', 300)} as survivors from frame),
tried as (select i / 100.0::double as least, path, truth, survivors from kept, range(50, 100, 5) r(i)),
judged as (select *, {_MATCH.replace('>= 0.5', '>= least')} as matched from tried),
box as (select least, path, survivors[k].score as score, survivors[k].anchor as anchor, (matched[k] > 0)::int as hit from (select *, unnest(range(1, len(survivors) + 1)) as k from judged)),
ranked as (select least, hit, sum(hit) over w as hits, row_number() over w as n from box window w as (partition by least order by score desc, path, anchor)),
t as (select sum(len(truth)) as truths from frame),
point as (select least, (hits * 100 // truths)::int as level, max(hits::double / n) as precision from ranked, t where hit = 1 group by 1, 2),
env as (select b.least, l.i, coalesce((select max(precision) from point p where p.least = b.least and level >= l.i), 0) as p from range(101) l(i), (select distinct least from tried) b),
ap as (select least, sum(p) / 101 as ap from env group by least),
counted as (select least, count(*) as boxes, sum(hit)::bigint as hits from box group by least)"""
SQL["detector_ap"] = f"with {_AP} select least, truths::bigint as truths, coalesce(boxes, 0) as boxes, coalesce(hits, 0) as hits, round(ap, 9) as ap from ap left join counted using (least), t"
SQL["detector_map"] = f"with {_AP} select round(max(case when least = 0.5 then ap end), 9) as map50, round(avg(ap), 9) as map50_95 from ap"
