"""Evaluation, duplicates, rules, histories and the seeded split."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import duplicates as D
from lodestone.operators import evaluation as E
from lodestone.operators import history as H
from lodestone.operators import quality as Q
from lodestone.operators import review as R
from lodestone.operators import seeded as S
from lodestone.operators.catalog import describe, others, search
from lodestone.operators.positions import with_positions, with_running

FRAME = (
    "path string, group_id string, split string, truth array<struct<box:struct<x:double,y:double,w:double,h:double>,class_id:int,logits:array<double>>>,"
    "detections array<struct<box:struct<x:double,y:double,w:double,h:double>,score:double,anchor:int,logits:array<double>>>"
)
BOX = (0.1, 0.1, 0.25, 0.25)


def sure(c, p=None):
    if p is None:
        return [12.0 if i == c else 0.0 for i in range(10)]
    return [math.log(p) if i == c else math.log((1 - p) / 9) for i in range(10)]


def grid_box(i):
    return (0.05 + 0.3 * (i % 3), 0.05 + 0.3 * (i // 3), 0.25, 0.25)


def test_macro_f1_of_a_known_case(spark):
    # Ten frames with one object each; class 1 is taken for class 0.
    rows = [(f"f{c}", f"g{c}", "valid", [(BOX, c, None)], [(BOX, 0.9, c, sure(0 if c == 1 else c))]) for c in range(10)]
    frames = spark.createDataFrame(rows, FRAME)
    m = E.class_measures(E.confusion(frames))
    by = {r.class_id: r for r in m.collect()}
    assert by[0].f1 == pytest.approx(2 / 3) and by[1].f1 == 0.0 and by[5].f1 == 1.0
    assert E.macro_f1(m).first()[0] == pytest.approx((8 + 2 / 3) / 10)


def test_object_cap_and_overflow(spark):
    six = [(grid_box(i), i, None) for i in range(6)]
    frames = spark.createDataFrame([("f", "g", "test", six, [(grid_box(i), 0.9 - i / 100, i, sure(i)) for i in range(6)])], FRAME)
    cases = E.frame_cases(frames)
    r = cases.first()
    assert (r.truths, r.survivors, r.objects, r.correct, r.overflow, r.fully_recognized) == (6, 6, 5, 5, True, False)
    stages = {x.stage: x.recall for x in E.detector_measures(cases).collect()}
    assert stages["after_suppression"] == 1.0 and stages["after_cap"] == pytest.approx(5 / 6)
    assert {(x.row, x.col) for x in E.confusion(frames).where("n > 0").collect()} == {(i, i) for i in range(5)} | {(5, E.MISSED)}


def test_frames_without_truth_or_logits(spark):
    rows = [
        ("neg", "g1", "test", [], [(BOX, 0.9, 1, sure(3))]), ("null", "g2", "test", [(BOX, 3, None)], [(BOX, 0.9, 1, None)]), ("none", "g3", "test", [], []),
        ("unsure", "g4", "test", [(BOX, 3, None)], [(BOX, 0.9, 1, sure(3, 0.5))]), ("missed", "g5", "test", [(BOX, 4, None)], []),
    ]
    frames = spark.createDataFrame(rows, FRAME)
    cases = E.frame_cases(frames)
    by = {r.path: r for r in cases.collect()}
    assert by["neg"].accepted_background == 1 and by["null"].accepted == 0 and by["unsure"].accepted == 0
    n = E.negative_frames(cases).first()
    assert (n.frames, n.groups, n.accepting_frames, n.accepted_boxes, n.rate) == (2, 2, 1, 1, 0.5)
    cells = {(x.row, x.col): x.n for x in E.confusion(frames).where("n > 0").collect()}
    assert cells == {(E.BACKGROUND, 3): 1, (3, E.REJECTED): 2, (4, E.MISSED): 1}
    t = E.totals(cases).first()
    assert (t.frames, t.truths, t.accepted, t.correct, t.precision) == (5, 3, 1, 0, 0.0)
    nothing = E.totals(E.frame_cases(frames.where("false"))).first()
    assert nothing.frames == 0 and nothing.precision is None
    assert [r.coverage for r in E.strata(cases).collect()] == [None] * 4


def plain_scores(frames, t):
    """The measures of one combination, frame by frame."""
    from test_functions import plain_match, plain_nms

    cells, negative = {}, 0
    for _, _, _, truth, dets in frames:
        kept = plain_nms([(d[0], d[1], (d[2], d[3])) for d in dets], t["detector"], t["overlap"])[:5]
        hits = plain_match(kept, [x[0] for x in truth])
        any_yes = False
        for d, h in zip(kept, hits, strict=True):
            logits = d[2][1]
            yes, cls = False, None
            if logits:
                z = [math.exp(v - max(logits)) for v in logits]
                p = sorted(((-v / sum(z), i) for i, v in enumerate(z)))
                cls, yes = p[0][1], -p[0][0] >= t["classifier"] and p[1][0] - p[0][0] >= t["margin"]
            any_yes |= yes
            key = (truth[h][1] if h >= 0 else 10, cls if yes else 10)
            cells[key] = cells.get(key, 0) + 1
        for i, x in enumerate(truth):
            if i not in hits:
                cells[x[1], 11] = cells.get((x[1], 11), 0) + 1
        negative += any_yes and not truth
    f1 = 0.0
    for c in range(10):
        tp, s, p = cells.get((c, c), 0), sum(n for (r, _), n in cells.items() if r == c), sum(n for (_, k), n in cells.items() if k == c)
        pr, rc = tp / p if p else 0.0, tp / s if s else 0.0
        f1 += 2 * pr * rc / (pr + rc) if pr + rc else 0.0
    return f1 / 10, negative


def test_threshold_grid(spark):
    r = random.Random(11)
    rows = []
    for i in range(60):
        truth = [(grid_box(k), r.randint(0, 9), None) for k in r.sample(range(9), r.randint(0, 4))]
        dets = [(b, r.choice([0.2, 0.3, 0.4, 0.9]), 10 * i + k, r.choice([sure(c), sure(c, 0.55), sure(r.randint(0, 9), 0.7), None])) for k, (b, c, _) in enumerate(truth) if r.random() < 0.9]
        dets += [(grid_box(r.randint(0, 8)), r.choice([0.2, 0.3, 0.6]), 10 * i + 9, sure(r.randint(0, 9), r.choice([0.6, 0.9])))]
        rows.append((f"f{i}", "g", "valid", truth, dets))
    got = E.grid_scores(spark.createDataFrame(rows, FRAME)).collect()
    assert len(got) == 108
    best = None
    for g in sorted(got, key=lambda g: g.grid_idx):
        f1, negative = plain_scores(rows, g.asDict())
        assert g.macro_f1 == pytest.approx(f1, abs=1e-12) and g.negative_accepts == negative
        key = (g.macro_f1, g.coverage or 0, -g.negative_accepts)
        if best is None or key > best[0]:
            best = (key, g.grid_idx)
    assert E.calibrate(spark.createDataFrame(rows, FRAME)).first().grid_idx == best[1]


def moved(b, part):
    x, y, w, h = b
    return (x + part * w, y, w, h)


def test_average_precision(spark):
    # Ranked by score: hit, false alarm, hit, and one truth that is never found.
    rows = [("a", "g", "test", [(grid_box(0), 1, None), (grid_box(4), 1, None)], [(grid_box(0), 0.9, 1, None), (grid_box(8), 0.8, 2, None), (grid_box(4), 0.7, 3, None)]), ("b", "g", "test", [(grid_box(1), 1, None)], [])]
    r = E.average_precision(spark.createDataFrame(rows, FRAME)).first()
    assert (r.truths, r.boxes, r.hits) == (3, 3, 2) and r.ap == pytest.approx((34 * 1.0 + 33 * 2 / 3) / 101)
    assert E.average_precision(spark.createDataFrame([], FRAME)).first().ap is None
    # The second hit is shifted by a tenth of its width: its overlap is 0.9 / 1.1, enough up to 0.8 only.
    near = [("a", "g", "test", rows[0][3], [rows[0][4][0], (moved(grid_box(4), 0.1), 0.7, 3, None)])]
    ap = {round(x.least, 2): (x.hits, round(x.ap, 9)) for x in E.average_precision(spark.createDataFrame(near, FRAME), E.AP_OVERLAPS).collect()}
    assert len(ap) == 10 and ap[0.5] == ap[0.8] == (2, 1.0) and ap[0.85] == ap[0.95] == (1, round(51 / 101, 9))


def test_thresholds_are_not_tuned_on_test(spark):
    with pytest.raises(ValueError, match="valid"):
        E.calibrate(spark.createDataFrame([("f", "g", "test", [], [])], FRAME))


def test_hamming_pairs(spark):
    r = random.Random(4)
    hs = [r.getrandbits(63) for _ in range(100)]
    hs += [h ^ (1 << r.randint(0, 62)) ^ (1 << r.randint(0, 62)) for h in hs[:40]] + hs[:10]
    df = spark.createDataFrame([(h,) for h in hs] + [(None,)], "h bigint")
    for d in (0, 2, 4):
        want = {(min(a, b), max(a, b)) for a in set(hs) for b in set(hs) if a != b and (a ^ b).bit_count() <= d}
        got = [(x.a, x.b) for x in D.hamming_pairs(df, "h", d).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    report = D.bounded_pairs(D.hamming_pairs(df, "h", 4), 5, ["a", "b"]).collect()
    assert len(report) == 5 and all(x.truncated for x in report)


def test_near_duplicates_of_images(spark):
    """Pairs of images, equal bytes left out and equal hashes included, against comparing all with all."""
    r = random.Random(9)
    rows = [(f"p{i:03}", r.choice([f"s{i}", "s1", "s2", None]), r.choice([0, 1, 3, 0xFF, 0x1FF, 1 << 40])) for i in range(120)] + [("x", "s", None), (None, "s", 0)]
    df = spark.createDataFrame(rows, "path string, sha256 string, hash bigint")
    want = {}
    live = sorted(x for x in rows if x[0] is not None and x[2] is not None)
    for i, a in enumerate(live):
        for b in live[i + 1 :]:
            if a[1] != b[1] and (a[2] ^ b[2]).bit_count() <= 4:
                key = (min(a[2], b[2]), max(a[2], b[2]))
                want[key] = want.get(key, 0) + 1
    got = D.near_duplicates(df, 4).collect()
    assert {(x.a, x.b): x.pairs for x in got} == want and len(got) == len(want)
    first = {h: min(x[0] for x in live if x[2] == h) for h in {x[2] for x in live}}
    shas = {x[0]: x[1] for x in live}
    for x in got:
        assert x.path_a == first[x.a] and x.distance == (x.a ^ x.b).bit_count()
        assert x.path_b == (first[x.b] if x.a != x.b else min(y[0] for y in live if y[2] == x.a and y[1] != shas[x.path_a]))
    assert {(x.path, x.first_path) for x in D.near_members(df).collect()} == {(x[0], first[x[2]]) for x in live}
    report = D.bounded_pairs(D.near_duplicates(df, 4), 2, ["path_a", "path_b"], F.col("pairs")).collect()
    assert len(report) == 2 and all(x.truncated and x.total == sum(want.values()) for x in report)
    assert D.near_duplicates(spark.createDataFrame([], df.schema), 4).count() == 0
    assert 5 <= D.choose_bands(100, 4) <= D.choose_bands(10**9, 4) <= 11


def test_exact_duplicates(spark):
    df = spark.createDataFrame([("h", "b", 1), ("h", "a", 2), ("x", "c", 1), (None, "d", 1), (None, "e", 1), ("y", "f", 3), ("y", "g", 3)], "h string, p string, c int")
    assert {tuple(r) for r in D.exact_clusters(df, "h", "p", "c").collect()} == {("h", 2, "a", True), ("y", 2, "f", False)}
    assert {r.path for r in D.exact_members(df, "h", "p", "c").collect()} == {"a", "b", "f", "g"}
    assert {r.p for r in D.representatives(df, "h", "p").collect()} == {"a", "c", "d", "e", "f"}


def test_manifest_rules(spark):
    schema = "path string, sourceid string, groupid string, sha256 string, split string, objects array<struct<classid:int,bbox:array<double>>>"
    ok = [(1, [0.1, 0.1, 0.5, 0.6])]
    rows = [
        ("a", "s", "g", "1", "train", ok), ("a", "s", "g", "2", "valid", ok), ("b", " ", None, "2", "x", [(10, [0.1, 0.1, 0.5, 0.6])]),
        ("c", "s", "h", "3", None, [(1, [0.9, 0.1, 0.5, 0.6])]), ("d", "s", "i", "4", "test", None),
    ]
    got = {(r.path, r.rule) for r in Q.manifest_violations(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        ("a", "repeated path"), ("a", "repeated sha256"), ("b", "repeated sha256"), ("a", "group in several splits"), ("b", "blank source"), ("b", "blank group"),
        ("b", "unknown split"), ("b", "class out of range"), ("c", "box outside image"),
    }
    assert Q.manifest_violations(spark.createDataFrame([], schema)).count() == 0


def test_inventory_rules(spark):
    a, b = "a" * 64, "b" * 64
    rows = [
        ("x/1.png", "s", 1, a, 16, 16), ("x/2.png", " s", 1, a, 16, 15), ("../3.png", "s", 10, "A" * 64, 16, 16), ("x\\1.png", "s", None, b, None, 20), (None, None, 0, None, 99, 99),
    ]
    schema = "path string, sourceid string, classid int, sha256 string, width int, height int, rule string"
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    assert {(r.path, r.rule) for r in Q.inventory_violations(df).collect()} == {
        ("x/2.png", "source isn't plain text"), ("x/2.png", "too small"), ("../3.png", "unsafe path"), ("../3.png", "class out of range"), ("../3.png", "invalid sha256"),
        ("x\\1.png", "class out of range"), ("x\\1.png", "too small"), (None, "unsafe path"), (None, "source isn't plain text"), (None, "invalid sha256"),
        ("x/1.png", "repeated path"), ("x\\1.png", "repeated path"), ("x/1.png", "repeated sha256"), ("x/2.png", "repeated sha256"),
    }
    assert Q.inventory_violations(df.where("false")).count() == 0
    report = {tuple(r) for r in Q.report_of({"a": Q.inventory_violations(df), "b": df.select("path", "rule")}, "path", "rule").collect()}
    assert ("a", "repeated path", 2) in report and ("b", "x", 4) in report


def test_derivatives_that_may_be_used_again(spark):
    wanted = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None), ("e", "1"), (None, "1")], "p string, sha string")
    cached = spark.createDataFrame([("a", "1", 16), ("a", "0", 16), ("b", "2", 16), ("c", "1", 15), ("d", None, 16), ("e", "1", None), (None, "1", 16)], "p string, sha string, w int")
    got = {r.p: r.reuse for r in Q.reusable(cached, wanted, "p", ["sha"], F.col("w") >= 16).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False, None: False}


def test_import_batches(spark):
    tasks = spark.createDataFrame([(i,) for i in range(25)] + [(3,), (None,)], "k int")
    known = spark.createDataFrame([(0,), (1,), (None,), (99,)], "k int")
    got = {r.k: r.batch for r in R.import_batches(tasks, known, "k", 10).collect()}
    assert got == {k: (k - 2) // 10 for k in range(2, 25)}
    assert R.import_batches(tasks, tasks, "k").count() == 0


def test_sets_and_counts(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(tuple(r) for r in Q.symmetric_difference(a, b).collect()) == [(1, "left"), (2, "left"), (3, "right")]
    assert Q.is_subset(b.where("x = 1"), a) and not Q.is_subset(b, a)
    assert [r.x for r in Q.remaining(a, b, "x").collect()] == [2]
    counted = Q.counts_against(a, "x", spark.createDataFrame([(1, 2), (5, 1)], "x int, n int")).collect()
    assert {tuple(r) for r in counted} == {(1, 2, 2, True), (2, 1, 0, False), (5, 0, 1, False)}
    r = spark.createDataFrame([("p", 1, "h"), ("q", 2, None), ("r", 1, "h")], "path string, bytes int, sha string")
    f = spark.createDataFrame([("p", 1, "x"), ("q", 2, None), ("s", 1, "h")], "path string, bytes int, sha string")
    assert {tuple(x) for x in Q.verify_receipts(r, f, "path", ["bytes", "sha"]).collect()} == {("p", "sha"), ("r", "missing"), ("s", "unexpected")}


def test_history(spark):
    h = spark.createDataFrame([("r", e, s) for e, s in enumerate([0.5, 0.7, 0.6, 0.7, 0.8], 1)] + [("gap", 1, 0.1), ("gap", 3, 0.2)], "run string, epoch int, f1 double")
    rows = {(x.run, x.epoch): x for x in H.early_stopping(h, "run", "epoch", "f1", 2).collect()}
    assert [(rows["r", e].best, rows["r", e].stale, rows["r", e].stop) for e in range(1, 6)] == [(0.5, 0, False), (0.7, 0, False), (0.7, 1, False), (0.7, 2, True), (0.8, 0, False)]
    assert rows["gap", 1].contiguous and not rows["gap", 3].contiguous
    w = {x.c: x.weight for x in H.class_weights(spark.createDataFrame([(0,), (0,), (1,), (None,)], "c int"), "c", 10).collect()}
    assert w == {0: pytest.approx(0.15), 1: pytest.approx(0.3)}
    s = H.systematic_sample(spark.range(1000).withColumnRenamed("id", "x"), ["x"], 48).collect()
    assert sorted(x.x for x in s) == [20 * i for i in range(48)]


def test_positions(spark):
    rows = list(range(500))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "x int").repartition(7)
    assert all(r.position == r.x for r in with_positions(df, ["x"]).collect())
    assert with_positions(df.where("false"), ["x"]).count() == 0
    sums = {r.x: r.s for r in with_running(df, [F.desc("x")], {"s": "x"}).collect()}
    assert all(sums[x] == sum(range(x, 500)) for x in (0, 17, 499))


def test_seeded_split(spark):
    groups = {f"g{i}": 1023 & ~(1 << i % 10) for i in range(30)}
    placed = S.deal(groups, 42, 10)
    # 4.5 rounds to the even 4.
    assert [list(placed.values()).count(s) for s in ("train", "valid", "test")] == [22, 4, 4] and placed == S.deal(groups, 42, 10)
    for s in ("train", "valid", "test"):
        bits = 0
        for g, x in placed.items():
            bits |= groups[g] if x == s else 0
        assert bits == 1023
    with pytest.raises(ValueError, match="no shuffle"):
        S.deal({f"g{i}": 1 for i in range(30)}, 42, 10)
    rows = spark.createDataFrame([(i, f"g{i % 60}", list(range(10)), "old") for i in range(300)] + [(999, None, [], "old")], "id int, g string, c array<int>, split string")
    got = S.seeded_split(rows, "g", "c").collect()
    assert len(got) == 300 and len({(r.g, r.split) for r in got}) == 60
    with pytest.raises(ValueError, match="three"):
        S.deal({"a": 1}, 1, 1)


def test_review(spark):
    def rect(label="jahe", x=10.0, **o):
        v = {"x": x, "y": -0.0, "width": 50.0, "height": 60.0, "rotation": 0.0, "rectanglelabels": [label] if label else [], "choices": None, "text": None} | {k: z for k, z in o.items() if k in ("rotation", "width")}
        return {"id": "1", "from_name": "bbox", "type": "rectanglelabels", "origin": "manual", "original_width": o.get("ow", 100), "original_height": 80, "image_rotation": 0.0, "value": v}

    def control(name, **v):
        return {"id": "2", "from_name": name, "type": "x", "origin": "manual", "original_width": None, "original_height": None, "image_rotation": None, "value": {"x": None, "y": None, "width": None, "height": None, "rotation": None, "rectanglelabels": None, "choices": None, "text": None} | v}

    results = [rect(), rect("other"), rect(rotation=3.0), rect(ow=50), rect(x=60.0), control("decision", choices=["include"]), control("group", text=[" g1 "]), control("reason", text=["  "])]
    df = spark.createDataFrame([(results,)], f"r array<{R.RESULT}>")
    names = F.array(F.lit("kunyit"), F.lit("jahe"))
    row = df.select(
        R.rectangles(F.col("r"), names, F.lit(100), F.lit(80)).alias("b"), R.single_choice(F.col("r"), "decision").alias("d"), R.single_text(F.col("r"), "group").alias("g"), R.single_text(F.col("r"), "reason").alias("n")
    ).first()
    assert [b.problem for b in row.b] == [None, "label", "rotation", "dimensions", "box"]
    assert row.b[0].class_id == 1 and row.b[0].bbox == [0.1, 0.0, 0.5, 0.6] and math.copysign(1, row.b[0].bbox[1]) == 1
    assert (row.d, row.g, row.n) == ("include", "g1", None)
    reviews = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "task int, decision string")
    assert [tuple(r) for r in R.disagreements(reviews, "task", ["decision"]).collect()] == [(2, 2, 2)]
    states = R.expected_tasks(reviews.where("task = 1").unionByName(spark.createDataFrame([(9, "x")], reviews.schema)), spark.createDataFrame([(1,), (3,)], "task int"), "task")
    assert {tuple(r) for r in states.collect()} == {(1, 2, "repeated"), (3, 0, "missing"), (9, 1, "unknown")}
    assert R.shared_ids(spark.createDataFrame([(1, "t"), (1, "u"), (2, "t"), (2, "t")], "a int, t string"), "a", "t").collect()[0].a == 1


def test_review_outcomes(spark):
    """One task for each rule, and what it must come to."""
    def control(name, box=None, **v):
        value = {c: None for c in ("x", "y", "width", "height", "rotation", "rectanglelabels", "choices", "text")} | v
        if box:
            value |= dict(zip(("x", "y", "width", "height"), box)) | {"rotation": 0.0, "rectanglelabels": [v.get("label", "jahe")]}
        value.pop("label", None)
        return {"id": name, "from_name": name, "type": "t", "origin": "manual", "original_width": 100, "original_height": 80, "image_rotation": 0.0, "value": value}

    def note(decision="include", group=" g ", reason=None, boxes=((10.0, 10.0, 50.0, 60.0),), label="jahe", reviewed="yes", cancelled=False):
        out = [control("bbox", b, label=label) for b in boxes]
        out += [control("decision", choices=[decision])] if decision else []
        out += [control("reviewed", choices=[reviewed])] if reviewed else []
        out += [control("groupId", text=[group])] if group else []
        out += [control("reason", text=[reason])] if reason else []
        return {"id": "1", "was_cancelled": cancelled, "result": out}

    two = ((0.0, 0.0, 10.0, 10.0), (20.0, 20.0, 10.0, 10.0))
    cases = {
        "include": ([note()], "accepted", None), "negative": ([note("negative", boxes=())], "accepted", None), "exclude": ([note("exclude", None, "blurred", ())], "excluded", None),
        "agree": ([note(boxes=two), note(boxes=two[::-1])], "accepted", None), "cancelled too": ([note("exclude", cancelled=True), note()], "accepted", None),
        "differ": ([note(), note(group="h")], "error", "reviews differ"), "only cancelled": ([note(cancelled=True)], "pending", "no annotation"), "none": ([], "pending", "no annotation"),
        "null": (None, "pending", "no annotation"), "flag": ([note(cancelled=None)], "error", "no cancelled flag"), "label": ([note(label="?")], "error", "rectangle"),
        "outside": ([note(boxes=((60.0, 0.0, 50.0, 10.0),))], "error", "rectangle"), "unreviewed": ([note(reviewed=None)], "pending", "not reviewed"), "undecided": ([note(None)], "pending", "no decision"),
        "odd": ([note("maybe")], "error", "unknown decision"), "why": ([note("exclude", None, " ", ())], "pending", "no reason"), "boxed": ([note("exclude", None, "r")], "error", "excluded with boxes"),
        "alone": ([note(group=" ")], "pending", "no group"), "reasoned": ([note(reason="r")], "error", "reason without exclusion"), "empty": ([note(boxes=())], "pending", "no boxes"),
        "full": ([note("negative")], "error", "negative with boxes"), "second": ([note(), note(None)], "pending", "no decision"),
    }
    rows = [(k, True, 0, a) for k, (a, _, _) in cases.items()] + [("twice", True, 0, [note()])] * 2
    rows += [("open", False, 0, [note()]), ("draft", True, 1, [note()]), ("unknown", True, 0, [note()]), (None, True, 0, [note()])]
    wanted = {k: (o, r) for k, (_, o, r) in cases.items()}
    wanted |= {"twice": ("error", "exported twice"), "open": ("pending", "not labelled"), "draft": ("pending", "draft"), "gone": ("error", "not exported")}
    expected = spark.createDataFrame([(k, 100, 80) for k in wanted] + [(None, 1, 1)], "key string, width int, height int")
    got = R.review_outcomes(expected, spark.createDataFrame(rows, R.TASK), F.lit(["jahe", "kencur"])).cache()
    assert {r.key: (r.outcome, r.reason) for r in got.collect()} == wanted
    of = {r.key: r.review for r in got.collect()}
    assert of["include"].group_id == "g" and [tuple(o) for o in of["include"].objects] == [(0, [0.1, 0.1, 0.5, 0.6])] and of["exclude"].reason == "blurred" and of["differ"] is None
    n = R.review_counts(got).first()
    assert (n.expected, n.accepted, n.included, n.negative, n.excluded) == (26, 4, 3, 1, 1) and n.pending + n.error == 21
    assert R.review_outcomes(expected.where("false"), spark.createDataFrame([], R.TASK), F.lit(["jahe"])).count() == 0


def test_catalog(spark):
    items = spark.createDataFrame([(0, "Jahe", "Zingiber", "A"), (1, "Kunyit", "Curcuma", "B"), (2, "Temulawak", "Curcuma x", "B")], "id int, name string, sci string, family string")
    assert [r.id for r in search(items, ["name", "sci"], "  CURCUMA ").collect()] == [1, 2]
    assert [r.id for r in search(items, ["name", "sci"], "temulawak c", family="family", wanted="B").collect()] == [2]
    assert search(items, ["name", "sci"], "").count() == 3
    assert [r.id for r in others(items, "id", 0, 1).collect()] == [1]
    assert describe(items.select("id"), items.where("id = 1").select("id", "name"), "id").where("name is null").count() == 2
