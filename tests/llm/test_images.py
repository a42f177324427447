"""Near pairs, overlaps, components and splits, against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from lodestone.llm.components import connected_components, star_links
from lodestone.functions.text import same_text_value
from lodestone.llm import groupsplit as G
from lodestone.llm.groupsplit import allot, cover, difference, grouped_split
from lodestone.llm import nearhash as N
from lodestone.llm import overlap as O
from lodestone.llm.nearhash import Texts, choose_bands, common_prefix, near_pairs
from lodestone.llm.overlap import coverage, cross_split_overlaps, overlap_links
from lodestone.llm.queries_images import p3_split
from lodestone.scratch import Scratch


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def near_cluster(r, n, base, flips):
    out = set()
    while len(out) < n:
        x = base
        for b in r.sample(range(64), r.randint(0, flips)):
            x ^= 1 << b
        out.add(x)
    return out


def brute_pairs(hs, d, side=None):
    out = set()
    hs = sorted(hs)
    for i, a in enumerate(hs):
        for b in hs[i + 1 :]:
            if 0 < (a ^ b).bit_count() <= d and (side is None or side[a] & 1 and side[b] & 2 or side[b] & 1 and side[a] & 2):
                x, y = sorted((signed(a), signed(b)))
                out.add((x, y))
    return out


@pytest.mark.parametrize(("d", "run"), [(4, 2048), (4, 8), (0, 2048), (2, 3), (8, 2048)])
def test_near_pairs(spark, d, run):
    r = random.Random(d * 100 + run)
    hs = {r.getrandbits(64) for _ in range(150)} | near_cluster(r, 120, r.getrandbits(64), 6) | near_cluster(r, 40, 0, 4)
    df = spark.createDataFrame([(signed(h), 3) for h in hs], "h bigint, side int")
    got = [tuple(x) for x in near_pairs(df, d, run=run).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(hs, d)


@pytest.mark.parametrize("run", [2048, 5])
def test_near_pairs_across_sides(spark, run):
    r = random.Random(3)
    hs = near_cluster(r, 150, r.getrandbits(64), 5)
    side = {h: r.choice([1, 2, 3]) for h in hs}
    df = spark.createDataFrame([(signed(h), s) for h, s in side.items()], "h bigint, side int")
    assert {tuple(x) for x in near_pairs(df, 4, cross=True, run=run).collect()} == brute_pairs(hs, 4, side)


def test_spanning_pairs_connect_what_all_pairs_connect(spark):
    r = random.Random(5)
    hs = near_cluster(r, 200, r.getrandbits(64), 3) | near_cluster(r, 60, r.getrandbits(64), 9) | {r.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(signed(h), 3) for h in hs], "h bigint, side int")
    for run in (2048, 10):
        few = [tuple(x) for x in near_pairs(df, 4, spanning=True, run=run).collect()]
        assert union_find(few) == union_find(brute_pairs(hs, 4))
    with pytest.raises(ValueError, match="left out"):
        near_pairs(df, 4, spanning=True, cross=True)


def test_dense_runs_are_bounded():
    """Texts that differ in few bits are looked up by their flips, as comparing all with all finds them."""
    r = np.random.default_rng(2)
    text = np.sort(r.choice(1 << 10, 300, replace=False).astype(np.uint64) | np.uint64(5 << 40))
    flipped = {(int(x), int(y)) for a, b in N._flipped(text, 3, 10) for x, y in zip(a, b, strict=True)}
    compared = {(int(x), int(y)) for a, b in N._compared(np.zeros(300, int), text, 3) for x, y in zip(a, b, strict=True)}
    assert flipped == compared and len(flipped) > 1000


def test_common_prefix():
    a = np.array([0, 0, 2**63, 2**64 - 1, 5], np.uint64)
    b = np.array([0, 1, 0, 2**64 - 2, 7], np.uint64)
    assert common_prefix(a, b).tolist() == [64, 63, 0, 63, 62]


def test_a_text_with_very_many_records_is_joined_in_blocks(spark, monkeypatch):
    """A third of all rows in one digest and one hash."""
    monkeypatch.setattr(O, "BLOCK_ROWS", 7)
    rows = [(i, 1 + i % 2, "hot", 5, "x", "y") for i in range(60)] + [(100 + i, 1 + i % 2, f"d{i}", i << 20, "x", "y") for i in range(120)]
    got = {(r.train_id, r.held_id) for r in cross_split_overlaps(overlap_rows(spark, rows), 1).collect()}
    wanted = {
        (a[0], b[0]) for a in rows for b in rows
        if a[1] == 1 and b[1] == 2 and (a[2] == b[2] or (a[3] ^ b[3]).bit_count() <= 1)
    }
    assert got == wanted


def test_near_pairs_of_nothing(spark):
    assert near_pairs(spark.createDataFrame([], "h bigint, side int"), 4).count() == 0
    assert near_pairs(spark.createDataFrame([(5, 3)], "h bigint, side int"), 4).count() == 0


def test_texts_are_permutations():
    texts = Texts(64, 6, 4)
    words = np.array([0, 2**64 - 1, 0x0123456789ABCDEF], np.uint64)
    for c in range(len(texts.orders)):
        t = texts.write(words, c)
        assert np.array_equal(np.bitwise_count(t), np.bitwise_count(words))
    assert 5 <= choose_bands(100, 4, 64) <= choose_bands(10**9, 4, 64) <= 11


def overlap_rows(spark, rows):
    return spark.createDataFrame(rows, "id bigint, side int, digest string, hash bigint, a string, th string")


def test_overlaps(spark):
    rows = [
        (1, 1, "d1", 0, "x", "y"), (2, 2, "d1", None, "x", "y"), (3, 2, None, 0b1111, "x", "y"), (4, 2, "d2", 0b11111, "x", "y"),
        (5, 1, "d1", None, None, None), (6, 1, None, None, None, None), (7, 2, None, None, None, None), (None, 2, "d1", 0, "", ""),
        (8, None, "d1", 0, "", ""), (9, 1, "d9", -1, "", ""), (9, 2, "d9", -1, "", ""), (10, 2, "d9", -1, "", ""), (1, 1, "d1", 0, "x", "y"),
    ]
    got = {tuple(r) for r in cross_split_overlaps(overlap_rows(spark, rows)).collect()}
    assert got == {(1, 2, True, None, None), (1, 3, False, 4, ~0b1111), (5, 2, True, None, None), (9, 10, True, 0, -1)}
    links = {tuple(r) for r in overlap_links(overlap_rows(spark, rows)).collect()}
    assert links == {
        ("digest", 1, 2, 0, 2, 1), ("digest", 9, 9, 0, 1, 2), ("hash", 1, 3, 4, 1, 1), ("hash", 9, 9, 0, 1, 2),
    }
    shares = {(r.id, r.side): (r.partners, r.covered) for r in coverage(cross_split_overlaps(overlap_rows(spark, rows))).collect()}
    assert shares[1, "train"] == (2, 124 / 128) and shares[3, "held_out"] == (1, 60 / 128) and shares[10, "held_out"] == (1, 1.0)


def test_overlaps_of_nothing(spark):
    assert cross_split_overlaps(overlap_rows(spark, [])).count() == 0
    assert cross_split_overlaps(overlap_rows(spark, [(1, 1, "d", 1, "", "")])).count() == 0


def union_find(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {(x, find(x)) for x in parent}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "nothing"])
def test_components(spark, shape):
    r = random.Random(1)
    links = {
        "random": [(r.randint(0, 300), r.randint(0, 300)) for _ in range(160)] + [(None, 3), (4, None), (999, 999), (5, 6), (6, 5), (5, 6)],
        "chain": [(i, i + 1) for i in range(200)] + [(1000 - i, 999 - i) for i in range(150)],
        "star": [(7, i) for i in range(500)] + [(600, 499)],
        "nothing": [],
    }[shape]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = [tuple(x) for x in connected_components(df).collect()]
    assert len(got) == len(set(got)) and set(got) == union_find(links)


def test_star_links(spark):
    rows = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "x", None), (2, "x", "q"), (4, None, "p"), (None, "x", "p")], "id bigint, k string, j string")
    scratch = Scratch(spark, "test")
    assert {tuple(r) for r in star_links(rows, ["k"], "id", scratch).collect()} == {(1, 2), (1, 3)}
    assert {tuple(r) for r in star_links(rows, ["k", "j"], "id", scratch).collect()} == {(1, 2)}


@pytest.mark.parametrize("bins", [1, 3, 16])
def test_difference_balances(bins):
    r = np.random.default_rng(bins)
    w = np.r_[r.integers(1, 40, 500), np.ones(200, int)]
    place = difference(w, bins)
    sums = np.bincount(place, weights=w, minlength=bins)
    assert place.min() >= 0 and place.max() < bins and sums.max() - sums.min() <= 3
    assert len(difference(np.array([], int), bins)) == 0


def test_allot_and_cover():
    shares = {"train": 0.7, "valid": 0.15, "test": 0.15}
    got = allot([5] * 100, shares, {})
    assert [got.count(s) for s in shares] == [70, 15, 15]
    of = {"a": {0, 1}, "b": {0}, "c": {1}, "d": {0}, "e": {1}}
    placed, short = cover([(x, w, frozenset(of[x])) for x, w in (("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 3))], shares)
    assert not short
    for c in (0, 1):
        assert {placed[x] for x in of if c in of[x] and x in placed} == set(shares)
    assert cover([("a", 1, frozenset({7}))], shares)[1] == {7}


SPLIT = "id bigint, group string, author string, stored string, classes array<int>, split string"
SHARES = {"train": 0.7, "valid": 0.15, "test": 0.15}


def check_split(rows, got, keys, links=(), classes=10, slack=0.02):
    """Every record once and its component whole, shares within the slack, each class in each split."""
    ids = {x[0] for x in rows if x[0] is not None}
    split = {x.id: x.split for x in got}
    assert len(got) == len({(x.id, x.stored) for x in got}) and split.keys() == ids
    pairs = [(x[0], (k, x[k])) for k in keys for x in rows if x[0] is not None and x[k]]
    first = {}
    pairs = [(i, first.setdefault(t, i)) for i, t in pairs] + list(links)
    root = dict(union_find(pairs))
    where = {}
    for x in got:
        assert x.component == root.get(x.id, x.id)
        assert where.setdefault(x.component, x.split) == x.split
    for s, share in SHARES.items():
        assert abs(sum(v == s for v in split.values()) / len(split) - share) <= slack
    held = {s: set() for s in SHARES}
    for x in rows:
        if x[0] is not None:
            held[split[x[0]]] |= set(x[4] or ())
    assert all(len(h) == classes for h in held.values())


def test_grouped_split(spark):
    r = random.Random(2)
    rows = [(i, f"g{r.randint(0, 400)}" if i % 9 else None, None, r.choice(["train", "test", None]), [r.randint(0, 9)], "x") for i in range(3000)]
    rows += [(i, "hot", None, "train", [1], "x") for i in range(5000, 6000)] + [(6000, "", None, "test", None, "x"), (None, "g1", None, "train", [1], "x")]
    rows += rows[:50]
    got = grouped_split(spark.createDataFrame(rows, SPLIT), SHARES).collect()
    check_split(rows, got, [1], slack=0.01)
    stored = {}
    for i, g, _, s, *_ in rows:
        if g and s and i is not None:
            stored.setdefault(g, set()).add(s)
    group = {x[0]: x[1] for x in rows}
    assert {group[x.id] for x in got if x.torn} == {g for g, s in stored.items() if len(s) > 1}


def test_records_tied_by_several_keys_and_links(spark):
    r = random.Random(4)
    rows = [(i, f"g{r.randint(0, 900)}" if r.random() < 0.4 else None, f"a{r.randint(0, 900)}" if r.random() < 0.4 else "", None, [r.randint(0, 4)], "x") for i in range(2000)]
    links = [(3 * i, 3 * i + 1) for i in range(100)] + [(None, 1), (7, 7)]
    df = spark.createDataFrame(rows, SPLIT)
    got = grouped_split(df, SHARES, keys=["group", "author"], links=spark.createDataFrame(links, "a bigint, b bigint")).collect()
    check_split(rows, got, [1, 2], links, classes=5)
    assert len({x.component for x in got}) < len({x.component for x in grouped_split(df, SHARES, keys=["group"]).collect()})


def test_a_hundred_classes(spark, monkeypatch):
    """Classes beyond any mask, some of them in heavy components only: more candidates are looked at."""
    monkeypatch.setattr(G, "LIGHTEST", 1)
    rows, i = [], 0
    for k in range(600):
        for _ in range(1 + (k % 7)):
            rows.append((i, f"g{k}", None, None, [k % 100, 100 + k % 3], "x"))
            i += 1
    check_split(rows, grouped_split(spark.createDataFrame(rows, SPLIT), SHARES).collect(), [1], classes=103)


def test_bins_of_many_partitions_are_combined(spark, monkeypatch):
    monkeypatch.setattr(G, "FAN", 2)
    rows = [(i, f"g{i // 2}", None, None, [0], "x") for i in range(4000)]
    df = spark.createDataFrame(rows, SPLIT).repartition(4)
    seen = []
    monkeypatch.setattr(G, "allot", lambda w, *a: seen.append(len(w)) or allot(w, *a))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = grouped_split(df, SHARES, bins=16).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check_split(rows, got, [1], classes=1, slack=1 / 16)
    assert seen == [16]


def test_grouped_split_of_little(spark):
    assert grouped_split(spark.createDataFrame([], SPLIT), SHARES).count() == 0
    got = grouped_split(spark.createDataFrame([(1, "g", None, None, None, None)], SPLIT), SHARES).collect()
    assert len(got) == 1 and got[0].split == "train" and got[0].torn is False
    with pytest.raises(ValueError, match="add up"):
        grouped_split(spark.createDataFrame([], SPLIT), {"train": 0.7})


@pytest.mark.parametrize("table", ["sf0.01"])
def test_split_of_the_manifest(spark, table):
    """No group in two splits, shares within a bin, all ten classes in each split."""
    folder = Path("/root/testdata") / table
    if not folder.exists():
        pytest.skip("the tables aren't here")
    images = {(r.image_id, r.split) for r in p3_split(spark, str(folder)).collect()}
    split = dict(images)
    assert len(split) == len(images)
    rows = spark.read.parquet(str(folder / "manifest.parquet")).select("image_id", "groupid", "objects.classid").collect()
    groups, held = {}, {s: set() for s in SHARES}
    for i, g, c in rows:
        if key := same_text_value(g):
            groups.setdefault(key, set()).add(split[i])
        held[split[i]] |= set(c or ())
    assert split.keys() == {r.image_id for r in rows if r.image_id is not None}
    assert all(len(s) == 1 for s in groups.values()) and all(len(h) == 10 for h in held.values())
    for s, share in SHARES.items():
        assert abs(sum(v == s for v in split.values()) / len(split) - share) <= 1 / 256
