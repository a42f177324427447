"""Packing, leaked passages and keyword pages."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import leaks as L
from lodestone.llm.leaks import leaked_passages, shingle_keys
from lodestone.llm import packing as P
from lodestone.llm.packing import contexts, make_plan, pack, step_groups
from lodestone.llm import stuffing as S
from lodestone.llm.stuffing import keyword_pages, keyword_repeats, list_states, maximal_repeats, page_words, repeated_lengths
from lodestone.llm import tokens as T
from lodestone.llm.tokens import RANKS, count_tokens, encoding, token_counts
from lodestone.llm.words import words


def test_words():
    assert words("A<b>ß</b> x\u200by\u00adz １２ don't_go") == ["a", "ss", "xyz", "12", "don", "t", "go"]
    assert words(None) == words("") == words("<p> . </p>") == []


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=20))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_item_once(counts):
    plan = make_plan(counts, 40)
    load, seen = np.zeros(plan.containers, int), {n: [] for n in counts}
    for length, rank, n, first in plan.placed:
        load[first : first + n] += length
        seen[length] += range(rank, rank + n)
    assert all(sorted(x) == list(range(counts[n])) for n, x in seen.items())
    assert (load <= 40).all() and (load > 0).all()
    assert sum(n for _, n, _ in plan.rooms) == plan.containers
    for first, n, left in plan.rooms:
        assert (load[first : first + n] == 40 - left).all()
    assert sorted(p for f, n, at in step_groups(plan, 4) for p in range(at, at + n)) == list(range(plan.containers))


def plain_best_fit(items, capacity):
    """Containers of best-fit decreasing, item by item."""
    room = []
    for n in sorted(items, reverse=True):
        fits = [j for j, left in enumerate(room) if left >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_pack(spark):
    r = random.Random(4)
    sizes = {i: r.choice([1, 7, 64, 100, 33, 50, 51, r.randint(1, 350)]) for i in range(2000)}
    df = spark.createDataFrame([(i, n, "x", 1) for i, n in sizes.items()] + [(None, 5, "x", 1), (1, None, "x", 1), (2, 0, "x", 1)], "id bigint, units bigint, container string, step int")
    rows = pack(df, 100, step=8).collect()
    load, pieces, groups = {}, {}, {}
    for x in rows:
        load[x.container] = load.get(x.container, 0) + x.units
        pieces.setdefault(x.id, []).append((x.piece, x.first_unit, x.units))
        groups.setdefault(x.step, set()).add(x.container)
    assert {i: sum(u for *_, u in p) for i, p in pieces.items()} == sizes
    for i, p in pieces.items():
        assert sorted(p) == [(k, 100 * k, min(100, sizes[i] - 100 * k)) for k in range(-(-sizes[i] // 100))]
    assert max(load.values()) <= 100 and sorted(load) == list(range(len(load)))
    assert len(load) <= 1.005 * plain_best_fit([min(100, n - 100 * k) for n in sizes.values() for k in range(-(-n // 100))], 100) + 1
    opener = {}
    for x in rows:
        assert x.context in (12, 25, 50, 100) and x.tier == [12, 25, 50, 100].index(min(c for c in (12, 25, 50, 100) if c >= x.units))
        opener.setdefault(x.container, set()).add(x.context)
    assert all(len(c) == 1 for c in opener.values()) and len(set().union(*opener.values())) > 1
    step = [sum(load[c] for c in g) for g in groups.values()]
    assert max(map(len, groups.values())) <= 8 and max(step) - min(step) <= 2 * 100


def test_pack_nothing_and_ties(spark):
    assert pack(spark.createDataFrame([], "id bigint, units bigint"), 100).count() == 0
    rows = pack(spark.createDataFrame([(1, 60)] * 5, "id bigint, units bigint"), 100).collect()
    assert len({x.container for x in rows}) == 5


def test_tiers_are_packed_one_by_one():
    """Windows of half the capacity are opened in pairs, and their gaps filled from the shorter tiers."""
    plan = make_plan({60: 4, 40: 4, 20: 8, 10: 8}, 100)
    # The gaps of 60 take the items of 40; these were routed to windows of 50.
    assert plan.opened[0] == (0, 4, 3) and (40, 0, 4, 0) in plan.placed and plan.containers == 7
    two = make_plan({30: 8, 10: 12}, 100)
    # Two windows of 50 a container, each with one item of 30, and 40 left for four of 10.
    assert two.opened == [(0, 4, 2)] and two.containers == 4
    without = make_plan({30: 8, 10: 12}, 100, tiers=(8, 4))
    assert without.opened != two.opened and sorted(without.placed) != sorted(two.placed)
    assert contexts(100) == [12, 25, 50, 100] and contexts(3) == [1, 3]


def test_a_tier_fills_its_own_gaps_where_the_shorter_ones_are_empty():
    assert make_plan({30: 9}, 100).containers == 3  # three of 30 in a container, not one for each window of 50
    assert P._plan({30: 9}, 100, contexts(100), frozenset()).containers == 5


def test_plan_stays_small():
    """As many ranges for a thousand times the items, but for rounding."""
    r = random.Random(8)
    counts = {n: r.randint(0, 40) for n in range(1, 513)}
    small, large = make_plan(counts, 512), make_plan({n: 1000 * c for n, c in counts.items()}, 512)
    assert len(large.placed) < 10 * 512 and len(large.rooms) < 4 * 512
    assert abs(large.containers - 1000 * small.containers) <= 0.005 * large.containers + 1000


def test_tokens_of_long_stretches():
    enc = encoding(RANKS)
    assert count_tokens("international" * 9000, enc) == 9000
    assert count_tokens(" " * 20_000 + "x", enc) == len(enc.encode_ordinary(" " * 20_000 + "x"))
    assert 0 < count_tokens("a" + " " * 3_000_000, enc) <= 3_000_001  # beyond what the pattern's engine takes at once
    r = random.Random(1)
    keep, T.LONG_BLANKS = T.LONG_BLANKS, T.re.compile(T.LONG_BLANKS.pattern.replace("4096", "3"))
    try:
        for _ in range(2000):
            t = "".join(r.choice(["a", "b1", " ", "  ", "\n", "\t", "\x85", "\u3000", "'s", "!", "語"]) for _ in range(r.randint(0, 25)))
            assert count_tokens(t, enc) == len(enc.encode_ordinary(t)), repr(t)
    finally:
        T.LONG_BLANKS = keep


def test_token_counts(spark):
    texts = ["", " \n", None, "temu kunci", "<|endoftext|> ü", "kata " * 40_000, "x" * 1000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.tokens for r in token_counts(df).collect()}
    enc = encoding(RANKS)
    assert got == {i: len(enc.encode_ordinary(texts[i])) for i in (3, 4, 5, 6)}


def brute_leaks(docs, items, window):
    def grams(ws):
        return {tuple(ws[i : i + window]) for i in range(len(ws) - window + 1)}

    g = [(i, grams(words(t))) for i, t in items]
    return {(d, i): len(x & grams(words(t))) for d, t in docs for i, x in g if x & grams(words(t))}


@pytest.mark.parametrize(("window", "bits"), [(6, 1 << 27), (5, 64), (12, 128)])
def test_leaks(spark, window, bits):
    """Also with filters far too small, which let nearly everything through."""
    r = random.Random(window)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(2, 40)))) for i in range(12)]
    docs = []
    for i in range(80):
        t = r.choices([*vocabulary, "zz"], k=r.randint(0, 30))
        if i % 3 == 0:
            src = items[r.randrange(12)][1].split()
            t[5:5] = src[: r.randint(1, len(src))]
        docs.append((i, " ".join(t).upper() if i % 2 else "<p>" + ", ".join(t) + "</p>"))
    docs += [(100, ""), (101, " ".join(["zz"] * 50_000) + " " + items[0][1]), (102, items[3][1])]
    d = spark.createDataFrame([*docs, (None, items[0][1]), (103, None)], "doc_id bigint, text string").selectExpr("*", "1 as item_id", "'x' as windows")
    i = spark.createDataFrame([*items, (50, None), (None, items[0][1])], "item_id bigint, text string").selectExpr("*", "'y' as doc_id")
    got = {(x.doc_id, x.item_id): x.windows for x in leaked_passages(d, i, window=window, most_bits=bits).collect()}
    assert got == brute_leaks(docs, items, window)


def test_leaks_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert leaked_passages(d, i).count() == 0
    assert leaked_passages(d.where("false"), spark.createDataFrame([(1, "a " * 20)], "item_id bigint, text string")).count() == 0


def test_shingle_keys():
    keys, starts = shingle_keys([list("abcab"), [], list("ab"), list("cab")], 3)
    assert starts.tolist() == [0, 5, 5, 7, 10] and np.flatnonzero(keys).tolist() == [0, 1, 2, 7] and keys[2] == keys[7] != keys[0]
    assert shingle_keys([], 3)[0].tolist() == [] and shingle_keys([["a"]], 3)[0].tolist() == [0]
    assert L.SHINGLE == 5


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(2, 4))
@settings(max_examples=80, deadline=None)
def test_automaton_against_counting(ids, least):
    lengths = repeated_lengths(ids, least)
    for end, n in enumerate(lengths):
        def times(k, end=end):
            x = ids[end - k + 1 : end + 1]
            return sum(ids[j : j + k] == x for j in range(len(ids) - k + 1))

        assert n == 0 or times(n) >= least
        assert n == end + 1 or times(n + 1) < least


def marked(text):
    """The words of a text that lie in repeated keywords."""
    ws = page_words(text)
    number = {w: i for i, w in enumerate(dict.fromkeys(ws))}
    mark = keyword_repeats(np.array([number[w] for w in ws], np.int64), np.zeros(len(ws), np.int64), np.array([len(w) for w in ws], np.int64))
    return [w for w, m in zip(ws, mark, strict=True) if m]


def test_maximal_repeats():
    assert maximal_repeats(repeated_lengths([0, 1, 2, 0, 1, 3, 0, 1], 3)) == [(0, 2), (3, 5), (6, 8)]
    assert maximal_repeats([]) == maximal_repeats([0]) == []
    assert marked("red shoes x red shoes y red shoes") == ["red", "shoes"] * 3
    assert marked("") == marked("red") == marked("red shoes x red shoes") == []


def test_a_copied_sentence_is_no_keyword():
    assert marked(HONEST * 5) == []
    assert len(marked("toko jahe di Bandung dan toko jahe di Solo dan toko jahe di Malang dan " * 3)) == 3 * 15


@given(st.lists(st.lists(st.integers(0, 3), max_size=40), max_size=5))
@settings(max_examples=80, deadline=None)
def test_stretches_of_pairs_hold_all_repeats(pages):
    """Against automata of the whole pages, where every string is short enough to be of keywords."""
    ids = np.array([i for x in pages for i in x], np.int64)
    page = np.repeat(np.arange(len(pages)), [len(x) for x in pages])
    mark = keyword_repeats(ids, page, np.full(len(ids), 9, np.int64))
    wanted = []
    for x in pages:
        out = [False] * len(x)
        for a, b in maximal_repeats(repeated_lengths(x, S.OCCURRENCES)):
            out[a:b] = [True] * (b - a)
        wanted += out
    assert mark.tolist() == wanted


def plain_states(evidence):
    """The better of all courses by the two-state chain, word by word."""
    best = {False: (0.0, []), True: (-S.FIRST, [])}
    for e in evidence:
        best = {
            s: max(((v - (S.CHANGE if r != s else 0.0), [*path]) for r, (v, path) in best.items()), key=lambda x: x[0]) for s in (False, True)
        }
        best = {s: (v + (e if s else 0.0), [*path, s]) for s, (v, path) in best.items()}
    return max(best.values(), key=lambda x: x[0])


def test_states_against_the_plain_chain():
    r = random.Random(6)
    pages = [[r.choice([-2.4, -1.1, 0.5, 0.61, 1.6]) + r.random() / 1000 for _ in range(r.randint(1, 70))] for _ in range(60)]
    got = list_states(np.array([e for x in pages for e in x]), np.repeat(np.arange(60), [len(x) for x in pages])).tolist()
    for x in pages:
        mine, got = got[: len(x)], got[len(x) :]
        value, _ = plain_states(x)
        changes = sum(a != b for a, b in zip(mine, mine[1:], strict=False))
        assert abs(sum(e for e, s in zip(x, mine, strict=True) if s) - S.CHANGE * changes - (S.FIRST if mine[0] else 0.0) - value) < 1e-6


HONEST = "In the notes of the cook, the older node was wrapped in a wet cloth so that it stayed firm until the grower came back from the market. "
LISTS = {
    1: "ginger cheap online, ginger best shop, turmeric cheap online, ginger cheap online, galangal best shop, " * 4,
    2: "#ginger\n#buyginger\n#turmericshop\n#galangal\n#cheapginger\n" * 6,
    3: " ".join(f"https://shop{i}.example/buy-ginger" for i in range(30)),
    4: "\n".join(f"SKU: ginger powder {i}g" for i in range(30)),
    5: "toko jahe di Bandung dan toko jahe di Solo dan toko jahe di Malang dan toko jahe di Tuban dan " * 3,
    6: HONEST + "cheap ginger powder " * 40,
    8: "".join(f'<a href="https://shop{i}.example/buy-ginger-{i}">galangal</a>\n' for i in range(6)) + HONEST,
}
PAGES = {
    10: HONEST * 3, 11: HONEST, 12: HONEST * 6 + "\nTags: ginger, turmeric, galangal, cheap ginger, ginger powder",
    19: HONEST * 3 + '<a href="https://shop.example/ginger">galangal</a> ' + HONEST,
    13: HONEST.lower().replace(",", "").replace(".", "") * 4, 14: HONEST.upper() * 2, 15: "", 16: "...", 17: None, 18: "Jahe itu dicuci lalu dijemur sampai kering.",
}


def test_keyword_pages(spark):
    rows = [(i, t, 1.0) for i, t in (LISTS | PAGES).items()] + [(None, LISTS[1], 1.0), (7, "cheap ginger powder " * 30_000, 1.0)]
    found = keyword_pages(spark.createDataFrame(rows, "doc_id bigint, text string, list_share double")).collect()
    assert {r.doc_id for r in found} == set(LISTS) | {7}
    assert all(0.5 < r.list_share <= 1 and 0 <= r.repeated_share <= 1 for r in found)
    assert keyword_pages(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


PROSE = {
    "french": "Le matin, la vieille dame descendait au marché avec son panier, et les marchands la saluaient tous. Elle ne choisissait que les racines les plus fermes, parce que son mari, qui avait été cuisinier, lui avait appris à les reconnaître. Quand la pluie tombait, elle restait sous l'auvent et parlait longtemps avec le boulanger de la rue voisine.",
    "german": "Am Morgen ging die alte Frau mit ihrem Korb zum Markt, und alle Händler grüßten sie. Sie wählte nur die festesten Wurzeln, weil ihr Mann, der früher Koch gewesen war, ihr gezeigt hatte, woran man sie erkennt. Wenn es regnete, blieb sie unter dem Vordach stehen und sprach lange mit dem Bäcker aus der Nachbarstraße.",
    "spanish": "Por la mañana la anciana bajaba al mercado con su cesta y todos los vendedores la saludaban. Sólo escogía las raíces más firmes, porque su marido, que había sido cocinero, le había enseñado a reconocerlas. Cuando llovía se quedaba bajo el toldo y hablaba largo rato con el panadero de la calle vecina.",
    "finnish": "Aamulla vanha nainen meni koreineen torille, ja kaikki kauppiaat tervehtivät häntä. Hän valitsi vain kiinteimmät juuret, koska hänen miehensä, joka oli ollut kokki, oli opettanut hänet tunnistamaan ne. Kun satoi, hän seisoi katoksen alla ja jutteli pitkään naapurikadun leipurin kanssa.",
    "chinese": "早上，老太太提着篮子去市场，所有的商贩都向她问好。她只挑最结实的根，因为她的丈夫以前是厨师，教过她怎样辨认。下雨的时候，她就站在屋檐下，和隔壁街的面包师聊很久。后来雨停了，孩子们跑出来踢球，她才慢慢走回家。",
    "english recipe": "Peel the ginger. Slice it thin. Heat oil in a pan. Add garlic, stir well. Pour in stock, bring to a boil. Lower the heat. Simmer for ten minutes. Season with salt. Serve hot over rice. Garnish with spring onion. Keep leftovers chilled. Reheat gently before eating.",
}
STUFFED = {
    "fillers": "the ginger for sale that was cheap of ginger with dried ginger and the sliced ginger for the ginger of sale " * 6,
    "inflected": "dried ginger, sliced ginger, powdered ginger, pickled ginger, candied ginger, ground ginger, " * 5,
    "french": "gingembre pas cher, gingembre en ligne, gingembre bio pas cher, acheter gingembre, gingembre en poudre pas cher, " * 4,
    "chinese": "便宜生姜批发 生姜批发价格 生姜批发网 便宜生姜批发 生姜批发市场 " * 5,
}


def test_keyword_pages_in_languages_that_the_corpus_does_not_hold(spark):
    texts = [*PROSE.values(), *(t * 2 for t in PROSE.values()), *STUFFED.values()]
    found = {r.doc_id for r in keyword_pages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert found == set(range(2 * len(PROSE), len(texts)))
    alone = spark.createDataFrame(list(enumerate(PROSE.values())), "doc_id bigint, text string")
    assert keyword_pages(alone).count() == 0


def test_word_evidence_is_alike_at_every_size(spark):
    """Ten times the pages with ten times the counts say the same."""
    rows = [(f"w{i}", i % 7 * 40, i * 13 % 900) for i in range(200)]
    of = []
    for times in (1, 10, 100):
        counts = spark.createDataFrame([(w, a * times, b * times) for w, a, b in rows], "word string, lists bigint, texts bigint")
        of.append(S.word_evidence(counts, 20_000 * times))
    assert len(of[0]) > 50 and of[0].keys() == of[1].keys() == of[2].keys()
    assert all(abs(of[0][w] - x[w]) < 1e-9 for x in of[1:] for w in x)


def test_lists_without_repetition_are_known_by_the_words_of_other_lists(spark):
    """Words of lists are learnt from pages that repeat them; words of clauses from all others."""
    r = random.Random(3)
    nouns = [f"{a}{b}" for a in ("gin", "tur", "gal", "men", "cur") for b in ("ger", "meric", "angal", "thol", "cuma")]
    ads = ["cheap", "wholesale", "online", "capsule", "bestprice", "nearme"]
    glue = ["the", "which", "because", "into", "was", "from", "while", "after"]
    verbs = ["boiled", "washed", "carried", "found", "sold", "planted"]
    lists = [" ".join(f"{r.choice(nouns)} {r.choice(ads)}" for _ in range(120)) for _ in range(30)]
    single = [" ".join(f"{n} {r.choice(ads)}" for n in r.sample(nouns, 20)) for _ in range(5)]
    prose = [" ".join(f"{r.choice(glue)} {r.choice(nouns)} {r.choice(glue)} {r.choice(verbs)} {r.choice(glue)} person{r.randint(0, 999)}" for _ in range(12)) for _ in range(200)]
    texts = prose + lists + single
    found = {x.doc_id for x in keyword_pages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert found == set(range(len(prose), len(texts)))
