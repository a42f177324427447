"""Pages of keywords, links or tags instead of sentences.

Method: suffix automaton of each page. Its words are the alphabet; the automaton gives for every place the longest
repeated string that ends there, hence the repeated maximal substrings and the characters they cover. A repeated
string is of keywords unless it is a long one in which nothing comes back within a dozen words: that is a sentence
copied, not a keyword.

Coverage is combined with missing clause structure, for which no list of words is given. The corpus itself tells which
words make clauses: pages covered by repeated keywords for the most part are certain lists, and the words of all pages
are counted inside lists and outside. A word much rarer in lists than in running text holds clauses together, whatever
its language; one much more frequent there is a word of lists; one too rare to tell says nothing. So a page in a
language that the corpus hardly holds is judged by its repetitions alone.

Both are evidence, word by word, for one of two states, list or sentence; the likeliest course of states over the page
(a two-state chain in which changes cost something) tells how many of its words stand in lists. Pages found so are
counted again, ROUNDS times in all, so that lists with few repetitions are known by the words of those with many.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import words
from lodestone.scratch import Scratch

#: The address of a link in markup; other markup isn't read.
ADDRESS = re.compile(r"""<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)[^>]*>""", re.IGNORECASE)
#: Letters of scripts that write no spaces between words (Thai, Lao, Burmese, Khmer, kana, Han): each is a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

#: A string is repeated if it has so many words and occurs so often: three times, in long pages once in a hundred words.
STRING, OCCURRENCES, EVERY = 2, 3, 100
#: A repeated string of so many words is a copied passage if less than this share of them comes back within as many.
PASSAGE, COMES_BACK = 12, 0.1
#: Least letters of a word that counts as coming back; shorter ones come back in any sentence, pairs of words don't.
LETTERS = 4
#: Shares of characters covered from which a page is a certain list, and below which it is certainly running text.
CERTAIN_LIST, CERTAIN_TEXT = 0.4, 0.1
#: How often words are counted.
ROUNDS = 2
#: What a word says for a list and against a sentence is a logarithm of odds, from CLAUSE to KEYWORD by the counts,
#: plus this for a word in a repeated string or outside. CHANGE is what a change between the states costs, FIRST how
#: much a page is taken for sentences beforehand.
CLAUSE, KEYWORD, REPEATED, PLAIN, CHANGE, FIRST = -2.4, 1.0, 0.6, -0.1, 4.0, 1.0
#: Counts are reckoned in units of one page of RARE, at least one page, so that a corpus of any size is judged alike: a
#: word says nothing below one unit of pages, nor below SUPPORT of them weighted alike for lists and texts, and one unit is
#: added on either side before the odds are taken. So the table of words has at most RARE times as many rows as a page has
#: different words on average.
RARE, SUPPORT = 10_000, 3
#: Words whose states are worked out together.
BLOCK = 1 << 15
#: Characters of pages held as words at once; a longer page is held by itself.
CHUNK = 1 << 22


def page_words(text: str) -> list[str]:
    """The words of a page, those of its links' addresses included, as they are where links aren't markup."""
    ws = words(ADDRESS.sub(r" \1 ", text) if "<" in text else text)
    if not text.isascii() and UNSPACED.search(text):
        return [x for w in ws for x in (UNSPACED.sub(r" \g<0> ", w).split() if UNSPACED.search(w) else (w,))]
    return ws


def repeated_lengths(ids: list[int], occurrences: int = OCCURRENCES) -> list[int]:
    """For each place, the length of the longest string ending there that occurs at least so often in the sequence.

    By the suffix automaton: occurrences of a state are those of the states that link to it, and its longest string
    is the maximal one of its places.
    """
    edges: list[dict[int, int]] = [{}]
    link, length, times, ends = [-1], [0], [0], []
    last = 0
    for c in ids:
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        times.append(1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(edges)
                edges.append(edges[q].copy())
                length.append(length[p] + 1)
                times.append(0)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
        ends.append(new)
    order = sorted(range(1, len(edges)), key=length.__getitem__)
    for v in reversed(order):
        times[link[v]] += times[v]
    best = [0] * len(edges)
    for v in order:
        best[v] = length[v] if times[v] >= occurrences else best[link[v]]
    return [best[v] for v in ends]


def maximal_repeats(lengths: list[int], string: int = STRING) -> list[tuple[int, int]]:
    """(first, end) of the repeated strings of at least so many words that no repeated string begun there goes beyond."""
    last = len(lengths) - 1
    return [(at - n + 1, at + 1) for at, n in enumerate(lengths) if n >= string and (at == last or lengths[at + 1] != n + 1)]


def _code(*keys: np.ndarray) -> np.ndarray:
    """One number for each tuple of keys, in their order; exact whatever their size."""
    code = keys[0].astype(np.int64)
    top = int(code.max(initial=0)) + 1
    for k in keys[1:]:
        width = int(k.max(initial=0)) + 1
        if top * width >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            top = int(code.max(initial=0)) + 1
        code = code * width + k
        top *= width
    return code


def _frequent(code: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether the code at each place occurs at least as often as is needed there, the same for the same code."""
    if not len(code):
        return np.zeros(0, bool)
    line = np.sort(code)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    size = np.diff(np.r_[first, len(line)])
    some = size >= need.min()  # few: all others are looked up no further
    line, size = line[first[some]], size[some]
    if not len(line):
        return np.zeros(len(code), bool)
    at = np.minimum(np.searchsorted(line, code), len(line) - 1)
    return (line[at] == code) & (size[at] >= need)


def _back(code: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each code the distance of its place to the same code's before it, a large number if there is none."""
    order = np.argsort(code, kind="stable")
    out = np.full(len(code), 1 << 30, np.int64)
    same = np.flatnonzero(code[order[1:]] == code[order[:-1]])
    out[order[same + 1]] = place[order[same + 1]] - place[order[same]]
    return out


def keyword_repeats(ids: np.ndarray, page: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Whether each word of several pages lies in a repeated string of keywords of its page.

    ``ids``: numbers of the words; ``page``: number of the page of each; ``letters``: length of each. A string that is
    repeated consists of pairs of neighbours that are as frequent, so each page's automaton reads only stretches of
    such pairs, with a mark of its own between two stretches.
    """
    out = np.zeros(len(ids), bool)
    if len(ids) < STRING:
        return out
    need = np.maximum(OCCURRENCES, np.bincount(page) // EVERY)
    pair = np.flatnonzero(page[1:] == page[:-1])
    code = _code(page[pair], ids[pair], ids[pair + 1])
    often = _frequent(code, need[page[pair]])
    pair, code = pair[often], code[often]
    if not pair.size:
        return out
    joined = np.zeros(len(ids), bool)  # a stretch ends where the next pair isn't frequent
    joined[pair] = True
    live = joined.copy()
    live[pair + 1] = True
    at = np.flatnonzero(live)
    # What comes back within a passage's length: words that aren't short, and pairs.
    near = np.zeros(len(ids), bool)
    near[at] = (_back(_code(page[at], ids[at]), at) <= PASSAGE) & (letters[at] >= LETTERS)
    two = pair[_back(code, pair) <= PASSAGE]
    near[two] = near[two + 1] = True
    back = np.r_[0, np.cumsum(near)]
    cuts = np.flatnonzero(np.r_[True, page[at[1:]] != page[at[:-1]]])
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(at)], strict=True):
        mine = at[lo:hi]
        sequence, place = [], []
        for k, i in zip(mine.tolist(), ids[mine].tolist(), strict=True):
            sequence.append(i)
            place.append(k)
            if not joined[k]:
                sequence.append(-k - 1)
                place.append(-1)
        for first, end in maximal_repeats(repeated_lengths(sequence, int(need[page[mine[0]]]))):
            a, b = place[first], place[end - 1] + 1
            if b - a < PASSAGE or back[b] - back[a] >= COMES_BACK * (b - a):
                out[a:b] = True
    return out


def list_states(evidence: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The likeliest course of states of several pages: whether each word stands in a list.

    Pages are taken in blocks that stay in the processor's cache.
    """
    out = np.zeros(len(evidence), bool)
    start = np.flatnonzero(np.r_[True, page[1:] != page[:-1]]) if len(page) else np.zeros(0, np.int64)
    edges = np.r_[start[np.flatnonzero(np.r_[True, np.diff(start // BLOCK) > 0])], len(page)] if len(page) else start
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        out[lo:hi] = _block_states(evidence[lo:hi], page[lo:hi])
    return out


def _block_states(evidence: np.ndarray, page: np.ndarray) -> np.ndarray:
    """The lead of the list state goes from word to word by d -> clip(d, -CHANGE, CHANGE) + evidence; such maps compose
    to maps of the same form, so all leads come by a prefix scan over the words, in as many steps as a page has bits."""
    n = len(evidence)
    start = np.r_[True, page[1:] != page[:-1]]
    # The map of the words up to each place: d -> min(high, max(low, d + add)); a page's first word forgets what was.
    add = evidence.astype(float)
    low, high = add - CHANGE, add + CHANGE
    low[start] = high[start] = add[start] - FIRST
    add[start] = 0.0
    step, longest = 1, int(np.bincount(page - page[0]).max())
    while step < longest:
        b, l2, h2 = add[step:], low[step:], high[step:]
        low[step:], high[step:] = np.minimum(np.maximum(low[:-step] + b, l2), h2), np.minimum(np.maximum(high[:-step] + b, l2), h2)
        add[step:] = add[:-step] + b
        step *= 2
    lead = np.minimum(np.maximum(add, low), high)
    # The state of a word is that of the next one where a change there wouldn't pay, which the lead before it tells.
    last = np.r_[start[1:], True]
    known = np.where(last, np.where(lead > 0, 1, -1), (lead >= CHANGE).astype(np.int64) - (lead <= -CHANGE))
    at = np.minimum.accumulate(np.where(known != 0, np.arange(n), n)[::-1])[::-1]
    return known[at] > 0


class Pages:
    """The words of a batch of pages, numbered: ``names`` of the numbers, ``ids``, ``page`` and ``letters`` of each word."""

    def __init__(self, flat: pa.Array, sizes: np.ndarray) -> None:
        coded = flat.dictionary_encode()
        self.names = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.sizes = sizes
        self.page = np.repeat(np.arange(len(sizes)), sizes)
        self.letters = pc.utf8_length(self.names).to_numpy()[self.ids].astype(np.int64)

    def share(self, mark: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """The share of the marked words of each page, weighted by ``weight``."""
        w = np.ones(len(self.ids)) if weight is None else weight
        return np.bincount(self.page, mark * w, len(self.sizes)) / np.bincount(self.page, w, len(self.sizes))

    def pages_with(self, mark: np.ndarray) -> np.ndarray:
        """In how many pages each word is among the marked ones."""
        line = np.sort(self.page[mark] * len(self.names) + self.ids[mark])
        once = line[np.flatnonzero(np.r_[True, line[1:] != line[:-1]])] if len(line) else line
        return np.bincount(once % len(self.names), minlength=len(self.names))


READ = "doc_id bigint, words string, covered array<int>, repeated_share double"
COUNTS = "word string, lists bigint, texts bigint"
FOUND = "doc_id bigint, list_share double, repeated_share double"


def _covered_pages(ids: list[int], texts: list[list[str]]) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    p = Pages(pa.array([w for ws in texts for w in ws], pa.string()), sizes)
    mark = keyword_repeats(p.ids, p.page, p.letters)
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    edge = np.r_[True, p.page[1:] != p.page[:-1]]
    first = np.flatnonzero(mark & (edge | ~np.r_[False, mark[:-1]]))
    end = np.flatnonzero(mark & (np.r_[edge[1:], True] | ~np.r_[mark[1:], False])) + 1
    of = p.page[first]
    runs = np.empty(2 * len(first), np.int32)
    runs[::2], runs[1::2] = first - begin[of], end - begin[of]
    offsets = np.r_[0, np.cumsum(2 * np.bincount(of, minlength=len(sizes)))]
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(runs))
    columns = [pa.array(ids, pa.int64()), pa.array([" ".join(ws) for ws in texts], pa.string()), lists, pa.array(p.share(mark, p.letters))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "covered", "repeated_share"])


def _read(documents: DataFrame) -> DataFrame:
    """Each page with words: these, and first and end of its stretches of repeated keywords by turns."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[list[str]] = []
        held = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                if ws := page_words(t):
                    ids.append(i)
                    texts.append(ws)
                    held += len(t)
                if held >= CHUNK:
                    yield _covered_pages(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield _covered_pages(ids, texts)

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInArrow(read, READ)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds more than CHUNK bytes of words, unless a page does."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of = np.cumsum(pc.binary_length(batch.column("words")).to_numpy()) // CHUNK
        cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield batch.slice(a, b - a)


def _batch(batch: pa.RecordBatch) -> tuple[Pages, np.ndarray, np.ndarray]:
    """The pages of a batch of READ, which of their words are covered, and their shares of covered characters."""
    lists = pc.split_pattern(batch.column("words"), " ")
    p = Pages(lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64))
    begin = np.r_[0, np.cumsum(p.sizes)[:-1]]
    runs = batch.column("covered")
    of = np.repeat(begin, pc.list_value_length(runs).to_numpy())
    edges = runs.flatten().to_numpy() + of
    change = np.zeros(len(p.ids) + 1, np.int64)
    np.add.at(change, edges[::2], 1)
    np.add.at(change, edges[1::2], -1)
    return p, np.cumsum(change[:-1]) > 0, batch.column("repeated_share").to_numpy()


def _states(p: Pages, covered: np.ndarray, evidence: dict[str, float]) -> np.ndarray:
    of = np.fromiter((evidence.get(w, 0.0) for w in p.names.to_pylist()), float, len(p.names))
    return list_states(of[p.ids] + np.where(covered, REPEATED, PLAIN), p.page)


def _count(pages: DataFrame, sent, threshold: float) -> DataFrame:
    """In how many pages each word stands in a list and in running text; by coverage alone if nothing is known yet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            p, covered, share = _batch(batch)
            if sent is None:
                lists = covered & (share >= CERTAIN_LIST)[p.page]
                texts = (share < CERTAIN_TEXT)[p.page]
            else:
                state = _states(p, covered, sent.value)
                lists = state & (p.share(state) > threshold)[p.page]
                texts = ~state
            yield pa.RecordBatch.from_arrays([p.names, pa.array(p.pages_with(lists)), pa.array(p.pages_with(texts))], ["word", "lists", "texts"])

    return pages.mapInArrow(count, COUNTS).groupBy("word").agg(F.sum("lists").alias("lists"), F.sum("texts").alias("texts"))


def word_evidence(counts: DataFrame, pages: int) -> dict[str, float]:
    """What each word says for a list, from the pages it stands in lists and in running text; words that say nothing
    are left out. ``pages``: how many were counted."""
    total = counts.agg(F.sum("lists"), F.sum("texts")).first()
    if not total[0] or not total[1]:
        return {}
    ratio, unit = total[0] / total[1], max(1.0, pages / RARE)
    kept = counts.where((F.col("lists") + F.col("texts") >= unit) & (F.col("lists") + F.col("texts") * ratio > SUPPORT * unit))
    return {r["word"]: min(KEYWORD, max(CLAUSE, math.log((r["lists"] + unit) / (r["texts"] * ratio + unit)))) for r in kept.collect()}


def keyword_pages(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, list_share double, repeated_share double`` of the pages with more than ``threshold`` of their words in
    keywords, links or tags and not in sentences; ``repeated_share`` is the share of characters in repeated keywords.

    ``documents``: ``doc_id bigint, text string``; other columns are ignored. Words are those of
    :mod:`lodestone.llm.words`, those of scripts without spaces letter by letter: markup between angle brackets isn't
    counted, but for the addresses of links. Null ids, null texts and texts without words are no such pages. A repeated
    id gives as many rows. An empty table gives an empty one. Pages are read once, wholly and in time in proportion to
    their length, and written; only counts of words are shuffled.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "stuffing")
    pages = scratch.write(_read(documents), "pages")
    n, sent = pages.count(), None
    for k in range(ROUNDS):
        counts = scratch.write(_count(pages, sent, threshold), f"words{k}")
        sent = spark.sparkContext.broadcast(word_evidence(counts, n))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            p, covered, share = _batch(batch)
            found = p.share(_states(p, covered, sent.value))
            keep = pa.array(found > threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(keep), pa.array(found).filter(keep), pa.array(share).filter(keep)], ["doc_id", "list_share", "repeated_share"])

    return pages.mapInArrow(judge, FOUND)
