"""Pairs of 64-bit hashes that differ in at most d bits, by a suffix array over texts of their bits.

Two hashes that differ in at most d bits agree on at least m - d of any m bands. So a hash is written as several texts
of 64 bits, one for each choice of m - d bands: the chosen bands first, the others behind them. The record's texts are
concatenated, and the suffixes that begin with a text are indexed: partitioned by their first bits, so that suffixes
that begin alike meet, and sorted. A scan computes the common prefix of adjacent suffixes; a run goes on while it holds
at least the chosen bands. Any two suffixes of a run share that prefix, so two near hashes stand in one run of some
text; the count of differing bits decides on the pairs of a run (texts are permutations of the bits, so it is that of
the hashes).

Runs of more than RUN suffixes are written again with further bands chosen among the bits behind their common prefix,
and sorted anew. Where few bits are left, a run's suffixes are looked up with each choice of at most d of these flipped
if that is less than comparing all. So a run of n costs no more than n * min(n, RUN) or n times the choices of at most
d of LAST_BITS bits. m grows with the number of hashes, so that the expected pairs stay in proportion to the hashes; it
changes the cost only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import Scratch

#: The longest run of suffixes with a common prefix that is compared pair by pair.
RUN = 2048
#: Runs in which at most so many bits can differ aren't written again; they have at most 2**LAST_BITS suffixes.
LAST_BITS = 20
#: Pairs of one step of the work in memory.
BLOCK = 1 << 20
#: Bits of a path that hold the number of the text.
CHOICE_BITS = 16
ALL = (1 << 64) - 1


def bands(bits: int, m: int) -> list[tuple[int, int]]:
    """(low bit, width) of m bands of nearly equal width over the lowest bits."""
    edges = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def choose_bands(n: int, d: int, bits: int) -> int:
    """The number of bands for which texts written plus pairs expected among n random hashes is least."""

    def cost(m: int) -> float:
        shortest = (m - d) * (bits // m)
        return comb(m, d) * (n + n * n / 2 ** (shortest + 1))

    return min(range(d + 1, min(2 * d + 4, bits // 2) + 1), key=cost)


class Texts:
    """The texts of 64-bit words over their lowest ``bits``: for each choice of m - d bands, these moved to the front.
    ``prefix``: how many bits, those above ``bits`` included, a run of each text has in common."""

    def __init__(self, bits: int, m: int, d: int) -> None:
        self.bits = bits
        all_bands = bands(bits, m)
        self.orders, prefix = [], []
        for chosen in combinations(range(m), m - d):
            self.orders.append([all_bands[i] for i in chosen] + [b for i, b in enumerate(all_bands) if i not in chosen])
            prefix.append(64 - bits + sum(all_bands[i][1] for i in chosen))
        self.prefix = np.array(prefix, np.int64)
        if len(prefix) >> CHOICE_BITS:
            raise ValueError("too many texts for each hash")

    def least(self, path: np.ndarray) -> np.ndarray:
        """The bits that runs of these paths have in common."""
        return self.prefix[(path & np.uint64((1 << CHOICE_BITS) - 1)).astype(np.int64)]

    def write(self, word: np.ndarray, c: int) -> np.ndarray:
        """The c-th text of each word, whose bits above ``bits`` stay where they are."""
        out = word & np.uint64(ALL ^ ((1 << self.bits) - 1))
        at = self.bits
        for low, width in self.orders[c]:
            at -= width
            out |= ((word >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(at)
        return out


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bits two texts share."""
    x = a ^ b
    for k in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(k))
    return 64 - np.bitwise_count(x).astype(np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number that says in which partition suffixes of one text that begin alike meet."""
    out = np.zeros(len(a), np.uint64)
    for p in (a, b):
        out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sides of two suffixes, bits 1 and 2 or both, hold one of each."""
    return ((a & 1) & (b >> 1) | (b & 1) & (a >> 1)).astype(bool)


def _compared(run: np.ndarray, h: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of each run with 1 to d differing bits, by comparing all of a run. ``run`` is sorted."""
    at, k = np.arange(len(run) - 1), 1
    while at.size:
        at = at[at + k < len(run)]
        at = at[run[at + k] == run[at]]
        for lo in range(0, at.size, BLOCK):
            a = at[lo : lo + BLOCK]
            differ = np.bitwise_count(h[a] ^ h[a + k])
            good = (differ > 0) & (differ <= d)
            if good.any():
                yield a[good], a[good] + k
        k += 1


def _flipped(text: np.ndarray, d: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of one run, sorted texts that differ in the lowest ``bits`` only, with 1 to d differing bits."""
    for k in range(1, min(d, bits) + 1):
        for flip in combinations(range(bits), k):
            other = text ^ np.uint64(sum(1 << i for i in flip))
            at = np.minimum(np.searchsorted(text, other), len(text) - 1)
            good = np.flatnonzero((text[at] == other) & (text < other))
            if good.size:
                yield good, at[good]


def _spanned(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs that connect what the given ones connect: each place but the least of its group, with that."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (label[label] != label).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def near_pairs(hashes: DataFrame, d: int, *, cross: bool = False, spanning: bool = False, scratch: Scratch | None = None, run: int = RUN) -> DataFrame:
    """``a bigint, b bigint``: every two different hashes that differ in at most d bits, once, in no stated order.

    ``hashes``: ``h bigint, side tinyint``, each hash once and none null. With ``cross``, only pairs of which one has
    bit 1 of ``side`` and the other bit 2. With ``spanning``, not all pairs but some that connect, directly or through
    others, exactly the hashes that all pairs connect, no more than suffixes; the two of one needn't be near. Empty or
    single hashes give no pair. Exact for every d from 0 to 16.
    """
    if not 0 <= d <= 16:
        raise ValueError("d must be from 0 to 16")
    if cross and spanning:
        raise ValueError("pairs of two sides can't be left out")
    scratch = scratch or Scratch(hashes.sparkSession, "nearhash")
    hashes = scratch.write(hashes.select("h", F.col("side").cast("tinyint").alias("side")), "hashes")
    n = hashes.count()
    bits, level = 64, 0
    members = hashes.select(F.lit(0).cast("bigint").alias("path"), F.col("h").alias("text"), "h", "side")
    pairs = None
    while True:
        texts = Texts(bits, choose_bands(max(n, 2), d, bits) if level == 0 else d + 2, d)
        bits = 64 - int(texts.prefix.min())
        # Where few bits are left a run has few suffixes, for they are different and share all bits before these.
        limit = run if bits > LAST_BITS else 1 << 62
        found = scratch.write(_scan(_suffixes(members, texts), texts, d, cross, spanning, limit), f"level{level}")
        here = found.where("kind = 0").select("a", "b")
        pairs = here if pairs is None else pairs.unionByName(here)
        hot = found.where("kind > 0")
        if hot.isEmpty():
            return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        members = hot.select(F.col("b").alias("path"), "text", F.col("a").alias("h"), F.col("kind").alias("side"))
        level += 1


SUFFIX = "part bigint, path bigint, text bigint, h bigint, side tinyint"
FOUND = "kind tinyint, a bigint, b bigint, text bigint"


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return [c.view(np.uint64) if c.dtype == np.int64 else c for c in columns]


def _table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    fields = [x.split()[0] for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int8)) for c in columns], fields)


def _suffixes(members: DataFrame, texts: Texts) -> DataFrame:
    """A row for each text of each member; ``path`` tells which choices of bands led to the text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, text, h, side = _numbers(batch)
            for c, prefix in enumerate(texts.prefix.tolist()):
                t = texts.write(text, c)
                # The choice in the low bits; what came before, mixed. Paths that fall together merely meet.
                p = _mix(path, np.full(len(path), c)) << np.uint64(CHOICE_BITS) | np.uint64(c)
                yield _table(SUFFIX, _mix(p, t >> np.uint64(64 - prefix)), p, t, h, side)

    return members.mapInArrow(write, SUFFIX)


def _scan(suffixes: DataFrame, texts: Texts, d: int, cross: bool, spanning: bool, limit: int) -> DataFrame:
    """Sorted suffixes, scanned: kind 0 a pair of hashes a, b; else a member (hash, path, text) of too long a run."""
    choices = sum(comb(64 - int(texts.prefix.min()), k) for k in range(1, d + 1))

    def runs(path: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The run of each suffix: one goes on while the common prefix with the suffix before holds the chosen bands."""
        return np.cumsum(np.r_[0, (path[1:] != path[:-1]) | (common_prefix(text[1:], text[:-1]) < texts.least(path[1:]))])

    def pairs_of(run: np.ndarray, path: np.ndarray, text: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.bincount(run)
        long = size > max(2 * choices, RUN)  # only where few bits are left
        short = np.flatnonzero((size[run] > 1) & ~long[run])
        for a, b in _compared(run[short], h[short], d):
            yield short[a], short[b]
        for r in np.flatnonzero(long).tolist():
            lo, hi = np.searchsorted(run, [r, r + 1])
            for a, b in _flipped(text[lo:hi], d, 64 - int(texts.least(path[lo : lo + 1])[0])):
                near = np.bitwise_count(h[a + lo] ^ h[b + lo]) <= d
                yield a[near] + lo, b[near] + lo

    def compare(path: np.ndarray, text: np.ndarray, h: np.ndarray, side: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(path):
            return
        run = runs(path, text)
        if (far := (np.bincount(run) > limit)[run]).any():
            yield _table(FOUND, side[far], h[far], path[far], text[far])
            path, text, h, side, run = (x[~far] for x in (path, text, h, side, run))
        found = pairs_of(run, path, text, h)
        for a, b in (_spanned(found, len(h)),) if spanning else found:
            if cross:
                good = _crossing(side[a], side[b])
                a, b = a[good], b[good]
            if len(a):
                yield _table(FOUND, np.zeros(len(a)), h[a], h[b], h[a])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        going: tuple[np.ndarray, np.ndarray] | None = None  # path and text of a run known to be too long
        for batch in batches:
            if not batch.num_rows:
                continue
            now = _numbers(batch)[1:]
            now = now if rest is None else [np.concatenate(x) for x in zip(rest, now, strict=True)]
            rest = None
            if going is not None:  # its members leave at once
                run = runs(*(np.concatenate(x) for x in zip(going, now[:2], strict=True)))[1:]
                end = int(np.searchsorted(run, 1))
                yield _table(FOUND, now[3][:end], now[2][:end], now[0][:end], now[1][:end])
                now = [x[end:] for x in now]
                if not len(now[0]):
                    continue
                going = None
            run = runs(now[0], now[1])
            last = int(np.searchsorted(run, run[-1]))
            yield from compare(*(x[:last] for x in now))
            rest = [x[last:] for x in now]
            if len(rest[0]) > limit:
                yield _table(FOUND, rest[3], rest[2], rest[0], rest[1])
                going, rest = (rest[0][:1], rest[1][:1]), None
        if rest is not None:
            yield from compare(*rest)

    return suffixes.repartition("part").sortWithinPartitions("path", "text").mapInArrow(scan, FOUND)
