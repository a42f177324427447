"""Documents that hold passages of evaluation items.

Method: prefix-filtered set join. An item's windows of so many consecutive words are what must be contained; each is a
set of shingles with their places. Shingles are ordered by rarity over all documents; a document can hold a window
only if it holds the window's rarest shingle, its necessary prefix, so only these are joined. Place and length bounds
then fix where in the document the window would lie, and the window's words are compared there one by one, which decides
exactly.

Documents are read once, whatever the number of items: what is kept of a document are its stretches of shingles that
may occur in items. That is asked of a Bloom filter of bounded size, the only thing sent to all tasks. A window needs
several such shingles in a row, so few stretches are kept in vain even where the filter is crowded, and none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.words import words
from lodestone.scratch import Scratch

#: Words of a shingle.
SHINGLE = 5
#: Bits of the filter for each shingle of the items, at most (16 MiB in all), and how many of them a shingle sets.
BITS_EACH, MOST_BITS, PROBES = 16, 1 << 27, 3
#: Words looked up at once.
CHUNK = 500_000


def shingle_keys(texts: list[list[str]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of the k words from each word of each text on, in one line, and where each text begins in it; places
    with fewer than k words left in their text have 0. Equal words give equal keys, different ones nearly always others."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.r_[0, np.cumsum(sizes)]
    n = int(starts[-1])
    out = np.zeros(n, np.uint64)
    if n < k:
        return out, starts
    coded = pa.array([w for t in texts for w in t], pa.string()).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    of_word = table[coded.indices.to_numpy()]
    key = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        key = (key ^ of_word[i : n - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    left = np.repeat(starts[1:], sizes) - np.arange(n)
    whole = left[: n - k + 1] >= k
    out[: n - k + 1] = np.where(whole, np.maximum(key, np.uint64(1)), np.uint64(0))
    return out, starts


def probes(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    """The places of the keys in a filter of so many bits, a power of two, in one of its probes."""
    return ((keys & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * ((keys >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)


WINDOW = "item_id bigint, place int, window array<string>, keys array<bigint>"
STRETCH = "doc_id bigint, words array<string>, keys array<bigint>"


def _windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """Each window of each item, with the keys of its shingles."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [words(t.as_py()) for t in batch.column(1)]
            keys, starts = shingle_keys(texts, k)
            rows = []
            for i, ws, at in zip(batch.column(0).to_pylist(), texts, starts[:-1].tolist(), strict=True):
                mine = keys[at : at + len(ws)].view(np.int64).tolist()
                rows += [(i, p, ws[p : p + window], mine[p : p + window - k + 1]) for p in range(len(ws) - window + 1)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            types = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["item_id", "place", "window", "keys"])

    rows = items.mapInArrow(read, WINDOW)
    # A window that an item holds twice is one.
    return rows.groupBy("item_id", "window").agg(F.min("place").alias("place"), F.first("keys").alias("keys")).select("item_id", "place", "window", "keys")


def _filter(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of all keys: 64 bits in each number. Numbers combine before they are shuffled and collected, so no
    more than ``bits / 64`` of them reach the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pc.list_flatten(batch.column(0)).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([probes(keys, bits, i) for i in range(PROBES)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bits"])

    rows = keys.mapInArrow(read, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _stretches(documents: DataFrame, sent, k: int, need: int) -> DataFrame:
    """The maximal stretches of at least ``need`` consecutive shingles of each document that may be in items."""

    def flush(ids: list[int], texts: list[list[str]], table: np.ndarray) -> pa.RecordBatch | None:
        keys, starts = shingle_keys(texts, k)
        hit = np.flatnonzero(keys)
        for probe in range(PROBES):  # after the first most are out
            at = probes(keys[hit], 64 * len(table), probe)
            hit = hit[(table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        may = np.zeros(len(keys), bool)
        may[hit] = True
        inside = np.r_[False, may, False]
        # A text's last k - 1 places have no shingle, so no stretch goes from one text to the next.
        first, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
        long = end - first >= need
        first, end = first[long], end[long]
        if not len(first):
            return None
        of = np.searchsorted(starts, first, side="right") - 1
        rows = [(ids[d], texts[d][a - starts[d] : b - starts[d] + k - 1], keys[a:b].view(np.int64)) for d, a, b in zip(of.tolist(), first.tolist(), end.tolist(), strict=True)]
        doc, ws, found = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ws, pa.list_(pa.string())), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "words", "keys"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: np.ndarray = sent.value
        ids: list[int] = []
        texts: list[list[str]] = []
        held = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = words(text.as_py())
                if len(ws) < k + need - 1:
                    continue
                ids.append(i)
                texts.append(ws)
                held += len(ws)
                if held > CHUNK:
                    if (out := flush(ids, texts, table)) is not None:
                        yield out
                    ids, texts, held = [], [], 0
        if ids and (out := flush(ids, texts, table)) is not None:
            yield out

    return documents.mapInArrow(read, STRETCH)


def leaked_passages(documents: DataFrame, items: DataFrame, *, window: int = 12, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, item_id, windows``: documents with at least ``window`` consecutive words of an item, and how many different
    passages of so many words the two share.

    ``documents``: ``doc_id bigint, text string``; ``items``: ``item_id bigint, text string``; other columns are
    ignored. Words are those of :mod:`lodestone.llm.words`. Null ids, null or empty texts and items shorter than the
    window match nothing; a repeated id counts as one text after another. Texts may be of any length, and any number
    of documents or items may share a passage. Empty tables give an empty result. ``most_bits``, a power of two of 64
    at least, bounds the filter; it changes the cost only.
    """
    if not 1 <= shingle <= window:
        raise ValueError("a shingle must have from 1 to window words")
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    need = window - shingle + 1
    wanted = scratch.write(_windows(items.where("item_id is not null and text is not null").select("item_id", "text"), window, shingle), "windows")
    bits = min(most_bits, 1 << max(16, (wanted.count() * BITS_EACH).bit_length()))
    sent = spark.sparkContext.broadcast(_filter(wanted.select("keys"), bits))
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    stretches = scratch.write(_stretches(texts, sent, shingle, need).withColumn("stretch", F.monotonically_increasing_id()), "stretches")

    # The rarest shingle of each window, and where it stands in it; windows with one that no document has are out.
    held = stretches.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    each = wanted.select("item_id", "place", F.posexplode("keys").alias("at", "key")).join(held, "key")
    rank = F.struct("n", "key", "at")
    prefix = each.groupBy("item_id", "place").agg(F.count(F.lit(1)).alias("found"), F.min(rank).alias("best")).where(f"found = {need}")
    prefix = scratch.write(prefix.select("item_id", "place", F.col("best.key").alias("key"), F.col("best.at").alias("at")), "prefix")

    # Keys alone are joined; words come to those places where a window can lie.
    places = stretches.select("stretch", F.posexplode("keys").alias("pos", "key"), F.size("keys").alias("size"))
    begins = places.join(prefix, "key").where(f"pos >= at and pos - at + {need} <= size").select("stretch", (F.col("pos") - F.col("at")).alias("begin"), "item_id", "place")
    passage = F.slice("words", F.col("begin") + 1, window).alias("passage")
    candidates = begins.join(stretches.select("stretch", "doc_id", "words"), "stretch").select("doc_id", "item_id", "place", passage)
    found = candidates.join(wanted.select("item_id", "place", "window"), ["item_id", "place"]).where("passage = window")
    return found.groupBy("doc_id", "item_id").agg(F.countDistinct("place").alias("windows"))
