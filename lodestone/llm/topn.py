"""The first N items of every group, by falling score and then rising tie key.

Method: sorted-run loser-tree merge. Every task writes its items as one run: a file ordered by bucket (a hash of the
group), group, falling score and tie key, in small row groups. A merge task takes the stretch of some buckets out of
several runs and merges them with a loser tree; after N outputs for a group it seeks to the next group in each run, past
whole row groups where these hold nothing else. So a group of any size is spread over all runs, costs a merge task N
outputs and one seek for each run, and never has to fit anywhere.

A task merges no more than FAN runs at once. Where there are more, chunks of FAN runs are merged into longer runs, each
of one stretch of buckets, level by level; a group keeps N items of each chunk at most. Any number of tasks may sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import Scratch

#: Bytes of a row group of a run: the unit of seeking, and what a merge task holds of each run.
ROW_GROUP_BYTES = 1 << 20
#: Runs that a merge task has open at once.
FAN = 64


COLUMNS = ["bucket", "group", "score", "tie"]


class LoserTree:
    """The least of several cursors again and again: each step replays one path from a leaf to the root.

    A cursor has ``key``, which is None once it is exhausted, and moves by itself; ``replay`` puts the tree right.
    """

    def __init__(self, cursors: list) -> None:
        self.cursors = cursors
        self.size = 1 << max(0, len(cursors) - 1).bit_length()
        self.losers = [-1] * self.size
        winners = [-1] * self.size + [i if i < len(cursors) else -1 for i in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if self.size > 1 else (0 if cursors else -1)

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or (ka := self.cursors[a].key) is None:
            return False
        return b < 0 or (kb := self.cursors[b].key) is None or ka < kb

    def replay(self) -> None:
        """After the winner's cursor moved."""
        at, node = self.winner, (self.winner + self.size) // 2
        while node:
            if self._before(other := self.losers[node], at):
                self.losers[node], at = at, other
            node //= 2
        self.winner = at


class Run:
    """An open run file, with the least and greatest bucket of each row group and the group where it is a single one."""

    def __init__(self, source) -> None:
        self.file = pq.ParquetFile(source)
        meta = self.file.metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        bucket, group = names.index("bucket"), names.index("group")
        n = meta.num_row_groups
        self.low, self.high, self.only = np.zeros(n, np.int64), np.full(n, 1 << 62), [None] * n
        known = [meta.row_group(i).column(bucket).statistics for i in range(n)]
        if not all(b is not None and b.has_min_max for b in known):
            return  # without them every row group may hold every bucket
        for i, b in enumerate(known):
            s = meta.row_group(i).column(group).statistics
            self.low[i], self.high[i] = b.min, b.max
            if s is not None and s.has_min_max and s.min == s.max and b.min == b.max:
                self.only[i] = s.min

    def stretch(self, bucket: int) -> range:
        """The row groups that can hold the bucket; they are in order."""
        return range(int(np.searchsorted(self.high, bucket)), int(np.searchsorted(self.low, bucket, side="right")))


class RunCursor:
    """The items of one bucket in one run, of each group at most the first N different ones.

    ``key`` is (group, -score, tie); ``next_item`` moves by one, ``next_group`` past all of the present group.
    """

    def __init__(self, run: Run, bucket: int, n: int) -> None:
        self.run, self.bucket, self.n = run, bucket, n
        self.groups = iter(run.stretch(bucket))
        self.last, self.seen, self.previous = None, 0, None
        self.keys: list[tuple] = []
        self.heads: list[int] = []
        self.at = self.head = 0
        self.key = None
        self._fill()

    def _fill(self) -> None:
        """Reads on until there is an item or the run ends."""
        self.keys, self.heads, self.at, self.head = [], [], 0, 0
        for i in self.groups:
            if self.seen >= self.n and self.last is not None and self.run.only[i] == self.last:
                continue  # nothing but what comes after the first N of that group
            t = self.run.file.read_row_group(i, columns=COLUMNS)
            b = t.column("bucket").to_numpy()
            lo, hi = np.searchsorted(b, [self.bucket, self.bucket + 1])
            if lo == hi:
                continue
            t = t.slice(lo, hi - lo).combine_chunks()
            group = t.column("group").combine_chunks().dictionary_encode()
            codes, score, tie = group.indices.to_numpy(), t.column("score").to_numpy(), t.column("tie").to_numpy()
            names = group.dictionary.to_pylist()
            new = np.r_[True, (codes[1:] != codes[:-1]) | (score[1:] != score[:-1]) | (tie[1:] != tie[:-1])]
            new[0] = (names[codes[0]], score[0], tie[0]) != self.previous
            self.previous = (names[codes[-1]], score[-1], tie[-1])
            if not new.any():
                continue
            codes, score, tie = codes[new], score[new], tie[new]
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            rank = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
            if names[codes[0]] == self.last:  # the group goes on from the row group before
                first = starts[1] if len(starts) > 1 else len(codes)
                rank[:first] += self.seen
            self.last, self.seen = names[codes[-1]], int(rank[-1]) + 1
            keep = np.flatnonzero(rank < self.n)
            if not keep.size:
                continue
            codes = codes[keep]
            self.keys = list(zip([names[c] for c in codes.tolist()], (-score[keep]).tolist(), tie[keep].tolist(), strict=True))
            self.heads = [*(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(self.keys)]
            break
        self.key = self.keys[0] if self.keys else None

    def next_item(self) -> None:
        self.at += 1
        if self.at < len(self.keys):
            self.key = self.keys[self.at]
            if self.at == self.heads[self.head]:
                self.head += 1
        else:
            self._fill()

    def next_group(self) -> None:
        group = self.key[0]
        while self.key is not None and self.key[0] == group:
            self.at = self.heads[self.head]
            if self.at < len(self.keys):
                self.head += 1
                self.key = self.keys[self.at]
            else:
                self._fill()


def merge_runs(cursors: list[RunCursor], n: int) -> Iterator[tuple]:
    """(group, -score, tie) of the first n of every group, in order."""
    tree = LoserTree(cursors)
    group, given, last = None, 0, None
    while tree.winner >= 0 and (key := cursors[tree.winner].key) is not None:
        if key[0] != group:
            group, given = key[0], 0
        if given < n:
            if key != last:
                yield key
                given += 1
                last = key
            cursors[tree.winner].next_item()
        else:
            cursors[tree.winner].next_group()
        tree.replay()


def _open(uri: str):
    """A run file for random reading, in any file system that pyarrow knows by its scheme."""
    uri = uri.replace("s3a://", "s3://", 1)
    if uri.startswith("file:"):
        return pa.memory_map(uri.removeprefix("file:").replace("///", "/", 1), "r")
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _merged(bucket: int, runs: list[Run], n: int) -> Iterator[pa.RecordBatch]:
    """The first n of every group of a bucket, merged from its runs."""
    cursors = [c for r in runs if (c := RunCursor(r, bucket, n)).key is not None]
    out = []
    for key in merge_runs(cursors, n):
        out.append(key)
        if len(out) == 1 << 16:
            yield _batch(bucket, out)
            out = []
    if out:
        yield _batch(bucket, out)


def _batch(bucket: int, keys: list[tuple]) -> pa.RecordBatch:
    group, score, tie = zip(*keys, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), bucket, np.int32)), pa.array(group, pa.string()), pa.array([0.0 - s for s in score], pa.float64()), pa.array(tie, pa.int64())], COLUMNS
    )


def _merge(spark, tasks: list[tuple[list[str], int, int]], n: int) -> DataFrame:
    """A partition for each task (run files, first bucket, end of its buckets), in order."""
    sent = spark.sparkContext.broadcast(tasks)  # a path for each run and chunk

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                files, begin, end = sent.value[i]
                runs = [Run(_open(f)) for f in files]
                for bucket in range(begin, end):
                    yield from _merged(bucket, runs, n)

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(merge, "bucket int, group string, score double, tie bigint")


def top_n(items: DataFrame, n: int, *, buckets: int | None = None) -> DataFrame:
    """``group string, score double, tie bigint``: of each group the n first by falling score, then rising tie.

    ``items`` has these three columns; any others are ignored. Rows with a null group, a null or NaN score or a null
    tie are no items. Rows alike in all three count once. Fewer than n items give what there is; an empty table gives an empty one.
    Infinite scores order as numbers do. The group's text is compared as it stands, blanks and case included.
    """
    if n < 1:
        raise ValueError("n must be positive")
    spark = items.sparkSession
    scratch = Scratch(spark, "topn")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = items.select(
        F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int").alias("bucket"),
        F.col("group").cast("string").alias("group"),
        (F.col("score").cast("double") + 0.0).alias("score"),  # -0.0 becomes 0.0
        F.col("tie").cast("bigint").alias("tie"),
    ).where("group is not null and score is not null and not isnan(score) and tie is not null")
    small = {"parquet.block.size": str(ROW_GROUP_BYTES)}
    scratch.write(runs.sortWithinPartitions("bucket", "group", F.desc("score"), "tie"), "runs0", **small)
    # For each stretch of buckets its runs; at first one stretch of all.
    stretches, level = [(0, buckets, scratch.files("runs0"))], 0
    while any(len(files) > FAN for *_, files in stretches):
        # As many tasks as hold about one run each.
        tasks = []
        for begin, end, files in stretches:
            cuts = np.linspace(begin, end, min(end - begin, max(1, min(len(files), FAN))) + 1).astype(int).tolist()
            tasks += [(files[i : i + FAN], a, b) for a, b in zip(cuts, cuts[1:], strict=False) for i in range(0, len(files), FAN)]
        level += 1
        scratch.write(_merge(spark, tasks, n), f"runs{level}", **small)
        made: dict[tuple[int, int], list[str]] = {}
        for f in scratch.files(f"runs{level}"):
            _, begin, end = tasks[int(f.rsplit("/", 1)[1].split("-")[1])]  # part-<number of the task>-...
            made.setdefault((begin, end), []).append(f)
        stretches = [(a, b, files) for (a, b), files in sorted(made.items())]
        scratch.drop(f"runs{level - 1}")
    tasks = [(files, b, b + 1) for begin, end, files in stretches for b in range(begin, end)]
    return _merge(spark, tasks, n).select("group", "score", "tie")
