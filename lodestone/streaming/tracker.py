"""Objects followed over the frames of a session, with smoothed class scores and confirmation.

A session's objects are a small table (:class:`Objects`), a row for each. A frame is joined with it by one matrix of
overlaps, its boxes by the objects still alive: what is ambiguous is read off the matrix's rows and columns. The same
step runs over a stream (the table kept as state by session) and over a table of frames (sorted by session and time, so
that a task holds the objects of one session and no more than one batch of frames).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How long an object lives unseen (ms), overlaps for continuity and association, the lead that makes an
#: association clear, the share of new scores in smoothed ones, and confirmations that make an object recognised.
LIFETIME, OVERLAP, LEAD, FRESH, CONFIRMATIONS = 1000.0, 0.4, 0.15, 0.65, 2
#: Milliseconds without frames after which a stream forgets a session.
IDLE = 600_000

FRAMES = "session string, frame bigint, ts double, detections array<struct<box:struct<x:double,y:double,w:double,h:double>,score:double,scores:array<double>>>"
TRACKED = (
    "session string, frame bigint, ts double, track_id int, x double, y double, w double, h double, detector_confidence double,"
    " class_id int, confidence double, status string, overflow boolean"
)


@dataclass(frozen=True)
class TrackerOptions:
    max_objects: int = 5
    classifier: float = 0.65
    margin: float = 0.1
    lifetime: float = LIFETIME


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The intersection over union of each box of ``a`` (rows x, y, w, h) with each of ``b``; 0 where the union is none."""
    low = np.maximum(a[:, None, :2], b[None, :, :2])
    high = np.minimum(a[:, None, :2] + a[:, None, 2:], b[None, :, :2] + b[None, :, 2:])
    shared = np.clip(high - low, 0.0, None).prod(axis=2)
    union = a[:, 2:].prod(axis=1)[:, None] + b[:, 2:].prod(axis=1)[None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def assign(share: np.ndarray) -> np.ndarray:
    """For each box (row of overlaps with the objects), in order of rank, the object it continues, or -1.

    A box continues the free object it overlaps most, by at least OVERLAP, unless that is unclear: the next free object
    overlaps it nearly as well, or another box overlaps that object nearly as well. Nearly is by less than LEAD for
    objects, by no more for boxes.
    """
    boxes, objects = share.shape
    out = np.full(boxes, -1)
    if not boxes or not objects or share.max() < OVERLAP:
        return out
    # What the best of the other boxes has of each object: the column's greatest, or its second for that box itself.
    top = np.sort(np.vstack([np.full((2, objects), -np.inf), share]), axis=0)
    others = np.where((share == top[-1]) & (np.argmax(share, axis=0) == np.arange(boxes)[:, None]), top[-2], top[-1])
    contested = others >= share - LEAD
    fits = np.where(share >= OVERLAP, share, -np.inf)
    for i in range(boxes):
        j = int(np.argmax(fits[i]))
        best = fits[i, j]
        if best == -np.inf or contested[i, j]:
            continue
        if best - np.delete(fits[i], j).max(initial=-np.inf) < LEAD:
            continue
        out[i] = j
        fits[:, j] = -np.inf  # taken
    return out


@dataclass
class Objects:
    """The objects of one session by columns, and the last frame's time and number."""

    ids: list[int] = field(default_factory=list)
    seen: list[float] = field(default_factory=list)
    boxes: list[list[float]] = field(default_factory=list)
    scores: list[list[float] | None] = field(default_factory=list)
    accepted: list[int | None] = field(default_factory=list)
    streak: list[int] = field(default_factory=list)
    given: int = 0
    last: list[float] | None = None

    def take(self, frame: int, ts: float, found: list[tuple], o: TrackerOptions) -> list[dict]:
        """The rows of a frame with detections ``found`` (box, score, class scores).

        A frame of an earlier time than the last changes nothing; each of its detections gives a row of status late,
        and one row without a box if it has none. The last frame again (same number and time) gives nothing.
        """
        if self.last is not None and (ts, frame) == tuple(self.last):
            return []
        if self.last is not None and ts < self.last[0]:
            return [_row(d, status="late") for d in found] or [_row(None, status="late")]
        self.last = [ts, frame]
        if not found:  # objects that aren't seen again are gone
            self.__dict__.update(Objects(given=self.given, last=self.last).__dict__)
            return []
        alive = [k for k, t in enumerate(self.seen) if ts - t <= o.lifetime]
        share = np.zeros((len(found), 0))
        if alive:
            share = overlaps(np.array([d[0] for d in found], float), np.array([self.boxes[k] for k in alive], float))
        new = share.max(axis=1, initial=0.0) <= OVERLAP
        order = np.lexsort((-np.array([d[1] for d in found], float), new))[: o.max_objects]
        of = assign(share[order])
        now, rows = Objects(given=self.given, last=self.last), []
        for i, k in zip(order.tolist(), of.tolist(), strict=True):
            box, _, scores = found[i]
            past = None if k < 0 else alive[k]
            if past is None:
                now.given += 1
            state = now._judge(scores, None if past is None else (self.scores[past], self.accepted[past], self.streak[past]), o)
            now.ids.append(now.given if past is None else self.ids[past])
            now.seen.append(ts)
            now.boxes.append(box)
            rows.append(_row(found[i], track_id=now.ids[-1], overflow=len(found) > o.max_objects, **state))
        self.__dict__.update(now.__dict__)
        return rows

    def _judge(self, fresh: list[float] | None, past: tuple | None, o: TrackerOptions) -> dict:
        """Smooths the scores of one object, counts its confirmations, and tells what is shown of it."""
        smooth, before, streak = past or (None, None, 0)
        lead = None
        if fresh:
            smooth = list(fresh) if smooth is None else [FRESH * a + (1 - FRESH) * b for a, b in zip(fresh, smooth, strict=True)]
            second, first = sorted(smooth)[-2:] if len(smooth) > 1 else (0.0, smooth[0])
            if first >= o.classifier and first - second >= o.margin:
                lead = smooth.index(first)
        streak = 0 if lead is None else streak + 1 if lead == before else 1
        self.scores.append(smooth)
        self.accepted.append(lead)
        self.streak.append(streak)
        if streak >= CONFIRMATIONS:
            return {"class_id": lead, "confidence": smooth[lead], "status": "recognized"}
        return {"status": "uncertain" if lead is None else "analyzing"}

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def load(cls, text: str) -> Objects:
        return cls(**json.loads(text))


def _row(detection: tuple | None, **values) -> dict:
    box, score = (detection[0], detection[1]) if detection else ([None] * 4, None)
    return {"track_id": None, **dict(zip("xywh", box, strict=True)), "detector_confidence": score, "class_id": None, "confidence": None, "overflow": False} | values


def _detections(items) -> list[tuple]:
    out = []
    for d in items if items is not None else ():
        if d is None or d["box"] is None or d["score"] is None:
            continue
        b, scores = d["box"], d["scores"]
        out.append(([b["x"], b["y"], b["w"], b["h"]], d["score"], list(scores) if scores is not None and len(scores) else None))
    return out


_NAMES = [x.split()[0] for x in TRACKED.split(", ")]
_ARROW = [pa.string(), pa.int64(), pa.float64(), pa.int32(), *[pa.float64()] * 5, pa.int32(), pa.float64(), pa.string(), pa.bool_()]


def track_table(frames: DataFrame, options: TrackerOptions = TrackerOptions()) -> DataFrame:
    """The tracked objects of all frames of a table (columns of FRAMES).

    Rows with a null session, frame or time are left out; rows alike in all three are one frame. Frames without
    detections give no row but let objects age. A session's frames are read in order of time, those of one time by
    number, one after another, whatever their number; so none is late.
    """

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, objects = None, Objects()
        schema = pa.schema([(n, t) for n, t in zip(_NAMES, _ARROW, strict=True)])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["session"] != session:
                    session, objects = r["session"], Objects()
                for x in objects.take(r["frame"], r["ts"], _detections(r["detections"]), options):
                    rows.append({"session": session, "frame": r["frame"], "ts": r["ts"]} | x)
            yield pa.RecordBatch.from_pylist(rows, schema)

    rows = frames.where("session is not null and frame is not null and ts is not null").select("session", "frame", "ts", "detections")
    return rows.repartition("session").sortWithinPartitions("session", "ts", "frame").mapInArrow(follow, TRACKED)


def track_stream(frames: DataFrame, options: TrackerOptions = TrackerOptions(), *, idle: int = IDLE) -> DataFrame:
    """The tracked objects of a stream with the columns of FRAMES.

    State is kept for each session and forgotten after ``idle`` milliseconds without frames; a session that comes back
    begins anew. Within a micro-batch frames are put in order of time; there is no reordering across batches, so a frame
    older than the last of its session comes out with status late, as :meth:`Objects.take` says.
    """

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        objects = Objects.load(state.get[0]) if state.exists else Objects()
        rows = pd.concat(parts, ignore_index=True).dropna(subset=["frame", "ts"]).sort_values(["ts", "frame"], kind="stable")
        out = []
        for frame, ts, detections in zip(rows["frame"].tolist(), rows["ts"].tolist(), rows["detections"], strict=True):
            for x in objects.take(int(frame), ts, _detections(detections), options):
                out.append({"session": key[0], "frame": frame, "ts": ts} | x)
        state.update((objects.dump(),))
        state.setTimeoutDuration(idle)
        table = pd.DataFrame(out, columns=_NAMES)
        for c in ("class_id", "track_id"):
            table[c] = table[c].astype("Int32")
        yield table

    rows = frames.where("session is not null").select("session", "frame", "ts", "detections")
    return rows.groupBy("session").applyInPandasWithState(follow, TRACKED, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_of(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the newest row, as a busy consumer takes it, with ``skipped``, the older ones."""
    rest = [c for c in frames.columns if c not in keys]
    g = frames.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), (F.count(F.lit(1)) - 1).alias("skipped"))
    return g.select(*keys, "r.*", "skipped")


def write_latest(frames: DataFrame, keys: list[str], order: list[str], sink):
    """Starts a stream that hands ``sink`` (a function of a table and its number) the newest row of each key and batch."""
    return frames.writeStream.foreachBatch(lambda df, n: sink(latest_of(df, keys, order), n))


@dataclass(frozen=True)
class Token:
    """The right to work on one frame, as long as its generation lasts."""

    generation: int
    number: int


class InFlight:
    """Back-pressure: no more than one frame is in work. Whoever holds the token works; :meth:`renew` begins a new
    generation, after which tokens of older ones release nothing."""

    def __init__(self) -> None:
        self._newest = Token(0, 0)
        self._held: Token | None = None

    def acquire(self) -> Token | None:
        """A token for the next frame, None while another is held. Numbers go on over generations."""
        if self._held is None:
            self._newest = self._held = Token(self._newest.generation, self._newest.number + 1)
            return self._held
        return None

    def release(self, token: Token) -> bool:
        """Whether the token was the one held; then the next frame may come."""
        mine = self._held == token
        self._held = None if mine else self._held
        return mine

    def renew(self) -> int:
        self._newest, self._held = Token(self._newest.generation + 1, self._newest.number), None
        return self._newest.generation

    def fresh(self, token: Token) -> bool:
        """Whether the token is of the present generation, so that its result may be shown."""
        return token.generation == self._newest.generation
