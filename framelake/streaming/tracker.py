"""The planning step of a tracker as one keyed stream: frame by frame, what detections and objects of a session become.

A session keeps its objects, the counters of pairs that shared detections, and its largest number, each as keyed state that grows with the living objects alone:
what belongs to a removed object goes with it. Each frame is associated, new detections pass the border and the budget and are numbered, lost and doubled
objects are removed while young and suppressed later, confident detections recondition their objects, and of overlapping objects the one occluded last is hidden.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .state import keyed_frames

Box = tuple[float, float, float, float]

_OBJECT = "born long, lost long, alive long, run long, confirmed boolean, occluded long, x0 double, y0 double, x1 double, y1 double"
OUT = "session long, frame long, kind string, object long, det long, value double"
#: Later than any frame: an object that is removed before it was ever looked at.
_ALWAYS = 1 << 40
#: Events that are given back at once.
_EVENTS = 50_000
_DET, _SEEN = ("det", "score", "x0", "y0", "x1", "y1"), ("object", "x0", "y0", "x1", "y1")


@dataclass(frozen=True)
class Rules:
    """What the planning goes by. Ages are numbers of frames since an object's first one, in the direction of the run."""

    near: float = 0.1  # overlap from which a detection belongs to an object
    strict: float = 0.5  # overlap below which an object counts as lost
    new_score: float = 0.7
    sure_score: float = 0.8
    sure_iou: float = 0.8
    margin: float = -1.0  # a detection whose centre lies this near to the border of a unit image makes no object; below 0: none is too near
    budget: int = 10_000
    delay: int = 15  # age from which nothing is removed
    misses: int = 8
    repeats: int = 8
    start: int = 30  # keep-alive counter: first value and bounds
    most: int = 30
    least: int = -1
    suppress_later: bool = True  # hide objects whose counter is used up
    recondition_every: int = 16  # 0: never
    hide_overlap: float = 0.7  # 0: never
    needed: int = 3  # matches in a row that confirm an object
    reverse: bool = False


@dataclass
class Tracked:
    born: int
    lost: int
    alive: int
    run: int
    confirmed: bool
    occluded: int | None  # last frame without a mask or hidden; -1: never; None: not looked at yet
    x0: float
    y0: float
    x1: float
    y1: float

    @property
    def box(self) -> Box:
        return self.x0, self.y0, self.x1, self.y1

    def move(self, box: Box) -> None:
        self.x0, self.y0, self.x1, self.y1 = box


def _area(b: Box) -> float:
    return max(b[2] - b[0], 0.0) * max(b[3] - b[1], 0.0)


def iou(a: Box, b: Box) -> float:
    if a[0] >= b[2] or b[0] >= a[2] or a[1] >= b[3] or b[1] >= a[3]:
        return 0.0
    both = _area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3])))
    return both / (_area(a) + _area(b) - both) if both > 0 else 0.0


def plan_frame(rules: Rules, frame: int, detections: list[tuple[int, float, Box]], predicted: dict[int, Box], objects: dict[int, Tracked], pairs: dict[tuple[int, int], int], largest: int) -> tuple[list[tuple], int]:
    """Events (kind, object, det, value) of a frame, and the largest number then; objects and pairs are brought up to date in place.

    detections: (det, score, box), by det; predicted: where the tracker sees known objects; others stay where they were. Kinds: `matched` (value: overlap),
    `candidate` and `new` (score), `lost`, `empty`, `removed_lost`, `removed_double`, `suppressed`, `hidden`, `reconditioned` (overlap), `object` (keep-alive
    counter) and `confirmed` of each object that lives after the frame.
    """
    for name, box in predicted.items():
        if name in objects:
            objects[name].move(box)
    names = sorted(objects)
    boxes = {o: objects[o].box for o in names}
    overlap = {(d, o): iou(box, own) for d, _, box in detections for o, own in boxes.items()}
    events: list[tuple] = []
    empty = [o for o, own in boxes.items() if own[2] <= own[0] or own[3] <= own[1]]
    seen = {o for (_, o), v in overlap.items() if v >= rules.strict}
    lost = [o for o in names if o not in seen and o not in empty]
    of_det: dict[int, list[int]] = {d: [] for d, _, _ in detections}
    for (d, o), v in overlap.items():
        if v >= rules.near:
            of_det[d].append(o)
            events.append(("matched", o, d, v))
    matched = {e[1] for e in events}

    fresh = [x for x in detections if x[1] >= rules.new_score and not of_det[x[0]]]
    added = {}
    if fresh:
        events += [("candidate", None, d, score) for d, score, _ in fresh]
        low, high = rules.margin, 1 - rules.margin
        inside = [x for x in fresh if low < (x[2][0] + x[2][2]) / 2 < high and low < (x[2][1] + x[2][3]) / 2 < high]
        room = max(rules.budget - len(names), 0)
        if len(inside) > room:
            inside = sorted(inside, key=lambda x: (-x[1], x[0]))[:room]
        added = {largest + 1 + k: x for k, x in enumerate(sorted(inside))}
        events += [("new", o, d, score) for o, (d, score, _) in added.items()]

    for o in matched:
        objects[o].alive = min(rules.most, objects[o].alive + 1)
    for o in lost:
        t = objects[o]
        t.alive, t.lost = max(rules.least, t.alive - 1), t.lost + 1
        events.append(("lost", o, None, None))
    events += [("empty", o, None, None) for o in empty]
    age = lambda o: (objects[o].born - frame if rules.reverse else frame - objects[o].born)
    removed = {o for o in names if objects[o].lost >= rules.misses and age(o) < rules.delay}
    events += [("removed_lost", o, None, None) for o in sorted(removed)]
    if rules.suppress_later:
        events += [("suppressed", o, None, None) for o in names if objects[o].lost and objects[o].alive <= 0 and o not in removed]
    for own in of_det.values():
        if len(own) > 1:
            first = max(own, key=lambda o: (age(o), -o))
            for o in own:
                if o != first:
                    pairs[first, o] = pairs.get((first, o), 0) + 1
    if pairs:
        doubled = {o for (_, o), times in pairs.items() if o not in removed and times >= rules.repeats and age(o) < rules.delay}
        events += [("removed_double", o, None, None) for o in sorted(doubled)]
        removed |= doubled

    if rules.recondition_every and frame % rules.recondition_every == 0:
        sure = {}
        for d, score, box in detections:
            if score >= rules.sure_score and of_det[d]:
                best = max(of_det[d], key=lambda o: (overlap[d, o], -o))
                if overlap[d, best] >= rules.sure_iou:
                    sure[best] = d, box  # the last detection of an object counts
        for o, (d, box) in sorted(sure.items()):
            events.append(("reconditioned", o, d, overlap[d, o]))
            objects[o].move(box)

    if rules.hide_overlap:
        last = {o: (_ALWAYS if o in removed else -1) if objects[o].occluded is None else objects[o].occluded for o in names}
        ever = any(v > -1 for v in last.values())
        later = lambda a, b: (last[a] < last[b] if rules.reverse else last[a] > last[b]) and last[b] > -1
        hidden = {a for a in names for b in names if ever and a != b and later(a, b) and iou(objects[a].box, objects[b].box) >= rules.hide_overlap}
        events += [("hidden", o, None, None) for o in sorted(hidden)]
        for o in names:
            objects[o].occluded = frame if o in hidden or o in empty else last[o]

    for o in removed:
        del objects[o]
    if removed:
        for key in [k for k in pairs if removed & {*k}]:
            del pairs[key]
    for o, (_, _, box) in added.items():
        objects[o] = Tracked(frame, 0, rules.start, 0, False, None, *box)
    for o in sorted(objects):
        t = objects[o]
        t.run = t.run + 1 if o in matched or o in added else 0
        t.confirmed = t.confirmed or t.run >= rules.needed
        events.append(("object", o, None, float(t.alive)))
        if t.confirmed:
            events.append(("confirmed", o, None, None))
    return events, max([largest, *added])


def _packed(frames: DataFrame) -> DataFrame:
    """Frames as arrays of numbers: frame, and for detections and tracks how many each has, their numbers, and all their values in turn. A table's frames come as one row a
    session, so that what goes between Spark and Python does not cost by the frame."""
    def side(name, number, *values):
        members = F.coalesce(F.col(name), F.array().cast(frames.schema[name].dataType))
        return [F.transform(members, lambda x: x[number]).alias(f"{name}_id"), F.flatten(F.transform(members, lambda x: F.array(*[x[v] for v in values]))).alias(f"{name}_values")]

    own = frames.select("session", "frame", *side("detections", *_DET), *side("tracks", *_SEEN))
    each = F.struct(*[c for c in own.columns if c != "session"])
    rows = own.select("session", F.array(each).alias("f")) if frames.isStreaming else own.groupBy("session").agg(F.collect_list(each).alias("f"))
    of = lambda name: [F.transform(f"f.{name}_id", lambda x: F.size(x)).alias(f"{name}_n"), F.flatten(f"f.{name}_id").alias(f"{name}_id"), F.flatten(f"f.{name}_values").alias(f"{name}_values")]
    return rows.select("session", F.col("f.frame").alias("frame"), *of("detections"), *of("tracks"))


def _unpacked(row: Any) -> Iterator[tuple]:
    """frame, [(det, score, box)] and [(object, box)] of each frame of a row of _packed()."""
    of = lambda name: (getattr(row, f"{name}_{c}").tolist() for c in ("n", "id", "values"))
    (n_det, det, v), (n_seen, seen, w) = of("detections"), of("tracks")
    found = [(d, v[k], (v[k + 1], v[k + 2], v[k + 3], v[k + 4])) for d, k in zip(det, range(0, len(v), 5), strict=True)]
    known = [(o, (w[k], w[k + 1], w[k + 2], w[k + 3])) for o, k in zip(seen, range(0, len(w), 4), strict=True)]
    i = j = 0
    for frame, n, m in zip(row.frame.tolist(), n_det, n_seen, strict=True):
        yield frame, found[i : i + n], known[j : j + m]
        i, j = i + n, j + m


def _frame_of(session: Any, events: list[tuple]) -> pd.DataFrame:
    frame, kind, o, d, value = zip(*events, strict=True)
    whole = lambda v: pd.arrays.IntegerArray(np.array([0 if x is None else x for x in v], np.int64), np.array([x is None for x in v]))
    return pd.DataFrame({"session": [session] * len(events), "frame": frame, "kind": kind, "object": whole(o), "det": whole(d), "value": np.array(value, np.float64)})


class _Planner(StatefulProcessor):
    def __init__(self, rules: Rules) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.objects = handle.getMapState("objects", "object long", _OBJECT)
        self.pairs = handle.getMapState("pairs", "first long, double long", "times long")
        self.counters = handle.getValueState("counters", "largest long, frame long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        objects = {k[0]: Tracked(*v) for k, v in self.objects.iterator()}
        pairs = {tuple(k): v[0] for k, v in self.pairs.iterator()}
        largest, last = self.counters.get() if self.counters.exists() else (-1, None)
        known, known_pairs = {o: Tracked(**vars(t)) for o, t in objects.items()}, dict(pairs)
        given = [r for part in rows for row in part.itertuples(index=False) for r in _unpacked(row)]
        given.sort(key=lambda r: -r[0] if self.rules.reverse else r[0])
        events: list[tuple] = []
        for frame, found, seen in given:
            if last is not None and (frame >= last if self.rules.reverse else frame <= last):
                events.append((frame, "late", None, None, None))
                continue
            own, largest = plan_frame(self.rules, frame, sorted(found), dict(seen), objects, pairs, largest)
            last = frame
            events += [(frame, *e) for e in own]
            if len(events) >= _EVENTS:
                yield _frame_of(key[0], events)
                events = []
        if events:
            yield _frame_of(key[0], events)
        for o in known.keys() - objects.keys():
            self.objects.removeKey((o,))
        for o, t in objects.items():
            if known.get(o) != t:
                self.objects.updateValue((o,), tuple(vars(t).values()))
        for p in known_pairs.keys() - pairs.keys():
            self.pairs.removeKey(p)
        for p, times in pairs.items():
            if known_pairs.get(p) != times:
                self.pairs.updateValue(p, (times,))
        self.counters.update((largest, last))

    def close(self) -> None:
        pass


def plan_sessions(frames: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """session, frame, kind, object, det and value of what happens in each frame of frames(session, frame, detections, tracks), a stream or a table.

    detections: array<struct<det: long, score: double, x0, y0, x1, y1: double>> in a unit image; tracks: array<struct<object: long, x0, y0, x1, y1: double>>, where the
    tracker sees objects by their numbers here; a box without area is an empty mask, and objects without a row stay where they were. Null arrays are empty. The
    frames of one micro-batch are put in order; a frame that does not lie behind the last one of its session gives one row of kind `late` and changes nothing.
    """
    return keyed_frames(_packed(frames), ["session"], _Planner(rules), OUT)
