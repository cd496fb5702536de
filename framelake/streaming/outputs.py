"""Outputs that are held back for some frames, as a stream: by then it is known which of their objects are removed, and which become confirmed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .state import keyed


class _HeldBack(StatefulProcessor):
    """State: the frames not yet released, in order of arrival; the removed objects; and the unconfirmed ones of the frames that are still looked ahead to."""

    def __init__(self, delay: int, look: int, reverse: bool, kind: str) -> None:
        self.delay, self.look, self.reverse, self.kind = delay, -look if reverse else look, reverse, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getListState("frames", f"frame long, n_frames long, objects array<{self.kind}>, suppressed array<{self.kind}>")
        self.removed = handle.getMapState("removed", f"object {self.kind}", "frame long")
        self.unconfirmed = handle.getMapState("unconfirmed", "frame long", f"objects array<{self.kind}>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = list(self.frames.get()) if self.frames.exists() else []
        removed = {k[0] for k, _ in self.removed.iterator()}
        unconfirmed = {k[0]: v[0] for k, v in self.unconfirmed.iterator()}
        known, waiting = set(removed), set(unconfirmed)
        for r in sorted(rows, key=lambda r: -r["frame"] if self.reverse else r["frame"]):
            held.append((r["frame"], r["n_frames"], r["objects"] or [], r["suppressed"] or []))
            removed |= set(r["removed"] or [])
            if r["unconfirmed"] is not None:
                unconfirmed[r["frame"]] = r["unconfirmed"]
            n = len(held) if r["last"] else max(0, len(held) - self.delay + 1) if self.delay > 0 else len(held)
            for frame, n_frames, objects, suppressed in held[:n]:
                ahead = unconfirmed.get(max(0, min(frame + self.look, n_frames - 1)), [])
                out = {*removed, *suppressed, *ahead}
                yield Row(session=key[0], frame=frame, released_at=r["frame"], objects=[o for o in objects if o not in out])
            held = held[n:]
            first = held[0][0] if held else r["frame"] + (-1 if self.reverse else 1)
            # The oldest frame that can still be asked for is the oldest one held, or the last of the video.
            unconfirmed = {f: u for f, u in unconfirmed.items() if (f <= first if self.reverse else f >= first) or f in (0, r["n_frames"] - 1)}
            if r["last"]:
                removed, unconfirmed = set(), {}
        self.frames.clear()
        if held:
            self.frames.put([tuple(h) for h in held])
        for o in known - removed:
            self.removed.removeKey((o,))
        for o in removed - known:
            self.removed.updateValue((o,), (0,))
        for f in waiting - unconfirmed.keys():
            self.unconfirmed.removeKey((f,))
        for f in unconfirmed.keys() - waiting:
            self.unconfirmed.updateValue((f,), (unconfirmed[f],))

    def close(self) -> None:
        pass


def hold_back(outputs: DataFrame, delay: int, look: int, reverse: bool = False) -> DataFrame:
    """session, frame, released_at and objects of outputs(session, frame, n_frames, last, objects, removed, suppressed, unconfirmed), a stream or a table.

    A frame leaves when it and the frames held behind it are `delay` many (at once for 0), and all that are left leave with the one that is the `last`. It leaves
    without the objects removed until then, those suppressed in it, and those unconfirmed `look` frames further on, or in the video's last frame, as far as that
    frame has arrived. The frames of a session arrive in order; within a micro-batch they are put in order. After its last frame a session begins anew.
    """
    schema = outputs.schema
    kind = schema["objects"].dataType.elementType.simpleString()
    return keyed(outputs, ["session"], _HeldBack(delay, look, reverse, kind), f"session {schema['session'].dataType.simpleString()}, frame long, released_at long, objects array<{kind}>")


class _Actions(StatefulProcessor):
    """State: the log of a session, as far back as the next propagation can depend on it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "type string, frame long, objects array<long>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        log = [tuple(x) for x in self.log.get()] if self.log.exists() else []
        n = len(log)
        for r in sorted(rows, key=lambda r: r["seq"]):
            if r["type"] == "ask":
                kind, objects = next_of_log(log, r["n_frames"])
                yield Row(session=key[0], seq=r["seq"], propagation=kind, objects=objects)
            else:
                if r["type"].startswith("propagation") and len(log) > 1:
                    log, n = log[-1:], -1  # what lies before the action before a propagation is never asked for again
                log.append((r["type"], r["frame"], r["objects"]))
        if n < 0:
            self.log.put(log)
        elif log[n:]:
            self.log.appendList(log[n:])

    def close(self) -> None:
        pass


_RUNS = ("propagation_full", "propagation_partial")


def next_of_log(log: list[tuple], n_frames: int) -> tuple[str, list[int] | None]:
    """What a session's next propagation is to do, from its log of (type, frame, objects)."""
    if not log:
        return "propagation_full", None
    kind, frame, objects = log[-1]
    if kind in _RUNS and frame not in (0, n_frames - 1) and not (len(log) > 1 and log[-2][0] in _RUNS):
        return kind, objects  # the other direction is still to be run
    since: set[int] = set()
    for kind, _, objects in reversed(log):
        if kind.startswith("propagation"):
            break
        if kind in ("add", "refine"):
            since |= set(objects or [])
    return ("propagation_partial", sorted(since)) if since else ("propagation_fetch", None)


def answer_asks(commands: DataFrame) -> DataFrame:
    """session, seq, propagation and objects for each row of type `ask` in commands(session, seq, type, frame, objects, n_frames), a stream or a table; other rows are
    actions that are logged, in order of seq. Null objects are none."""
    return keyed(commands, ["session"], _Actions(), "session long, seq long, propagation string, objects array<long>")
