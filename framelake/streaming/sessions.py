"""Sessions as keyed state over a stream of commands: start, add, propagate, remove, reset, close.

A session's state is whether it runs, whether tracking has begun, and its objects in order of arrival; their place is their dense number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "tracking boolean, objects array<string>"
_OUT = "session long, seq long, command string, object string, ok boolean, number long, n_objects long"


def apply_command(state: tuple | None, command: str, name: str | None) -> tuple[tuple | None, bool, int | None]:
    """The state after a command, whether it was allowed, and the number of the object that it names. State: (tracking, objects), None for no session."""
    if command == "start":
        return (state or (False, [])), state is None, None
    if state is None:
        return None, False, None
    tracking, objects = state
    number = objects.index(name) if name in objects else None
    if command == "add":  # a new object once tracking has begun is an error; a known one is refined
        if number is None and tracking:
            return state, False, None
        objects = objects if number is not None else [*objects, name]
        return (tracking, objects), True, objects.index(name)
    if command == "remove":
        return (tracking, [o for o in objects if o != name]), number is not None, number
    if command == "propagate":
        return (True, objects), bool(objects), None
    if command == "reset":
        return (False, []), True, None
    if command == "close":
        return None, True, None
    return state, False, None


def run_sessions(commands: DataFrame) -> DataFrame:
    """A row per command of commands(session, seq, command, object), in order of seq within a session; commands to a session that does not run are not ok."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = (state.get[0], list(state.get[1])) if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            held, ok, number = apply_command(held, r.command, r.object)
            out.append((*key, r.seq, r.command, r.object, ok, number, len(held[1]) if held else 0))
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
        found = pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])
        found["number"] = found["number"].astype("Int64")
        yield found

    return commands.groupBy("session").applyInPandasWithState(advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
