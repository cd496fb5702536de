"""Object life cycles as a keyed state machine over a stream: confirmation after consecutive matches, and removal of objects that are lost while young.

State holds counters alone, so a key's state is of fixed size. Batches of one key are put in order of frame; frames must not go back between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "born long, run int, confirmed boolean, lost int, alive int, removed_at long"
_OUT = "session long, object string, frame long, run long, confirmed boolean, alive long, removed boolean"


def track_objects(frames: DataFrame, needed: int = 3, delay: int = 15, misses: int = 8, start: int = 0, most: int = 30, least: int = -1) -> DataFrame:
    """A row per frame of frames(session, object, frame, matched): the run of matches, whether `needed` ever stood in a row, the clamped keep-alive counter, and whether
    the object is removed: `misses` unmatched frames within `delay` frames of its first."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("frame")
        born, run, confirmed, lost, alive, removed_at = state.get if state.exists else (None, 0, False, 0, start, None)
        out = []
        for frame, matched in zip(rows["frame"].tolist(), rows["matched"].tolist(), strict=True):
            born = frame if born is None else born
            run = run + 1 if matched else 0
            confirmed = confirmed or run >= needed
            lost += 0 if matched else 1
            alive = min(most, max(least, alive + (1 if matched else -1)))
            if removed_at is None and lost >= misses and born > frame - delay:
                removed_at = frame
            out.append((*key, frame, run, confirmed, alive, removed_at is not None))
        state.update((born, run, confirmed, lost, alive, removed_at))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return frames.groupBy("session", "object").applyInPandasWithState(advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
