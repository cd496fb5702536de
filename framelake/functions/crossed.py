"""Pairs of members of two lists of a row, for whole batches of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are looked at at once.
PAIRS = 1 << 16


def lengths(lists: pa.Array) -> np.ndarray:
    """How many members each list has; a null one has none."""
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def crossed(n_a: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of each member of a row's first list and each of its second one, in blocks, with the lists of a column laid end to end."""
    row = np.repeat(np.arange(len(n_a)), n_a)
    width, start = n_b[row], (np.cumsum(n_b) - n_b)[row]
    done = np.concatenate([[0], np.cumsum(width)])
    for at in range(0, int(done[-1]), PAIRS):
        k = np.arange(at, min(at + PAIRS, done[-1]))
        i = np.searchsorted(done, k, "right") - 1
        yield i, start[i] + k - done[i]
