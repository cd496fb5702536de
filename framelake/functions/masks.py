"""Masks as column-major run lengths, first a run of zeros: array<int> counts beside height and width, with the compressed string form of the public COCO format.

Arrow functions over batches; a mask is never wider than its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUNS = T.ArrayType(T.IntegerType())


def encode(mask: np.ndarray) -> list[int]:
    """Run lengths of a 2-d mask, down the columns."""
    flat = np.asarray(mask, bool).T.reshape(-1)
    edges = np.flatnonzero(np.diff(flat.astype(np.int8))) + 1
    runs = np.diff(np.concatenate([[0], edges, [len(flat)]])).tolist() if len(flat) else []
    return [0, *runs] if len(flat) and flat[0] else runs


def decode(counts, h: int, w: int) -> np.ndarray:
    counts = np.asarray(counts, np.int64)
    values = np.repeat(np.arange(len(counts)) % 2, counts).astype(bool)
    return values.reshape(w, h).T


def to_string(counts) -> str:
    """Each count, from the third on as its difference to the last but one, in groups of five bits, least first, 48 added, a sixth bit for more to come."""
    out = []
    for i, c in enumerate(counts):
        x = int(c) - (int(counts[i - 2]) if i > 2 else 0)
        while True:
            low = x & 31
            x >>= 5
            more = x != (-1 if low & 16 else 0)
            out.append(chr(48 + low + 32 * more))
            if not more:
                break
    return "".join(out)


def from_string(text: str) -> list[int]:
    counts: list[int] = []
    value = shift = 0
    for c in text:
        bits = ord(c) - 48
        value |= (bits & 31) << shift
        shift += 5
        if not bits & 32:
            if bits & 16:
                value -= 1 << shift
            counts.append(value + (counts[-2] if len(counts) > 2 else 0))
            value = shift = 0
    return counts


def intersection(a, b) -> int:
    """Common pixels of two masks by their runs."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    edges = np.union1d(ends_a, ends_b)
    starts = np.concatenate([[0], edges[:-1]])
    inside = lambda ends: np.searchsorted(ends, starts, "right") % 2 == 1
    return int((edges - starts)[inside(ends_a) & inside(ends_b)].sum())


def bounds(counts, h: int) -> list[int] | None:
    """x0, y0, x1, y1 with exclusive ends; None for an empty mask."""
    ends = np.cumsum(counts)
    starts, ends = ends[0::2][: len(ends) // 2], ends[1::2]
    some = ends > starts
    starts, ends = starts[some], ends[some]
    if not len(starts):
        return None
    across = (ends - 1) // h > starts // h
    y0 = 0 if across.any() else int((starts % h).min())
    y1 = h if across.any() else int(((ends - 1) % h).max()) + 1
    return [int(starts.min() // h), y0, int((ends.max() - 1) // h) + 1, y1]


def boundary(mask: np.ndarray) -> np.ndarray:
    """Pixels that differ from the one to the right, below, or both; the last row and column look along themselves, the corner is none."""
    m = np.asarray(mask, bool)
    out = np.zeros_like(m)
    out[:-1, :-1] = (m[:-1, :-1] != m[:-1, 1:]) | (m[:-1, :-1] != m[1:, :-1]) | (m[:-1, :-1] != m[1:, 1:])
    out[-1, :-1] = m[-1, :-1] != m[-1, 1:]
    out[:-1, -1] = m[:-1, -1] != m[1:, -1]
    return out


@F.arrow_udf(_RUNS)
def box_mask(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
    """Runs of a filled box with integer corners, ends exclusive, clipped to the image; a batch at a time."""
    from . import runs

    def work(*columns: pa.Array) -> pa.Array:
        a, b, c, d, tall, wide = (np.trunc(v.to_numpy(zero_copy_only=False)).astype(np.int64) for v in columns)
        a, b, c, d = np.maximum(a, 0), np.maximum(b, 0), np.minimum(c, wide), np.minimum(d, tall)
        some, whole = (c > a) & (d > b), d - b == tall
        n = np.where(some, np.where(whole, 1, c - a), 0)  # runs of ones
        on, off = np.where(whole, (c - a) * tall, d - b), tall - (d - b)
        lead = np.where(some, a * tall + np.where(whole, 0, b), tall * wide)
        rest = np.where(some, tall * wide - lead - n * on - np.maximum(n - 1, 0) * off, 0)
        size = 1 + 2 * n - (some & (rest == 0))
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(n)), size)
        k = np.arange(len(row)) - first[row]
        values = np.where(k % 2 == 1, on[row], off[row])
        values[first] = lead
        tail = some & (rest > 0)
        values[(first + size - 1)[tail]] = rest[tail]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values, pa.int32()))

    return runs._whole(work, x0, y0, x1, y1, h, w)


@F.pandas_udf(T.StringType())
def packed(counts: pd.Series) -> pd.Series:
    return counts.map(to_string)


@F.pandas_udf(_RUNS)
def unpacked(text: pd.Series) -> pd.Series:
    return text.map(from_string)


@F.pandas_udf(T.LongType())
def mask_intersection(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([intersection(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def _boxes(counts: pa.Array, h: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sides of the boxes of a batch's masks, and which masks are empty."""
    from . import runs

    (start, end), base = runs._spans(counts)
    row = np.searchsorted(base, start, "right") - 1
    tall = h.to_numpy(zero_copy_only=False).astype(np.int64)
    high = tall[row]
    start, last = start - base[row], end - 1 - base[row]
    x0, x1 = start // high, last // high
    across = x1 > x0
    out = np.zeros((len(tall), 4), np.int64)
    own = np.bincount(row, minlength=len(tall))
    some = own > 0
    if len(row):
        first = (np.cumsum(own) - own)[some]
        least, most = (lambda v: np.minimum.reduceat(v, first)), (lambda v: np.maximum.reduceat(v, first))
        out[some] = np.stack([least(x0), least(np.where(across, 0, start - x0 * high)), most(x1) + 1, most(np.where(across, high, last - x1 * high + 1))], axis=1)
    return out, ~some


@F.arrow_udf(_RUNS)
def mask_box(counts: pa.Array, h: pa.Array) -> pa.Array:
    """x0, y0, x1, y1 with exclusive ends; null for an empty mask. A batch at a time."""
    from . import runs

    def work(counts: pa.Array, h: pa.Array) -> pa.Array:
        out, empty = _boxes(counts, h)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * 4, pa.int32()), pa.array(out.ravel(), pa.int32()), mask=pa.array(empty))

    return runs._whole(work, counts, h)


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("area", "x0", "y0", "x1", "y1")]))
def measured(counts: pa.Array, h: pa.Array) -> pa.Array:
    """As pixels() and mask_box() in one: area 0 and null sides for an empty mask. Over a mask that nothing else reads, runs need not leave the call that makes them."""
    from . import runs

    def work(counts: pa.Array, h: pa.Array) -> pa.Array:
        out, empty = _boxes(counts, h)
        sides = [pa.array(out[:, k], mask=empty) for k in range(4)]
        return pa.StructArray.from_arrays([pa.array(runs._sums(*runs._spans(counts))), *sides], ["area", "x0", "y0", "x1", "y1"])

    return runs._whole(work, counts, h)


@F.arrow_udf(T.LongType())
def pixels(counts: pa.Array) -> pa.Array:
    """As mask_area(), a batch at a time; not for use inside lambdas."""
    from . import runs

    return runs._whole(lambda c: pa.array(runs._sums(*runs._spans(c))), counts)


def mask_area(counts):
    """Native: every second run."""
    return F.aggregate(F.filter(counts, lambda _, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, c: a + c)


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """A square kernel of odd size, one axis after the other."""
    out = np.asarray(mask, bool)
    for axis in (0, 1):
        grown = out.copy()
        for k in range(1, size // 2 + 1):
            for sign in (k, -k):
                moved = np.roll(out, sign, axis)
                edge = [slice(None)] * 2
                edge[axis] = slice(0, k) if sign > 0 else slice(-k, None)
                moved[tuple(edge)] = False
                grown |= moved
        out = grown
    return out


def boundary_f(found: np.ndarray, truth: np.ndarray, tolerance: int) -> float:
    """F measure of boundaries that match within a tolerance in pixels; 1 if both are empty, 0 if one is."""
    a, b = boundary(found), boundary(truth)
    if not a.any() or not b.any():
        return float(a.any() == b.any())
    near = lambda m: dilated(m, 2 * tolerance + 1)
    precision, recall = (a & near(b)).sum() / a.sum(), (b & near(a)).sum() / b.sum()
    return float(2 * precision * recall / (precision + recall)) if precision + recall else 0.0


def components(mask: np.ndarray) -> np.ndarray:
    """Labels, from 1 in order of the first pixel, of the 8-connected parts of a mask: least neighbouring labels spread until they stand."""
    m = np.asarray(mask, bool)
    big = m.size + 1
    labels = np.where(m, np.arange(1, m.size + 1).reshape(m.shape), big)
    while True:
        padded = np.pad(labels, 1, constant_values=big)
        least = np.min([padded[i : i + m.shape[0], j : j + m.shape[1]] for i in range(3) for j in range(3)], axis=0)
        least = np.where(m, least, big)
        least = np.where(m, np.minimum(least, least.reshape(-1)[np.minimum(least, m.size) - 1]), big)
        if (least == labels).all():
            return np.where(m, np.unique(np.where(m, labels, 0), return_inverse=True)[1].reshape(m.shape) + (0 if (~m).any() else 1), 0)
        labels = least


@F.pandas_udf(_RUNS)
def mask_union(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Of each row's array of masks (runs over one size), the runs of their union."""

    def union(masks) -> list[int]:
        total = sum(int(x) for x in masks[0])
        step = np.zeros(total + 1, np.int32)
        for counts in masks:
            ends = np.cumsum(counts)
            np.add.at(step, ends[0::2][: len(ends) // 2], 1)
            np.add.at(step, ends[1::2], -1)
        return encode((np.cumsum(step)[:-1] > 0)[None, :])

    for rows in batches:
        yield rows.map(union)


@F.pandas_udf(T.DoubleType())
def mask_boundary_f(found: pd.Series, truth: pd.Series, h: pd.Series, w: pd.Series, tolerance: pd.Series) -> pd.Series:
    return pd.Series([boundary_f(decode(a, int(r), int(c)), decode(b, int(r), int(c)), int(t)) for a, b, r, c, t in zip(found, truth, h, w, tolerance, strict=True)])


def polygon_area(xs, ys):
    """Native: half the absolute sum of cross products around arrays of corners."""
    n = F.size(xs)
    turn = lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i)
    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), turn), F.lit(0.0), lambda a, v: a + v)) / 2
