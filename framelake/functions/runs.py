"""Algebra of run lists: and, or, difference, parts, boundaries, resizing and affine maps of masks, a batch of rows at a time.

Masks are column-major run lengths, first a run of zeros. The pixels of all rows of a batch stand on one line, row behind row, and a mask is its spans of ones on that
line; every operation sorts or searches span edges, so that its work grows with the runs, not with the pixels, and no row has a loop of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUNS = T.ArrayType(T.IntegerType())
_PARTS = T.ArrayType(T.StructType([T.StructField("size", T.LongType()), T.StructField("counts", _RUNS)]))
#: Pixels that a resized or mapped batch holds at once.
_PIXELS = 1 << 22
Spans = tuple[np.ndarray, np.ndarray]


# ---- spans of a batch


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of the lists of an array without nulls."""
    return lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _spans(counts: pa.Array) -> tuple[Spans, np.ndarray]:
    """Spans of ones on the line, and where each row begins on it (one entry more for the end)."""
    runs, lengths = _flat(counts)
    ends = np.cumsum(runs, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    on = ((np.arange(len(runs)) - np.repeat(first, lengths)) % 2 == 1) & (runs > 0)
    base = np.concatenate([[0], ends])[np.concatenate([first, [len(runs)]])]
    return (ends[on] - runs[on], ends[on]), base


def _inside(spans: Spans, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(spans[0], places, "right") > np.searchsorted(spans[1], places, "right")


def _where(sides: Sequence[Spans], base: np.ndarray, rule: Callable[..., np.ndarray]) -> Spans:
    """Spans on which the rule over the sides holds; they never cross rows, and touch nowhere else."""
    edges = np.unique(np.concatenate([base, *(x for s in sides for x in s)]))
    left, right = edges[:-1], edges[1:]
    on = rule(*(_inside(s, left) for s in sides))
    left, right = left[on], right[on]
    if not len(left):
        return left, right
    new = np.concatenate([[True], (left[1:] != right[:-1]) | np.isin(left[1:], base)])
    return left[new], right[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(right) - 1]])]


def _union(start: np.ndarray, end: np.ndarray, base: np.ndarray) -> Spans:
    """Spans that cover what any of the given ones, in any order and overlapping, covers; none of them crosses rows."""
    some = end > start
    start, end = start[some], end[some]
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]]) | (base[np.searchsorted(base, start)] == start) & np.concatenate([[True], start[1:] != start[:-1]]))
    return start[first], far[np.concatenate([first[1:] - 1, [len(start) - 1]])]


def _covered(start: np.ndarray, end: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Pixels that each of n rows' spans cover together. Spans stand on the line, those of one row beside those of no other."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    reached = np.maximum.accumulate(np.concatenate([[0], end[:-1]])) if len(end) else end
    return np.bincount(row[order], weights=np.maximum(end - np.maximum(start, reached), 0), minlength=n).astype(np.int64)


def _placed_spans(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Start and end of the spans of all lists' masks within their masks, the mask of each, and how many masks there are."""
    (start, end), base = _spans(lists.flatten())
    mask = np.searchsorted(base, start, "right") - 1
    return start - base[mask], end - base[mask], mask, len(base) - 1


def _levels(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of spans that may overlap, in order, and how many spans lie over the stretch from each to the next."""
    keys = np.sort(np.concatenate([2 * start + 1, 2 * end]))
    places = keys >> 1
    last = np.concatenate([places[1:] != places[:-1], np.ones(min(1, len(places)), bool)])
    return places[last], np.cumsum(2 * (keys & 1) - 1)[last]


def _stretches(places: np.ndarray, on: np.ndarray) -> Spans:
    """Spans of the stretches of _levels() that are on; the last one never is."""
    turns = places[np.flatnonzero(np.diff(on, prepend=False))]
    return turns[0::2], turns[1::2]


def _lists(spans: Spans, base: np.ndarray) -> pa.Array:
    """Run lengths of each row."""
    start, end = spans
    n = len(base) - 1
    row = np.searchsorted(base, start, "right") - 1
    own = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    size = 2 * own + 2  # the row's begin, its spans' edges, its end
    first = np.cumsum(size) - size
    places = np.empty(int(size.sum()), np.int64)
    at = first[row] + 1 + 2 * (np.arange(len(row)) - (np.cumsum(own) - own)[row])
    places[at], places[at + 1] = start, end
    places[first], places[first + size - 1] = base[:-1], base[1:]
    runs = np.diff(places, prepend=0)
    keep = np.ones(len(runs), bool)
    keep[first] = False
    last = first + size - 1
    keep[last] = runs[last] > 0
    lengths = size - 1 - ~keep[last]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(runs[keep], pa.int32()))


def _sums(spans: Spans, base: np.ndarray) -> np.ndarray:
    """Pixels of each row."""
    row = np.searchsorted(base, spans[0], "right") - 1
    return np.bincount(row, weights=spans[1] - spans[0], minlength=len(base) - 1).astype(np.int64)


def _columns(spans: Spans, base: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column, first and end y of the spans, cut at the columns."""
    start, end = spans
    row = np.searchsorted(base, start, "right") - 1
    tall = h[row]
    first, last = (start - base[row]) // tall, (end - 1 - base[row]) // tall
    n = last - first + 1
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, x, tall = np.repeat(row, n), np.repeat(first, n) + part, np.repeat(tall, n)
    edge = base[row] + x * tall
    return row, x, np.maximum(np.repeat(start, n), edge) - edge, np.minimum(np.repeat(end, n), edge + tall) - edge


def _placed(row: np.ndarray, x: np.ndarray, y0: np.ndarray, y1: np.ndarray, base: np.ndarray, h: np.ndarray, w: np.ndarray) -> Spans:
    """Spans of pieces of columns, cut to the image, in any order."""
    y0, y1 = np.maximum(y0, 0), np.minimum(y1, h[row])
    some = (x >= 0) & (x < w[row]) & (y1 > y0)
    edge = (base[row] + x * h[row])[some]
    return _union(edge + y0[some], edge + y1[some], base)


def _whole(work: Callable[..., pa.Array], *columns: pa.Array) -> pa.Array:
    """work() over the rows without nulls; a row with one is null."""
    valid = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    if valid.all():
        return work(*columns)
    found = work(*(c.filter(pa.array(valid)) for c in columns))
    return found.take(pa.array(np.where(valid, np.cumsum(valid) - 1, 0), pa.int32(), mask=~valid))


def _sides(a: pa.Array, b: pa.Array) -> tuple[list[Spans], np.ndarray]:
    (one, base), (two, other) = _spans(a), _spans(b)
    if not np.array_equal(base, other):
        raise ValueError("masks of different sizes")
    return [one, two], base


# ---- algebra


def _combining(rule: Callable[[np.ndarray, np.ndarray], np.ndarray], doc: str) -> Callable[[Column, Column], Column]:
    @F.arrow_udf(_RUNS)
    def combined(a: pa.Array, b: pa.Array) -> pa.Array:
        def work(a: pa.Array, b: pa.Array) -> pa.Array:
            sides, base = _sides(a, b)
            return _lists(_where(sides, base, rule), base)

        return _whole(work, a, b)

    def function(a: Column, b: Column) -> Column:
        return combined(a, b)

    function.__doc__ = doc
    return function


both = _combining(lambda a, b: a & b, "Run lengths of the pixels of both masks; null if either is.")
either = _combining(lambda a, b: a | b, "Run lengths of the pixels of either mask; null if either is.")
without = _combining(lambda a, b: a & ~b, "Run lengths of the first mask's pixels that the second lacks; null if either is.")


@F.arrow_udf(T.LongType())
def shared_pixels(a: pa.Array, b: pa.Array) -> pa.Array:
    """Number of pixels that two masks share."""

    def work(a: pa.Array, b: pa.Array) -> pa.Array:
        sides, base = _sides(a, b)
        return pa.array(_sums(_where(sides, base, lambda x, y: x & y), base))

    return _whole(work, a, b)


@F.arrow_udf(_RUNS)
def union_of(lists: pa.Array, size: pa.Array) -> pa.Array:
    """Run lengths of the union of a row's masks of `size` pixels each; of none, an empty mask."""

    def work(lists: pa.Array, size: pa.Array) -> pa.Array:
        spans, inner = _spans(lists.flatten())
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        base = np.concatenate([[0], np.cumsum(size.to_numpy().astype(np.int64))])
        mask = np.searchsorted(inner, spans[0], "right") - 1
        move = base[row[mask]] - inner[mask]
        return _lists(_union(spans[0] + move, spans[1] + move, base), base)

    return _whole(work, lists, size)


@F.arrow_udf(T.LongType())
def union_area(lists: pa.Array) -> pa.Array:
    """Pixels of the union of a row's masks, which all have one size."""

    def work(lists: pa.Array) -> pa.Array:
        start, end, mask, _ = _placed_spans(lists)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())[mask]
        move = row * int(end.max(initial=0))
        return pa.array(_covered(start + move, end + move, row, len(lists)))

    return _whole(work, lists)


_PAIR_LIST = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b")] + [T.StructField(n, T.LongType()) for n in ("inter", "area_a", "area_b")]))
#: Pairs of masks that are compared at once.
_PAIRS = 1 << 17


@F.arrow_udf(_PAIR_LIST)
def overlaps(lists: pa.Array) -> pa.Array:
    """Each two masks of a row, of one size, that share pixels: their places in the row, a before b, the pixels that they share, and those that each has."""

    def work(lists: pa.Array) -> pa.Array:
        start, end, mask, n = _placed_spans(lists)
        size = int(end.max(initial=0))
        spans = np.bincount(mask, minlength=n)
        first = np.cumsum(spans) - spans
        area = np.bincount(mask, weights=end - start, minlength=n).astype(np.int64)
        lengths = lists.value_lengths().to_numpy().astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lists)), lengths)
        some = spans > 0
        low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low[some], high[some] = start[first[some]], end[(first + spans - 1)[some]]
        later = (begin + lengths)[row] - 1 - np.arange(n)
        done = np.cumsum(later)
        found = []
        at = 0
        while at < n:  # masks with their pairs, in blocks
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + _PAIRS, "right")))
            k = later[at:to]
            a = np.repeat(np.arange(at, to), k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            meet = (low[a] < high[b]) & (low[b] < high[a])
            a, b = a[meet], b[meet]
            starts, ends, pairs = [], [], []
            for side in (a, b):
                pair = np.repeat(np.arange(len(side)), spans[side])
                own = np.arange(len(pair)) - (np.cumsum(spans[side]) - spans[side])[pair] + first[side][pair]
                starts.append(start[own] + pair * size)
                ends.append(end[own] + pair * size)
                pairs.append(pair)
            inter = area[a] + area[b] - _covered(*(np.concatenate(v) for v in (starts, ends, pairs)), len(a))
            found.append(np.stack([v[inter > 0] for v in (a, b, inter)]))
            at = to
        a, b, inter = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
        ends = np.cumsum(np.bincount(row[a], minlength=len(lists)))
        columns = [pa.array(a - begin[row[a]], pa.int32()), pa.array(b - begin[row[b]], pa.int32()), pa.array(inter), pa.array(area[a]), pa.array(area[b])]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(columns, ["a", "b", "inter", "area_a", "area_b"]))

    return _whole(work, lists)


def outside(counts: Column) -> Column:
    """Native: run lengths of the pixels that a mask lacks."""
    return F.when(F.get(counts, 0) == 0, F.slice(counts, 2, F.greatest(F.size(counts) - 1, F.lit(0)))).otherwise(F.concat(F.array(F.lit(0)), counts))


@F.arrow_udf(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("label", T.IntegerType())]))
def _error_point(truth: pa.Array, found: pa.Array, h: pa.Array, draw: pa.Array) -> pa.Array:
    def work(truth: pa.Array, found: pa.Array, h: pa.Array, draw: pa.Array) -> pa.Array:
        (t, f), base = _sides(truth, found)
        n = len(base) - 1
        edges = np.unique(np.concatenate([base, *t, *f]))
        left, size = edges[:-1], np.diff(edges)
        row = np.searchsorted(base, left, "right") - 1
        is_truth, is_found = _inside(t, left), _inside(f, left)
        parts = [is_found & ~is_truth, is_truth & ~is_found, ~is_truth]
        have = [np.bincount(row[on], weights=size[on], minlength=n).astype(np.int64) for on in parts]
        wrong = have[0] + have[1]
        k = np.floor(draw.to_numpy(zero_copy_only=False) * np.where(wrong > 0, wrong, have[2])).astype(np.int64)
        label = (wrong > 0) & (k >= have[0])
        k = np.where(label, k - have[0], k)
        place = np.zeros(n, np.int64)
        for on, own, mine in zip(parts, have, (~label & (wrong > 0), label, wrong == 0), strict=True):
            rows = np.flatnonzero(mine & (k >= 0) & (k < own))
            until = np.cumsum(size[on])
            target = (np.cumsum(own) - own)[rows] + k[rows]
            cell = np.searchsorted(until, target, "right")
            place[rows] = left[on][cell] + target - (until - size[on])[cell] - base[rows]
        tall = h.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(place // tall), pa.array(place % tall), pa.array(label.astype(np.int32))], ["x", "y", "label"])

    return _whole(work, truth, found, h, draw)


def error_point(truth: Column, found: Column, h: Column, draw: Column) -> Column:
    """x, y and label of a pixel drawn evenly where a found mask (null: empty) differs from the truth: label 1 where it misses, 0 where it exceeds.

    If they agree, the pixel is drawn from the background, with label 0; without background it is (0, 0). draw: from 0 to below 1. A batch at a time.
    """
    size = F.aggregate(truth, F.lit(0).cast("long"), lambda a, c: a + c)
    zero = F.lit(0).cast("long")
    return F.coalesce(_error_point(truth, F.coalesce(found, F.array(size.cast("int"))), h, draw), F.struct(zero.alias("x"), zero.alias("y"), F.lit(None).cast("int").alias("label")))


# ---- parts


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's set, by hooking roots to lesser ones and halving paths."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def _parts(row: np.ndarray, x: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """The first piece of each piece's part: pieces of neighbouring columns that touch, corners too, are of one part. Pieces stand in order."""
    stride = int(y1.max(initial=0)) + 2
    column = x + row * (int(x.max(initial=0)) + 2)
    begin, end = column * stride + y0, column * stride + y1
    low = np.searchsorted(end, (column + 1) * stride + y0, "left")
    high = np.searchsorted(begin, (column + 1) * stride + y1, "right")
    n = np.maximum(high - low, 0)
    u = np.repeat(np.arange(len(row)), n)
    return _joined(len(row), u, np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


@F.arrow_udf(_PARTS)
def components(counts: pa.Array, h: pa.Array) -> pa.Array:
    """Size and run lengths of the 8-connected parts of a mask of height h, in order of their first pixels down the columns."""

    def work(counts: pa.Array, h: pa.Array) -> pa.Array:
        spans, base = _spans(counts)
        tall = h.to_numpy().astype(np.int64)
        row, x, y0, y1 = _columns(spans, base, tall)
        root = _parts(row, x, y0, y1)
        first, part = np.unique(root, return_inverse=True)
        of_row = row[first]
        line = np.concatenate([[0], np.cumsum(np.diff(base)[of_row])])  # a line of its own for each part
        at = line[part] + x * tall[row]
        own = _union(at + y0, at + y1, line)
        runs = _lists(own, line)
        values = pa.StructArray.from_arrays([pa.array(_sums(own, line)), runs], ["size", "counts"])
        n = np.bincount(of_row, minlength=len(tall))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)

    return _whole(work, counts, h)


def _by_part(spans: Spans, base: np.ndarray, tall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of columns on the line (start, end), with their row and the size of their part."""
    row, x, y0, y1 = _columns(spans, base, tall)
    root = _parts(row, x, y0, y1)
    at = base[row] + x * tall[row]
    return at + y0, at + y1, row, np.bincount(root, weights=y1 - y0, minlength=len(root)).astype(np.int64)[root]


@F.arrow_udf(_RUNS)
def cleaned(counts: pa.Array, h: pa.Array, most: pa.Array) -> pa.Array:
    """Run lengths of a mask whose holes of up to `most` pixels are filled, and of which parts of up to `most` pixels, and of half of it at most, then go."""

    def work(counts: pa.Array, h: pa.Array, most: pa.Array) -> pa.Array:
        spans, base = _spans(counts)
        tall, bound = (c.to_numpy().astype(np.int64) for c in (h, most))
        start, end, row, size = _by_part(_where([spans], base, lambda x: ~x), base, tall)
        hole = size <= bound[row]
        filled = _union(np.concatenate([spans[0], start[hole]]), np.concatenate([spans[1], end[hole]]), base)
        start, end, row, size = _by_part(filled, base, tall)
        keep = (size > np.minimum(bound, _sums(filled, base) // 2)[row]) | (bound[row] <= 0)
        return _lists(_union(start[keep], end[keep], base), base)

    return _whole(work, counts, h, most)


# ---- boundaries


def _gapped(base: np.ndarray) -> np.ndarray:
    """Where rows begin on a line with a free place behind each, so that spans of two rows never touch."""
    return base + np.arange(len(base))


def _boundary(spans: Spans, base: np.ndarray, line: np.ndarray, h: np.ndarray, w: np.ndarray) -> Spans:
    """Spans on the line `line` of the pixels where a mask, and it moved left, up, and both, are not all alike. Moved masks keep their last row or column."""
    row, x, y0, y1 = _columns(spans, base, h)
    tall = h[row]
    edge = line[row] + x * tall
    up0, up1 = np.maximum(y0 - 1, 0), y1 - (y1 < tall)
    start, end = np.concatenate([edge + y0, edge + up0]), np.concatenate([edge + y1, edge + up1])
    back = np.concatenate([np.where(x > 0, tall, 0)] * 2)
    some, last = np.concatenate([x > 0] * 2), np.concatenate([x == w[row] - 1] * 2)
    start, end = (np.concatenate([v, (v - back)[some], v[last]]) for v in (start, end))
    places, cover = _levels(start, end)
    return _stretches(places, (cover > 0) & (cover < 4))


def _dilated(spans: Spans, line: np.ndarray, h: np.ndarray, w: np.ndarray, by: np.ndarray) -> Spans:
    """Spans of what lies within `by` rows and columns of spans; both stand on a line with gaps."""
    row, x, y0, y1 = _columns(spans, line, h)
    at, reach = line[row] + x * h[row], by[row]
    n = 2 * reach + 1
    piece = np.repeat(np.arange(len(row)), n)
    k = np.arange(len(piece)) - (np.cumsum(n) - n)[piece] - reach[piece]
    some = (x[piece] + k >= 0) & (x[piece] + k < w[row[piece]])
    piece, k = piece[some], k[some]
    move = k * h[row[piece]]
    places, cover = _levels((at + np.maximum(y0 - reach, 0))[piece] + move, (at + np.minimum(y1 + reach, h[row]))[piece] + move)
    return _stretches(places, cover > 0)


def _ungapped(spans: Spans, line: np.ndarray) -> Spans:
    row = np.searchsorted(line, spans[0], "right") - 1
    return spans[0] - row, spans[1] - row


@F.arrow_udf(_RUNS)
def boundary(counts: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
    """Run lengths of the pixels that differ from the one to the right, below, or both; the last row and column look along themselves, the corner is none."""

    def work(counts: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        spans, base = _spans(counts)
        line = _gapped(base)
        return _lists(_ungapped(_boundary(spans, base, line, h.to_numpy().astype(np.int64), w.to_numpy().astype(np.int64)), line), base)

    return _whole(work, counts, h, w)


@F.arrow_udf(_RUNS)
def dilated(counts: pa.Array, h: pa.Array, w: pa.Array, reach: pa.Array) -> pa.Array:
    """Run lengths of the pixels within `reach` rows and columns of a mask: a square kernel of 2 * reach + 1."""

    def work(counts: pa.Array, h: pa.Array, w: pa.Array, reach: pa.Array) -> pa.Array:
        spans, base = _spans(counts)
        line = _gapped(base)
        row = np.searchsorted(base, spans[0], "right") - 1
        tall, wide, by = (c.to_numpy().astype(np.int64) for c in (h, w, reach))
        return _lists(_ungapped(_dilated((spans[0] + row, spans[1] + row), line, tall, wide, by), line), base)

    return _whole(work, counts, h, w, reach)


#: Masks that are outlined at once: their edges then stay in the cache.
_ROWS = 1 << 10


class _Masks:
    """Spans within their masks, mask by mask, and the pixels and the size of each mask. line: where masks begin, the last place of each being free or not."""

    def __init__(self, spans: Spans, line: np.ndarray):
        n = len(line) - 1
        mask = np.searchsorted(line, spans[0], "right") - 1
        self.start, self.end = spans[0] - line[mask], spans[1] - line[mask]
        self.spans = np.bincount(mask, minlength=n)
        self.first = np.cumsum(self.spans) - self.spans
        self.pixels = np.bincount(mask, weights=spans[1] - spans[0], minlength=n).astype(np.int64)
        self.size = np.diff(line)

    def boxes(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and first free (place, y) of each mask of height h; masks without pixels have boxes that meet nothing."""
        mask = np.repeat(np.arange(len(self.spans)), self.spans)
        tall = h[mask]
        across = (self.end - 1) // tall > self.start // tall
        low, high = np.full((2, len(self.spans)), np.iinfo(np.int64).max), np.zeros((2, len(self.spans)), np.int64)
        for k, (a, b) in enumerate(((self.start, self.end), (np.where(across, 0, self.start % tall), np.where(across, tall, (self.end - 1) % tall + 1)))):
            np.minimum.at(low[k], mask, a)
            np.maximum.at(high[k], mask, b)
        return low, high

    def of(self, masks: np.ndarray, stride: int) -> Spans:
        """The spans of some masks, each on a stretch of its own of so many places."""
        n = self.spans[masks]
        at = np.repeat(np.arange(len(masks)), n)
        own = np.arange(len(at)) - (np.cumsum(n) - n)[at] + self.first[masks][at]
        return self.start[own] + at * stride, self.end[own] + at * stride


def _shared(one: _Masks, a: np.ndarray, two: _Masks, b: np.ndarray, stride: int) -> np.ndarray:
    """Pixels that mask a[k] of the one and mask b[k] of the other share, for each k."""
    places, cover = _levels(*(np.concatenate(v) for v in zip(one.of(a, stride), two.of(b, stride), strict=True)))
    both = np.flatnonzero(cover == 2)
    return np.bincount(places[both] // stride, weights=places[both + 1] - places[both], minlength=len(a)).astype(np.int64)


def _outlines(counts: pa.Array, h: np.ndarray, w: np.ndarray, by: np.ndarray) -> tuple[_Masks, _Masks, _Masks]:
    """Masks, their boundaries, and what lies near these."""
    spans, base = _spans(counts)
    line = _gapped(base)
    outline = _boundary(spans, base, line, h, w)
    return _Masks(spans, base), _Masks(outline, line), _Masks(_dilated(outline, line, h, w, by), line)


_OUTLINES = T.StructType([T.StructField(n, T.LongType()) for n in ("truth", "found", "truth_near", "found_near", "found_hits", "truth_hits")])


@F.arrow_udf(_OUTLINES)
def outlines(truth: pa.Array, found: pa.Array, h: pa.Array, w: pa.Array, reach: pa.Array) -> pa.Array:
    """Pixels of the boundaries of two masks of one size, of what lies within `reach` rows and columns of these, and of each boundary those that lie near the other one."""

    def part(truth: pa.Array, found: pa.Array, tall: np.ndarray, wide: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
        (m, t, t_near), (o, f, f_near) = (_outlines(c, tall, wide, by) for c in (truth, found))
        if (m.size != o.size).any():
            raise ValueError("masks of different sizes")
        rows, stride = np.arange(len(tall)), int(m.size.max(initial=0)) + 1
        return [t.pixels, f.pixels, t_near.pixels, f_near.pixels, _shared(f, rows, t_near, rows, stride), _shared(t, rows, f_near, rows, stride)]

    def work(truth: pa.Array, found: pa.Array, *sizes: pa.Array) -> pa.Array:
        sizes = [c.to_numpy().astype(np.int64) for c in sizes]
        done = [part(truth[k : k + _ROWS], found[k : k + _ROWS], *(v[k : k + _ROWS] for v in sizes)) for k in range(0, max(1, len(truth)), _ROWS)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*done, strict=True)], _OUTLINES.names)

    return _whole(work, truth, found, h, w, reach)


# ---- rasters


def _encoded(pixels: np.ndarray) -> pa.Array:
    """Run lengths of masks of one size, (rows, h, w)."""
    n, h, w = pixels.shape
    flat = pixels.transpose(0, 2, 1).reshape(n, h * w).astype(np.int8)
    edges = np.diff(flat, axis=1, prepend=0, append=0)
    base = np.arange(n + 1, dtype=np.int64) * (h * w)
    places = lambda sign: (lambda at: at[0] * (h * w) + at[1])(np.nonzero(edges == sign))
    return _lists((places(1), places(-1)), base)


def _weights(n: int, size: int) -> np.ndarray:
    """Shares of n cells in `size` places between their centres; beyond the outer centres the outer cells count alone."""
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, None)
    low = np.minimum(np.floor(at).astype(np.int64), n - 1)
    out = np.zeros((size, n))
    np.add.at(out, (np.arange(size), low), 1 - (at - low))
    np.add.at(out, (np.arange(size), np.minimum(low + 1, n - 1)), at - low)
    return out


@F.arrow_udf(_RUNS)
def resized(grid: pa.Array, grid_h: pa.Array, grid_w: pa.Array, h: pa.Array, w: pa.Array, threshold: pa.Array) -> pa.Array:
    """Run lengths of the h * w mask where a row-major grid of grid_h * grid_w values, read between the centres of its cells, is above the threshold."""

    def work(grid: pa.Array, *sizes: pa.Array) -> pa.Array:
        values, lengths = _flat(grid)
        first = np.cumsum(lengths) - lengths
        *sizes, least = (c.to_numpy() for c in sizes)
        kinds, kind = np.unique(np.stack(sizes), axis=1, return_inverse=True)
        order, found = [], []
        for k, (gh, gw, th, tw) in enumerate(kinds.T.tolist()):
            rows = np.flatnonzero(kind.ravel() == k)
            if (lengths[rows] != gh * gw).any():
                raise ValueError("a grid does not have the values that its size says")
            down, along = _weights(gh, th), _weights(gw, tw).T
            step = max(1, _PIXELS // max(1, th * tw))
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                cells = values[first[own][:, None] + np.arange(gh * gw)].astype(np.float64).reshape(len(own), gh, gw)
                found.append(_encoded(down @ cells @ along > least[own][:, None, None]))
                order.append(own)
        if not found:
            return pa.array([], pa.list_(pa.int32()))
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))

    return _whole(work, grid, grid_h, grid_w, h, w, threshold)


def affine_matrix(angle: Column, move_x: Column, move_y: Column, scale: Column, shear_x: Column, shear_y: Column, w: Column, h: Column) -> Column:
    """a, b, c, d, e, f of the map from a place (x, y) of the result to a x + b y + c, d x + e y + f in the source: of rotating (degrees, clockwise), scaling, shearing
    (degrees) and moving an image about its centre."""
    turn, sx, sy = (F.radians(v) for v in (angle, shear_x, shear_y))
    cx, cy = w / 2, h / 2
    p = F.cos(turn - sy) / F.cos(sy)
    q = -F.cos(turn - sy) * F.tan(sx) / F.cos(sy) - F.sin(turn)
    r = F.sin(turn - sy) / F.cos(sy)
    s = -F.sin(turn - sy) * F.tan(sx) / F.cos(sy) + F.cos(turn)
    a, b, d, e = s / scale, -q / scale, -r / scale, p / scale
    return F.array(a, b, cx - a * (cx + move_x) - b * (cy + move_y), d, e, cy - d * (cx + move_x) - e * (cy + move_y))


@F.arrow_udf(_RUNS)
def mapped(counts: pa.Array, h: pa.Array, w: pa.Array, matrix: pa.Array) -> pa.Array:
    """Run lengths of a mask whose pixels are taken, by their centres, from the places of another that an affine map (of 6 numbers) tells; outside it is nothing."""

    def work(counts: pa.Array, h: pa.Array, w: pa.Array, matrix: pa.Array) -> pa.Array:
        spans, base = _spans(counts)
        tall, wide = (c.to_numpy().astype(np.int64) for c in (h, w))
        m = matrix.flatten().to_numpy().reshape(-1, 6)
        row, x, y0, y1 = _columns(spans, base, tall)
        n = len(tall)
        box = [np.full(n, v) for v in (np.inf, np.inf, -np.inf, -np.inf)]
        for k, v, of in ((0, x, np.minimum), (1, y0, np.minimum), (2, x + 1, np.maximum), (3, y1, np.maximum)):
            of.at(box[k], row, v)
        det = m[:, 0] * m[:, 4] - m[:, 1] * m[:, 3]
        some = np.isfinite(box[0]) & (det != 0)
        window = np.zeros((n, 4), np.int64)  # where in the result the mask can come to lie
        with np.errstate(all="ignore"):
            to = [[(m[:, 4] * (u - m[:, 2]) - m[:, 1] * (v - m[:, 5])) / det, (m[:, 0] * (v - m[:, 5]) - m[:, 3] * (u - m[:, 2])) / det] for u in (box[0], box[2]) for v in (box[1], box[3])]
            for axis, most in ((0, wide), (1, tall)):
                ends = np.array([t[axis] for t in to])
                window[some, axis] = np.clip(np.floor(ends.min(axis=0)) - 1, 0, most)[some]
                window[some, axis + 2] = np.clip(np.ceil(ends.max(axis=0)) + 1, 0, most)[some]
        size = (window[:, 2] - window[:, 0]) * (window[:, 3] - window[:, 1])
        starts, ends = [], []
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 1, _PIXELS), "left")
        for a, b in zip(cuts, [*cuts[1:], n], strict=True):
            rows = np.repeat(np.arange(a, b), size[a:b])
            k = np.arange(len(rows)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
            high = np.maximum(window[rows, 3] - window[rows, 1], 1)
            px, py = window[rows, 0] + k // high, window[rows, 1] + k % high
            u, v = (m[rows, i] * (px + 0.5) + m[rows, i + 1] * (py + 0.5) + m[rows, i + 2] for i in (0, 3))
            u, v = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
            hit = (u >= 0) & (u < wide[rows]) & (v >= 0) & (v < tall[rows])
            hit[hit] = _inside(spans, (base[rows] + u * tall[rows] + v)[hit])
            at = (base[rows] + px * tall[rows] + py)[hit]
            starts.append(at)
            ends.append(at + 1)
        return _lists(_union(np.concatenate(starts), np.concatenate(ends), base), base)

    return _whole(work, counts, h, w, matrix)
