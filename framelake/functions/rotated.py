"""Rotated boxes: centre, size, and a counter-clockwise angle in degrees in an image whose y grows downwards. Polygons are arrays of corners; what two boxes share is
cut a batch of pairs at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .crossed import crossed, lengths


def _let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """The four corners in turn."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    at = lambda dx, dy: _point(cx + c * dx + s * dy, cy - s * dx + c * dy)
    return F.array(at(-w / 2, -h / 2), at(w / 2, -h / 2), at(w / 2, h / 2), at(-w / 2, h / 2))


def turned(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    """A box for met(): its corners are computed there, as corners() does."""
    return F.struct(cx.alias("x"), cy.alias("y"), w.alias("w"), h.alias("h"), F.cos(F.radians(angle)).alias("cos"), F.sin(F.radians(angle)).alias("sin"), F.hypot(w, h).alias("across"))


def area(polygon: Column) -> Column:
    """Of a convex polygon whose corners stand in turn; fewer than three corners have none."""
    turn = F.transform(polygon, lambda p, i: _let(F.get(polygon, (i + 1) % F.size(polygon)), lambda q: p["x"] * q["y"] - q["x"] * p["y"]))
    return F.abs(F.aggregate(turn, F.lit(0.0), lambda a, v: a + v)) / 2


def _cut(x: np.ndarray, y: np.ndarray, n: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of convex polygons (rows of n corners) inside of an edge each, from a to b: their corners there, and the places where their sides cross the edge."""
    k = np.arange(x.shape[1])
    own, after = k < n[:, None], np.where(k + 1 < n[:, None], k + 1, 0)
    (ax, ay), (bx, by) = (tuple(v[:, None] for v in e) for e in (a, b))
    side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
    inside = ~(side < 0)
    nx, ny, other, there = (np.take_along_axis(v, after, axis=1) for v in (x, y, side, inside))
    with np.errstate(all="ignore"):
        share = side / (side - other)
        cx, cy = x + (nx - x) * share, y + (ny - y) * share
    stays, crosses = own & inside, own & (inside != there)
    size = stays.astype(np.int64) + crosses
    at = np.cumsum(size, axis=1) - size
    total = size.sum(axis=1)
    out = np.zeros((2, len(x), max(1, int(total.max(initial=0)))))
    for flag, where, values in ((stays, at, (x, y)), (crosses, at + stays, (cx, cy))):
        row, col = np.nonzero(flag)
        for axis in range(2):
            out[axis, row, where[row, col]] = values[axis][row, col]
    return out[0], out[1], total


@F.arrow_udf(T.DoubleType())
def intersection(a: pa.Array, b: pa.Array) -> pa.Array:
    """Area that two boxes, given by their corners, share: one is cut at the four edges of the other. Null if one is null."""
    valid = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
    corner = lambda p, c: p.filter(pa.array(valid)).flatten().field(c).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, 4)
    out = np.zeros(len(valid))
    out[valid] = _shared(corner(a, 0), corner(a, 1), corner(b, 0), corner(b, 1))
    return pa.array(out, mask=~valid)


def _shared(x: np.ndarray, y: np.ndarray, ex: np.ndarray, ey: np.ndarray) -> np.ndarray:
    """Area that the boxes of each row share, given by their four corners."""
    n = np.full(len(x), 4)
    for k in range(4):
        j = (k + 1) % 4
        x, y, n = _cut(x, y, n, (ex[:, k], ey[:, k]), (ex[:, j], ey[:, j]))
    twice = np.zeros(len(x))
    for k in range(x.shape[1]):
        j = np.where(k + 1 < n, min(k + 1, x.shape[1] - 1), 0)
        rows = np.arange(len(x))
        twice += np.where(k < n, x[:, k] * y[rows, j] - x[rows, j] * y[:, k], 0.0)
    return np.abs(twice) / 2


_MET = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("iou", T.DoubleType())]))


@F.arrow_udf(_MET)
def met(a: pa.Array, b: pa.Array) -> pa.Array:
    """Each box of one list and box of another that share area, by their places in the lists of a row, with their intersection over union. Boxes are those of turned();
    a null list is empty."""
    n_a, n_b = lengths(a), lengths(b)
    row = np.repeat(np.arange(len(a)), n_a)
    left, right = _boxes(a), _boxes(b)
    found = []
    for i, j in crossed(n_a, n_b):
        apart = (left["x"][i] - right["x"][j]) ** 2 + (left["y"][i] - right["y"][j]) ** 2
        near = apart <= ((left["across"][i] + right["across"][j]) / 2 + 1) ** 2  # beyond half of both diagonals nothing is shared
        near &= (left["area"][i] > 0) & (right["area"][j] > 0)
        i, j = i[near], j[near]
        both = _shared(left["px"][i], left["py"][i], right["px"][j], right["py"][j])
        some = both > 0
        i, j, both = i[some], j[some], both[some]
        found.append((i, j, both / (left["area"][i] + right["area"][j] - both)))
    i, j, value = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[i], minlength=len(a)))])
    places = ((i - (np.cumsum(n_a) - n_a)[row[i]]).astype(np.int32), (j - (np.cumsum(n_b) - n_b)[row[i]]).astype(np.int32))
    pairs = pa.StructArray.from_arrays([pa.array(places[0]), pa.array(places[1]), pa.array(value)], names=["a", "b", "iou"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs)


def _boxes(lists: pa.Array) -> dict[str, np.ndarray]:
    """Centres, areas, diagonals and corners of all boxes of a column, laid end to end."""
    flat = lists.flatten()
    x, y, w, h, c, s, across = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in ("x", "y", "w", "h", "cos", "sin", "across"))
    at = [(x + c * dx + s * dy, y - s * dx + c * dy) for dx, dy in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]
    px, py = (np.stack(v, axis=1) for v in zip(*at, strict=True))
    return {"x": x, "y": y, "area": w * h, "across": across, "px": px, "py": py}


def iou(a: Column, b: Column, area_a: Column, area_b: Column) -> Column:
    """Intersection over union of two boxes, given by their corners; 0 if one is empty."""
    return _let(F.when((area_a > 0) & (area_b > 0), intersection(a, b)).otherwise(0.0), lambda i: F.when(i > 0, i / (area_a + area_b - i)).otherwise(0.0))
