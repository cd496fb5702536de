"""Points and boxes of masks. Masks are column-major run lengths, first a run of zeros; what a run list can tell is native, distances and rasters are small Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import masks, runs

_POINT = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])
_ERROR = T.StructType([*_POINT.fields, T.StructField("label", T.IntegerType())])


# ---- boxes of masks: exclusive ends come from masks.mask_box


def inclusive_box(box: Column, h: Column, w: Column, empty: str = "zeros") -> Column:
    """x0, y0, x1, y1 with inclusive ends, from an exclusive box that is null for an empty mask. empty: zeros, or turned (w, h, 0, 0), which no pixel enlarges."""
    zero = F.lit(0).cast("long")
    none = F.array(zero, zero, zero, zero) if empty == "zeros" else F.array(w.cast("long"), h.cast("long"), zero, zero)
    own = F.array(*[(F.get(box, k) - (1 if k > 1 else 0)).cast("long") for k in range(4)])
    return F.when(box.isNull(), none).otherwise(own)


def inner_area(inclusive: Column) -> Column:
    """Width times height of an inclusive box without adding the last row and column."""
    return (F.get(inclusive, 2) - F.get(inclusive, 0)) * (F.get(inclusive, 3) - F.get(inclusive, 1))


def mask_iom(inter: Column, area_a: Column, area_b: Column, eps: float | None = None) -> Column:
    """Intersection over the smaller area: eps added to it, or, without, at least 1."""
    low = F.least(area_a, area_b)
    return inter / (low + eps if eps is not None else F.greatest(low, F.lit(1)))


def relative_box(bbox: Column, w, h) -> Column:
    """x, y, w, h as shares of the image; one whose numbers are all 1 or less is so already."""
    by = [w, h, w, h]
    scaled = F.array(*[F.get(bbox, k) / by[k] for k in range(4)])
    return F.when(F.array_max(bbox) > 1, scaled).otherwise(bbox)


def centre_similarity(a: Column, b: Column, zero: float) -> Column:
    """1 for equal places, falling to 0 at a distance of `zero`: a and b are arrays of coordinates."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.greatest(F.lit(0.0), 1 - F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)) / zero)


def point_distances(x: Column, y: Column, box: Column) -> Column:
    """Signed distances to the left, top, right and bottom side of a box; all positive inside."""
    return F.array(x - box["x0"], y - box["y0"], box["x1"] - x, box["y1"] - y)


def heatmap_bin(x: Column, y: Column, visible: Column, box: Column, size: int) -> Column:
    """Number of the keypoint's bin in a size x size grid of a box, and whether it is valid; the far edges belong to the last bin."""
    at = lambda v, low, high: F.when(v == high, size - 1).otherwise(F.floor((v - low) * size / (high - low))).cast("long")
    bx, by = at(x, box["x0"], box["x1"]), at(y, box["y0"], box["y1"])
    valid = (bx >= 0) & (by >= 0) & (bx < size) & (by < size) & (visible > 0)
    return F.struct(F.when(valid, by * size + bx).otherwise(F.lit(0)).alias("bin"), valid.alias("valid"))


# ---- pixels of run lists


def pixel(counts: Column, k: Column, h: Column) -> Column:
    """Pixel k, from 0, of a mask, down its columns; null if it has fewer."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    def step(s: Column, n: Column) -> Column:
        here = s["on"] & s["found"].isNull() & (s["left"] < n)
        return F.struct((s["at"] + n).alias("at"), (s["left"] - F.when(s["on"], n).otherwise(0)).alias("left"), (~s["on"]).alias("on"), F.when(here, s["at"] + s["left"]).otherwise(s["found"]).alias("found"))

    found = F.aggregate(counts, F.struct(zero.alias("at"), k.cast("long").alias("left"), F.lit(False).alias("on"), none.alias("found")), step, lambda s: s["found"])
    return F.transform(F.array(found), lambda p: F.when(p.isNotNull(), F.struct(F.floor(p / h).cast("long").alias("x"), (p % h).cast("long").alias("y"))))[0]


def covers(counts: Column, x: Column, y: Column, h: Column) -> Column:
    """Whether a mask has the pixel (x, y)."""
    place = x * h + y
    ends = F.aggregate(counts, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).alias("n")), lambda s, n: F.struct((s["end"] + n).alias("end"), (s["n"] + F.when(s["end"] + n <= place, 1).otherwise(0)).alias("n")), lambda s: s["n"])
    return ends % 2 == 1


@F.arrow_udf(_POINT)
def nth_pixel(counts: pa.Array, k: pa.Array, h: pa.Array) -> pa.Array:
    """As pixel(), a batch at a time; not for use inside lambdas."""

    def work(counts: pa.Array, k: pa.Array, h: pa.Array) -> pa.Array:
        (start, end), base = runs._spans(counts)
        at, tall = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (k, h))
        before = np.concatenate([[0], np.cumsum(end - start)])
        ones = before[np.searchsorted(start, base)]  # pixels before each row
        some = (at >= 0) & (at < np.diff(ones))
        to = (ones[:-1] + at)[some]
        span = np.searchsorted(before, to, "right") - 1
        place = np.zeros(len(at), np.int64)
        place[some] = start[span] + to - before[span] - base[:-1][some]
        return pa.StructArray.from_arrays([pa.array(place // tall), pa.array(place % tall)], ["x", "y"], mask=pa.array(~some))

    return runs._whole(work, counts, k, h)


@F.arrow_udf(T.BooleanType())
def has_pixel(counts: pa.Array, x: pa.Array, y: pa.Array, h: pa.Array) -> pa.Array:
    """As covers(), a batch at a time; not for use inside lambdas. Places beyond the mask's size are not covered."""

    def work(counts: pa.Array, *place: pa.Array) -> pa.Array:
        spans, base = runs._spans(counts)
        x, y, tall = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in place)
        at = x * tall + y
        inside = (at >= 0) & (at < np.diff(base))
        return pa.array(inside & runs._inside(spans, np.where(inside, base[:-1] + at, 0)))

    return runs._whole(work, counts, x, y, h)


# ---- grids


def bilinear(grid: Column, x: Column, y: Column, h: int, w: int) -> Column:
    """The value of a row-major array of h * w numbers at (x, y) in shares of its size, between the centres of cells; outside it is 0."""
    px, py = x * w - 0.5, y * h - 0.5
    x0, y0 = F.floor(px).cast("int"), F.floor(py).cast("int")

    def at(i: Column, j: Column) -> Column:
        return F.when((i >= 0) & (i < h) & (j >= 0) & (j < w), F.get(grid, i * w + j).cast("double")).otherwise(0.0)

    fx, fy = px - x0, py - y0
    return at(y0, x0) * (1 - fx) * (1 - fy) + at(y0, x0 + 1) * fx * (1 - fy) + at(y0 + 1, x0) * (1 - fx) * fy + at(y0 + 1, x0 + 1) * fx * fy


# ---- distances


def squared_distance(mask: np.ndarray) -> np.ndarray:
    """Squared distance of each pixel of a mask to the nearest one outside it; first down the columns, then along the rows. Without such a pixel, a large number."""
    m = np.asarray(mask, bool)
    far = sum(m.shape) * 2 + 1
    h, w = m.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(m, -far, rows), axis=0)
    below = np.minimum.accumulate(np.where(m, far + h, rows)[::-1], axis=0)[::-1]
    down = np.minimum(np.minimum(rows - above, below - rows), far) ** 2
    apart = ((np.arange(w)[:, None] - np.arange(w)[None, :]) ** 2).astype(np.int32)
    rows_at_once = max(1, (1 << 20) // max(1, w * w))
    return np.concatenate([(apart[None] + down[k : k + rows_at_once, None, :].astype(np.int32)).min(axis=2) for k in range(0, h, rows_at_once)]) if h else down


def _window(mask_counts, h: int, w: int) -> tuple[np.ndarray, int, int] | None:
    """The part of a mask around its pixels, with one row and column more where the image has them, and where it begins: nothing nearer lies outside it."""
    box = masks.bounds(mask_counts, h)
    if box is None:
        return None
    x0, y0, x1, y1 = max(0, box[0] - 1), max(0, box[1] - 1), min(w, box[2] + 1), min(h, box[3] + 1)
    step = np.zeros((x1 - x0) * h + 1, np.int32)  # the columns of the part alone
    ends = np.clip(np.cumsum(mask_counts) - x0 * h, 0, len(step) - 1)
    np.add.at(step, ends[0::2][: len(ends) // 2], 1)
    np.add.at(step, ends[1::2], -1)
    return (np.cumsum(step)[:-1] > 0).reshape(x1 - x0, h).T[y0:y1], x0, y0


def _inner(mask_counts, h: int, w: int, n: int) -> list[dict]:
    """The n innermost pixels, one after the other: each one found is then outside."""
    found = _window(mask_counts, h, w)
    if found is None:
        return []
    part, x0, y0 = found
    part, out = part.copy(), []
    for _ in range(n):
        far = squared_distance(part)
        y, x = np.unravel_index(int(far.argmax()), far.shape)
        out.append({"x": int(x) + x0, "y": int(y) + y0})
        part[y, x] = False
        if not part.any():
            break
    return out


def _boxes(counts: pa.Array, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners x0, y0, x1, y1 of masks, and which are one filled box that touches no border."""
    (start, end), base = runs._spans(counts)
    row = np.searchsorted(base, start, "right") - 1
    some, first, n = np.unique(row, return_index=True, return_counts=True)
    corners, plain = np.zeros((len(h), 4), np.int64), np.zeros(len(h), bool)
    if len(some):
        tall = h[some]
        x0, y0 = np.divmod(start[first] - base[some], tall)
        size = (end - start)[first]
        place = np.arange(len(row)) - np.repeat(first, n)
        regular = (end - start == np.repeat(size, n)) & (start == np.repeat(start[first], n) + place * h[row])
        corners[some] = np.stack([x0, y0, x0 + n, y0 + size], axis=1)
        plain[some] = np.logical_and.reduceat(regular, first) & (x0 > 0) & (y0 > 0) & (x0 + n < w[some]) & (y0 + size < tall)
    return corners, plain


@F.arrow_udf(T.ArrayType(_POINT))
def inner_points(counts: pa.Array, h: pa.Array, w: pa.Array, n: pa.Array) -> pa.Array:
    """The n innermost pixels of a mask, rows first among equal ones. A box's first one stands as far from its left and upper side as its shorter side allows."""

    def work(counts: pa.Array, *sizes: pa.Array) -> pa.Array:
        tall, wide, most = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in sizes)
        corners, plain = _boxes(counts, tall, wide)
        plain &= most == 1
        deep = (np.minimum(corners[:, 2] - corners[:, 0], corners[:, 3] - corners[:, 1]) + 1) // 2 - 1
        own = np.stack([corners[:, 0] + deep, corners[:, 1] + deep], axis=1)
        other = {int(k): _inner(counts[int(k)].as_py(), int(tall[k]), int(wide[k]), int(most[k])) for k in np.flatnonzero(~plain)}
        size = np.ones(len(tall), np.int64)
        for k, found in other.items():
            size[k] = len(found)
        ends = np.cumsum(size)
        out = np.zeros((int(size.sum()), 2), np.int64)
        out[(ends - 1)[plain]] = own[plain]
        for k, found in other.items():
            out[ends[k] - len(found) : ends[k]] = [(p["x"], p["y"]) for p in found] or np.zeros((0, 2))
        points = pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), points)

    return runs._whole(work, counts, h, w, n)


@F.pandas_udf(_ERROR)
def error_centre(truth: pd.Series, found: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """The innermost pixel of what was missed (label 1), if it lies deeper than that of what was found in excess (label 0)."""
    rows = []
    for t, f, a, b in zip(truth, found, h, w, strict=True):
        own, other = masks.decode(t, int(a), int(b)), masks.decode(f, int(a), int(b))
        missed, excess = (squared_distance(np.pad(x, 1)) for x in (own & ~other, other & ~own))
        label = int(missed.max() > excess.max())
        far = missed if label else excess
        y, x = np.unravel_index(int(far[1:-1, 1:-1].argmax()), own.shape)
        rows.append((int(x), int(y), label))
    return pd.DataFrame(rows, columns=["x", "y", "label"])


# ---- rasters


def raster(polygons: list, h: int, w: int) -> np.ndarray:
    """Pixels whose centre lies inside an odd number of the polygons' borders to its right; polygons are flat lists x, y, x, y, ..."""
    out = np.zeros((h, w), bool)
    cx, cy = np.arange(w) + 0.5, np.arange(h) + 0.5
    for flat in polygons:
        p = np.asarray(flat, float).reshape(-1, 2)
        inside = np.zeros((h, w), bool)
        for (xa, ya), (xb, yb) in zip(p, np.roll(p, -1, axis=0), strict=True):
            rows = np.flatnonzero((ya > cy) != (yb > cy))
            if len(rows):
                cross = xa + (cy[rows] - ya) * (xb - xa) / (yb - ya)
                inside[rows] ^= cx[None, :] < cross[:, None]
        out |= inside
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def polygon_mask(polygons: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Run lengths of the union of polygons."""
    return pd.Series([masks.encode(raster(p, int(a), int(b))) for p, a, b in zip(polygons, h, w, strict=True)])


def without_specks(mask: np.ndarray, most: int, holes: bool = True, specks: bool = True) -> np.ndarray:
    """Holes of up to `most` pixels filled; then parts of up to `most`, and of half the mask at most, removed."""
    m = np.asarray(mask, bool).copy()
    if most <= 0:
        return m
    for on, limit in ((False, lambda: most), (True, lambda: min(most, int(m.sum()) // 2))):
        if holes if not on else specks:
            bound, labels = limit(), masks.components(m == on)
            small = np.bincount(labels.ravel()) <= bound
            small[0] = False
            m[small[labels]] = not on
    return m


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def cleaned_mask(counts: pd.Series, h: pd.Series, w: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([masks.encode(without_specks(masks.decode(c, int(a), int(b)), int(k))) for c, a, b, k in zip(counts, h, w, most, strict=True)])
