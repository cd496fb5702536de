"""Seeded augmentation of datapoints: parameters drawn for each image or datapoint, and what they do to sizes and boxes.

Draws are functions of (seed, keys), so every row of a datapoint that shares its keys shares the draw: keys of the datapoint make it consistent over its images,
keys of the image draw anew for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import boxes
from framelake.functions.chance import normal, one_of, uniform, whole


def flipped_sometimes(box: Column, width, p: float, seed: int, *keys: Column) -> Column:
    """Mirrored with probability p."""
    return F.when(uniform(seed, *keys) < p, boxes.flipped(box, width)).otherwise(box)


def resize_scales(size: int, least: int, rounded: bool = True, step: int = 16) -> list[int]:
    """Short sides to draw from: from `least` up to `size` in steps; rounded down to multiples of the step if asked for."""
    down = lambda x: x // step * step if rounded else x
    return sorted({down(x) for x in range(least, size + 1, step)} | {down(size)})


def fitted_size(width: Column, height: Column, short: Column, most: float | None = None) -> Column:
    """Size with the short side as asked for, or less where the long one would pass `most`; whole numbers."""
    low, high = F.least(width, height), F.greatest(width, height)
    side = short.cast("double") if most is None else F.least(short.cast("double"), most * low / high)
    return F.struct(F.floor(width * side / low + 0.5).cast("long").alias("w"), F.floor(height * side / low + 0.5).cast("long").alias("h"))


def resized(box: Column, width: Column, height: Column, size: Column) -> Column:
    return boxes.scaled(box, size["w"] / width, size["h"] / height)


def random_size(sizes: Sequence[int], seed: int, *keys: Column) -> Column:
    return one_of(list(sizes), seed, *keys)


def scheduled_size(by_epoch: Sequence[tuple[int, Sequence[int]]], epoch: int, seed: int, *keys: Column) -> Column:
    """The sizes of the last (first epoch, sizes) entry that has begun."""
    return one_of(list([sizes for first, sizes in sorted(by_epoch) if first <= epoch][-1]), seed, *keys)


def centre_crop(width: Column, height: Column, crop_w: int, crop_h: int) -> Column:
    """x, y, w, h of the middle, with halves rounded up."""
    at = lambda whole_, part: F.floor((whole_ - part) / 2.0 + 0.5).cast("long")
    return F.struct(at(width, crop_w).alias("x"), at(height, crop_h).alias("y"), F.lit(crop_w).cast("long").alias("w"), F.lit(crop_h).cast("long").alias("h"))


def random_crop(width: Column, height: Column, least: int, most: int, seed: int, *keys: Column, around: Column | None = None) -> Column:
    """x, y, w, h of a crop with sides between least and most, no larger than the image; around: a box that must stay inside, which the crop grows for."""
    w, h = F.least(whole(least, most, seed, *keys), width.cast("long")), F.least(whole(least, most, seed + 1, *keys), height.cast("long"))
    if around is not None:
        w, h = F.greatest(w, F.ceil(boxes.width(around)).cast("long")), F.greatest(h, F.ceil(boxes.height(around)).cast("long"))
    room = lambda side, n: F.greatest(side.cast("long") - n, F.lit(0))
    x, y = F.floor(uniform(seed + 2, *keys) * (room(width, w) + 1)).cast("long"), F.floor(uniform(seed + 3, *keys) * (room(height, h) + 1)).cast("long")
    if around is not None:
        x = F.least(F.greatest(x, F.ceil(around["x1"]).cast("long") - w), F.floor(around["x0"]).cast("long"))
        y = F.least(F.greatest(y, F.ceil(around["y1"]).cast("long") - h), F.floor(around["y0"]).cast("long"))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def crop_box(box: Column, crop: Column) -> Column:
    return boxes.cropped(box, crop["x"], crop["y"], crop["w"], crop["h"])


def jitter_crop(width: Column, height: Column, p: float, scale: tuple[float, float], ratio: tuple[float, float], seed: int, *keys: Column) -> Column:
    """With probability p, a crop of a share of the area (uniform in scale) and an aspect (log-uniform in ratio); else, or where it does not fit, the whole image."""
    area = width * height * (scale[0] + uniform(seed + 1, *keys) * (scale[1] - scale[0]))
    aspect = F.exp(F.lit(ratio[0]).cast("double") * 0 + F.ln(F.lit(ratio[0])) + uniform(seed + 2, *keys) * (F.ln(F.lit(ratio[1])) - F.ln(F.lit(ratio[0]))))
    w, h = F.floor(F.sqrt(area * aspect) + 0.5).cast("long"), F.floor(F.sqrt(area / aspect) + 0.5).cast("long")
    fits = (uniform(seed, *keys) < p) & (w <= width) & (h <= height) & (w > 0) & (h > 0)
    x, y = F.floor(uniform(seed + 3, *keys) * (width - w + 1)).cast("long"), F.floor(uniform(seed + 4, *keys) * (height - h + 1)).cast("long")
    zero = F.lit(0).cast("long")
    full = F.struct(zero.alias("x"), zero.alias("y"), width.cast("long").alias("w"), height.cast("long").alias("h"))
    return F.when(fits, F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))).otherwise(full)


def random_pad(most: int, seed: int, *keys: Column) -> Column:
    """How much is added to the right and below."""
    return F.struct(whole(0, most, seed, *keys).alias("right"), whole(0, most, seed + 1, *keys).alias("below"))


def pad_to_size(width: Column, height: Column, size: int, seed: int | None = None, *keys: Column) -> Column:
    """left, top, right, below that make a square of `size`. With a seed the image stands at a drawn place, and a larger one is an error; without, it stands at the
    top left, and a larger one gets no padding."""
    if seed is None:
        zero = F.lit(0).cast("long")
        rest = lambda side: F.greatest(F.lit(size) - side, F.lit(0)).cast("long")
        return F.struct(zero.alias("left"), zero.alias("top"), rest(width).alias("right"), rest(height).alias("below"))

    def rest(side: Column) -> Column:
        return F.when(side > size, F.raise_error(F.lit(f"an image is larger than {size}")).cast("long")).otherwise((F.lit(size) - side).cast("long"))

    left, top = F.floor(uniform(seed, *keys) * (rest(width) + 1)).cast("long"), F.floor(uniform(seed + 1, *keys) * (rest(height) + 1)).cast("long")
    return F.struct(left.alias("left"), top.alias("top"), (rest(width) - left).alias("right"), (rest(height) - top).alias("below"))


def smaller_if_above(width: Column, height: Column, most: int) -> Column:
    """Size with no side above `most`."""
    high = F.greatest(width, height)
    fit = lambda side: F.when(high > most, F.floor(side * most / high + 0.5)).otherwise(side).cast("long")
    return F.struct(fit(width).alias("w"), fit(height).alias("h"))


def mosaic(p: float, grids: Sequence[int], seed: int, *keys: Column) -> Column:
    """Grid side, target tile and whether tiles are mirrored: with probability p one of the grid sides, else a grid of one. Keys of the video share them over its frames."""
    side = F.when(uniform(seed, *keys) < p, one_of(list(grids), seed + 1, *keys)).otherwise(F.lit(1)).cast("long")
    tile = lambda k: F.floor(uniform(seed + k, *keys) * side).cast("long")
    return F.struct(side.alias("side"), tile(2).alias("row"), tile(3).alias("column"), (uniform(seed + 4, *keys) < 0.5).alias("mirrored"))


def in_tile(box: Column, width: Column, height: Column, tile: Column) -> Column:
    """Where a box comes to stand in its target tile."""
    small = boxes.scaled(box, 1.0 / tile["side"], 1.0 / tile["side"])
    return boxes.shifted(small, width / tile["side"] * tile["column"], height / tile["side"] * tile["row"])


def noisy_box(box: Column, width, height, deviation: float, most: float, least_area: float, seed: int, *keys: Column) -> Column:
    """Corners moved by normal noise of a share of the box's size, each by `most` pixels at most, within the image; as it was if what is left is too small."""

    def moved(name: str, size: Column, bound, k: int) -> Column:
        by = F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), normal(seed + 2 * k, *keys) * deviation * size))
        return F.greatest(F.lit(0.0), F.least(F.lit(float(bound)) if not isinstance(bound, Column) else bound.cast("double"), box[name] + by))

    w, h = boxes.width(box), boxes.height(box)
    new = boxes.box(moved("x0", w, width, 0), moved("y0", h, height, 1), moved("x1", w, width, 2), moved("y1", h, height, 3))
    return F.when((boxes.width(new) > 0) & (boxes.height(new) > 0) & (boxes.area(new) > least_area), new).otherwise(box)


def chosen_branch(branches: Sequence[Column], weights: Sequence[float], seed: int, *keys: Column) -> Column:
    """One of several expressions, drawn by weight."""
    u, total, at = uniform(seed, *keys), float(sum(weights)), 0.0
    out = branches[-1]
    cuts = []
    for branch, weight in zip(branches[:-1], weights[:-1], strict=True):
        at += weight / total
        cuts.append((branch, at))
    for branch, cut in reversed(cuts):
        out = F.when(u < cut, branch).otherwise(out)
    return out


def box_points(box: Column, width, height, noise: float, bound: float, seed: int, *keys: Column) -> Column:
    """The two corners of a box as labelled points (2 top left, 3 bottom right), moved by bounded normal noise of a share of its sides."""

    def corner(x: str, y: str, label: int, k: int) -> Column:
        by = lambda size, n: F.greatest(F.lit(-bound), F.least(F.lit(bound), normal(seed + n, *keys) * noise * size))
        clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(F.lit(float(most - 1)), v))
        return F.struct(clamp(box[x] + by(boxes.width(box), k), width).alias("x"), clamp(box[y] + by(boxes.height(box), k + 2), height).alias("y"), F.lit(label).alias("label"))

    return F.array(corner("x0", "y0", 2, 0), corner("x1", "y1", 3, 4))


def points_in_box(box: Column, n: int, seed: int, *keys: Column) -> Column:
    """n whole points, drawn evenly from a box."""
    side = lambda low, high, k: F.floor(box[low] + uniform(seed + k, *keys) * (box[high] - box[low])).cast("long")
    return F.array(*[F.struct(side("x0", "x1", 2 * k).alias("x"), side("y0", "y1", 2 * k + 1).alias("y")) for k in range(n)])


def geometric_inputs(queries: DataFrame, phrase: str, n_targets: str, box: str, n: int, p_box: float, seed: int, *keys: str) -> DataFrame:
    """points and input_box of queries whose phrase is `geometric` and that have one target: n points of its box, or, with probability p_box, one less and the box."""
    own = (F.col(phrase) == "geometric") & (F.col(n_targets) == 1)
    by = [F.col(k) for k in keys]
    boxed = own & (uniform(seed, *by) < p_box)
    points = points_in_box(F.col(box), n, seed + 1, *by)
    return queries.withColumn("points", F.when(boxed, F.slice(points, 1, n - 1)).when(own, points)).withColumn("input_box", F.when(boxed, F.col(box)))


def shuffled(df: DataFrame, epoch: int, *keys: str) -> DataFrame:
    """df in an order drawn anew for each epoch."""
    return df.withColumn("_u", uniform(epoch, *[F.col(k) for k in keys])).orderBy("_u", *keys).drop("_u")
