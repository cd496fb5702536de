"""Matching of predictions to targets at least cost, losses over matched pairs, and what becomes of raw outputs.

Costs are columns of a pair: w_box * L1 of boxes (centre, size) + w_class * class cost - w_giou * GIoU. A group is an image; its predictions and targets are bounded by
what a model emits. Pairs that are not in the table, or that a mask makes invalid, cannot be matched.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import boxes

from .assign import solve

#: Fixed value: the cost of a pair that must not be matched.
NEVER = 1e9


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences of centres and sizes."""
    x, y = boxes.to_cxcywh(a), boxes.to_cxcywh(b)
    return sum((F.abs(x[k] - y[k]) for k in ("cy", "w", "h")), F.abs(x["cx"] - y["cx"]))


def softmax_class_cost(probability: Column) -> Column:
    """probability: of the target's class."""
    return -probability


def focal_class_cost(probability: Column, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-8) -> Column:
    """What it would cost to call it positive, less what it would cost to call it negative."""
    positive = alpha * F.pow(1 - probability, gamma) * -F.ln(probability + eps)
    return positive - (1 - alpha) * F.pow(probability, gamma) * -F.ln(1 - probability + eps)


def binary_focal_cost(logit: Column, giou: Column | None = None, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """As focal, from a logit. giou: if given (the stable form), the probability is scaled by (GIoU + 1) / 2 first."""
    p = 1 / (1 + F.exp(-logit))
    if giou is not None:
        p = p * (giou + 1) / 2
        return -alpha * F.pow(1 - p, gamma) * F.ln(p) + (1 - alpha) * F.pow(p, gamma) * F.ln(1 - p)
    log_p, log_q = -F.log1p(F.exp(-logit)), -F.log1p(F.exp(logit))
    return -alpha * F.pow(1 - p, gamma) * log_p + (1 - alpha) * F.pow(p, gamma) * log_q


def exact_sum(value: Column) -> Column:
    """The sum of values at nine digits, as a whole number of 10^-9: it doesn't depend on the order of the rows."""
    return F.sum(F.round(value * 1e9).cast("long"))


def set_cost(pred: Column, target: Column, class_cost: Column, w_box: float = 1.0, w_class: float = 1.0, w_giou: float = 1.0) -> Column:
    return w_box * l1(pred, target) + w_class * class_cost - w_giou * boxes.giou(pred, target)


def least_cost(pairs: DataFrame, keys: Sequence[str], repeats: int = 1, valid: Column | None = None) -> DataFrame:
    """keys, dt, gt and cost of the assignment of least total cost in each group of pairs(keys, dt, gt, cost): every target has `repeats` predictions as far as there
    are enough, no prediction has two targets. valid: pairs where it is not true are never matched."""

    @F.pandas_udf("array<struct<dt:bigint,gt:bigint,cost:double>>")
    def assigned(groups: pd.Series) -> pd.Series:
        out = []
        for rows in groups:
            dts, gts = (sorted({r[k] for r in rows}) for k in ("dt", "gt"))
            costs = np.full((len(dts), len(gts)), NEVER)
            at_d, at_g = ({x: k for k, x in enumerate(v)} for v in (dts, gts))
            for r in rows:
                costs[at_d[r["dt"]], at_g[r["gt"]]] = r["cost"]
            wide = np.tile(costs, (1, repeats))
            found = [(i, j % len(gts)) for i, j in solve(wide) if wide[i, j] < NEVER]
            out.append([{"dt": dts[i], "gt": gts[j], "cost": costs[i, j]} for i, j in sorted(found)])
        return pd.Series(out)

    cost = F.col("cost") if valid is None else F.when(valid, F.col("cost")).otherwise(F.lit(NEVER))
    row = F.struct(F.col("dt").cast("long").alias("dt"), F.col("gt").cast("long").alias("gt"), cost.cast("double").alias("cost"))
    grouped = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    return grouped.select(*keys, F.explode(assigned("_rows")).alias("_p")).select(*keys, "_p.*")


def best_of_masks(candidates: DataFrame, keys: Sequence[str], iou: str, score: str, name: str) -> DataFrame:
    """Of several masks of an object, that of the highest IoU with its truth; if no mask at all overlaps any truth, that of the highest score. Ties to the first."""
    some = candidates.agg(F.max(F.when(F.col(iou) > 0, 1).otherwise(0)).alias("_some"))
    value = F.when(F.col("_some") > 0, F.col(iou)).otherwise(F.col(score))
    best = candidates.join(F.broadcast(some)).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(value.desc(), name)))
    return best.where("_k = 1").drop("_k", "_some")


def box_losses(matched: DataFrame, keys: Sequence[str], pred: str, target: str, num_boxes: Column) -> DataFrame:
    """L1 and 1 - GIoU of matched pairs, summed and divided by the number of boxes."""
    p, t = F.col(pred), F.col(target)
    return matched.groupBy(*keys).agg(*[(exact_sum(v) / 1e9 / num_boxes).alias(n) for v, n in ((l1(p, t), "loss_bbox"), (1 - boxes.giou(p, t), "loss_giou"))])


def iou_losses(predicted: Column, inter: Column, union: Column, absolute: bool = False) -> Column:
    """Squared (or absolute) error of a predicted IoU; an empty union counts as 1."""
    off = predicted - inter / F.greatest(union, F.lit(1))
    return F.abs(off) if absolute else off * off


def mean_mask_iou(pairs: DataFrame, keys: Sequence[str], inter: str, union: str, target_area: str) -> DataFrame:
    """Sum of IoUs over the number of targets that are not empty; 1 if all are."""
    n = F.sum(F.when(F.col(target_area) > 0, 1).otherwise(0))
    total = exact_sum(F.col(inter) / F.greatest(F.col(union), F.lit(1))) / 1e9
    return pairs.groupBy(*keys).agg(F.when(n == 0, 1.0).otherwise(total / F.greatest(n, F.lit(1))).alias("miou"))


def uncertainty(logit: Column) -> Column:
    return -F.abs(logit)


def uncertain_points(points: DataFrame, keys: Sequence[str], logit: str, name: str, n: int, important: float, seed: int) -> DataFrame:
    """n points of each group: a share `important` of them the most uncertain ones (equal ones by name), the rest drawn among the others."""
    from framelake.functions.chance import uniform

    n_sure = int(n * important)
    by_need = F.row_number().over(Window.partitionBy(*keys).orderBy(uncertainty(F.col(logit)).desc(), name))
    ranked = points.withColumn("_k", by_need).withColumn("_u", F.when(F.col("_k") > n_sure, uniform(seed, *[F.col(k) for k in [*keys, name]])))
    return ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce("_u", F.lit(-1.0)), "_k"))).where(F.col("_r") <= n).withColumn("certain", F.col("_k") > n_sure).drop("_k", "_u", "_r")


def memory_score(object_logit: Column, iou: Column) -> Column:
    """Positive confidence in the object times its mask's IoU, to be averaged over objects."""
    return F.greatest(2 / (1 + F.exp(-object_logit)) - 1, F.lit(0.0)) * iou


# ---- raw outputs


def probability(logit: Column, presence_logit: Column | None = None) -> Column:
    p = 1 / (1 + F.exp(-logit))
    return p if presence_logit is None else p / (1 + F.exp(-presence_logit))


def processed_boxes(outputs: DataFrame, logits: str, box: str, width: Column, height: Column, threshold: float, presence: str | None = None, label: int | None = None) -> DataFrame:
    """score, label and absolute corners of outputs whose best class is above the threshold: logits as an array over classes, box as centre and size in shares of the image.

    label: one that replaces the class. Equal classes: the first.
    """
    best = F.array_max(logits)
    score = probability(best, None if presence is None else F.col(presence))
    b = boxes.from_cxcywh(F.col(f"{box}.cx"), F.col(f"{box}.cy"), F.col(f"{box}.w"), F.col(f"{box}.h"))
    own = (F.array_position(F.col(logits), best) - 1).cast("long") if label is None else F.lit(label).cast("long")
    return outputs.withColumn("score", score).withColumn("label", own).withColumn("out", boxes.scaled(b, width, height)).where(F.col("score") > threshold)


def best_per_track(rows: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """The best mask of each (media, object, frame)."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).where("_k = 1").drop("_k")


# ---- pixels and objects


def pixel_owners(pixels: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    """Of the objects that claim a pixel, the one of highest score; ties to the least name."""
    return pixels.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), name))).where("_k = 1").drop("_k")


def shrunk(before: Column, after: Column, threshold: float = 0.3) -> Column:
    """A mask of which less than the threshold is left is to be suppressed."""
    return after / F.greatest(before, F.lit(1)) < threshold


def remaining_areas(rects: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    """area and left of each object of rects(keys, name, score, x0, y0, x1, y1 as whole pixels): how much of it remains if every pixel goes to its best object.

    Native: a group's objects, best first, are one array; from each goes what the better ones that meet it cover of it, in strips between their sides.
    """
    rest = [c for c in rects.columns if c not in keys]
    row = F.struct(F.col(score).isNull().alias("_none"), (-F.col(score)).alias("_neg"), F.col(name).alias("_name"), F.struct(*rest).alias("own"))
    each = rects.groupBy(*keys).agg(F.sort_array(F.collect_list(row))["own"].alias("_all")).select(*keys, F.posexplode("_all").alias("_k", "_r"), "_all")
    meets = lambda r, o: (o["x0"] < r["x1"]) & (r["x0"] < o["x1"]) & (o["y0"] < r["y1"]) & (r["y0"] < o["y1"])
    most, least = F.greatest, F.least
    r = F.col("_r")
    cut = lambda o: F.struct(*[f(o[c], r[c]).cast("long").alias(c) for c, f in (("y0", most), ("y1", least), ("x0", most), ("x1", least))])
    better = F.transform(F.filter("_all", lambda o, i: (i < F.col("_k")) & meets(r, o)), cut)
    each = each.select(*keys, "_r", F.sort_array(better).alias("_b"))
    sides = F.sort_array(F.array_distinct(F.concat(F.col("_b.x0"), F.col("_b.x1"))))
    zero = F.lit(0).cast("long")
    step = lambda s, o: F.struct(F.greatest(s["to"], o["y1"]).alias("to"), (s["sum"] + F.greatest(o["y1"] - F.greatest(o["y0"], s["to"]), zero)).alias("sum"))
    start = F.struct(F.get("_b", 0)["y0"].alias("to"), zero.alias("sum"))
    high = lambda a, b: F.aggregate(F.filter("_b", lambda o: (o["x0"] <= a) & (o["x1"] >= b)), start, step, lambda s: s["sum"])
    strips = F.zip_with(F.slice("_sides", 1, F.size("_sides") - 1), F.slice("_sides", 2, F.size("_sides") - 1), lambda a, b: (b - a) * high(a, b))
    one = F.get("_b", 0)
    covered = F.when(F.size("_b") == 0, zero).when(F.size("_b") == 1, (one["x1"] - one["x0"]) * (one["y1"] - one["y0"])).otherwise(F.aggregate(strips, zero, lambda s, v: s + v))
    area = (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    left = F.when((r["x1"] > r["x0"]) & (r["y1"] > r["y0"]), area - covered).otherwise(F.lit(0))
    return each.withColumn("_sides", F.when(F.size("_b") > 1, sides)).select(*keys, *[r[c].alias(c) for c in rest], area.alias("area"), left.alias("left"))
