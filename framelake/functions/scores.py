"""Column functions for scores and losses of predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def inverse_sigmoid(x: Column, eps: float = 1e-3) -> Column:
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.log(F.greatest(x, F.lit(eps)) / F.greatest(1 - x, F.lit(eps)))


def focal_loss(logit: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(logit)
    cross = -(target * F.log(p) + (1 - target) * F.log(1 - p))
    at_target = p * target + (1 - p) * (1 - target)
    return (alpha * target + (1 - alpha) * (1 - target)) * cross * F.pow(1 - at_target, F.lit(gamma))


def dice_loss(p: Column, target: Column) -> Column:
    """An aggregate over the pixels of a group."""
    return 1 - (2 * F.sum(p * target) + 1) / (F.sum(p) + F.sum(target) + 1)


def soft_target(p: Column, iou: Column, alpha: float = 0.25) -> Column:
    return F.greatest(F.pow(p, F.lit(alpha)) * F.pow(iou, F.lit(1 - alpha)), F.lit(0.01))
