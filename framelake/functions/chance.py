"""Seeded draws as plain expressions of a row's keys: the same row draws the same value in any run, on any number of tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1), from the first 32 bits of the MD5 of the seed and the keys, joined by bars."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number, of two uniform ones (seed and seed + 1)."""
    return F.sqrt(-2.0 * F.ln(1.0 - uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed + 1, *keys))


def one_of(values: list, seed: int, *keys: Column) -> Column:
    """An element of a list, each equally likely."""
    return F.get(F.array(*map(F.lit, values)), F.floor(uniform(seed, *keys) * len(values)).cast("int"))


def whole(least: int, most: Column | int, seed: int, *keys: Column) -> Column:
    """A whole number from least to most, both included."""
    most = most if isinstance(most, Column) else F.lit(most)
    return F.floor(least + uniform(seed, *keys) * (most - least + 1)).cast("long")
