"""Ordered operators over frames: ranks, strides, nearest frames, runs of matches, object life cycles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "frame") -> DataFrame:
    """Dense frame numbers from 0 within each of keys."""
    return df.withColumn(name, (F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def closest_frames(queries: DataFrame, conditions: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """For each query frame, its k nearest condition frames: the last before it, the first at or after it, then by distance; earlier ones first on ties.

    Condition frames are numbered; a query looks up the k numbers on either side of its own place, which hold all that can be nearest.
    """
    place = Window.partitionBy(*keys).orderBy("frame")
    numbered = conditions.select(*keys, "frame").withColumn("_n", F.row_number().over(place))
    events = conditions.select(*keys, "frame", F.lit(1).alias("_c")).unionByName(queries.select(*keys, "frame", F.lit(0).alias("_c")))
    counted = events.withColumn("_before", F.sum("_c").over(Window.partitionBy(*keys).orderBy("frame", "_c").rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_c = 0")
    ask = counted.select(*keys, F.col("frame").alias("query"), "_before", F.explode(F.sequence(F.col("_before") - k + 1, F.col("_before") + k)).alias("_n"))
    both = ask.join(numbered, [*keys, "_n"])
    group = F.when(F.col("_n") == F.col("_before"), 0).when(F.col("_n") == F.col("_before") + 1, 1).otherwise(2)
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "query").orderBy(group, F.abs(F.col("frame") - F.col("query")), "frame")))
    return ranked.where(F.col("rank") <= k).select(*keys, "query", "frame", F.col("rank").cast("long").alias("rank"))


def strided(df: DataFrame, keys: Sequence[str], n: int, stride: int) -> DataFrame:
    """n frames of each of keys at a stride, lowered where a video is too short for it; videos of fewer than n frames have none."""
    length = F.max("frame").over(Window.partitionBy(*keys)) + 1
    own = F.least(F.lit(stride), F.floor((length - 1) / F.lit(max(1, n - 1))))
    own = F.greatest(own, F.lit(1))
    marked = df.withColumn("_length", length).withColumn("stride", own.cast("long"))
    return marked.where((F.col("_length") >= n) & (F.col("frame") % F.col("stride") == 0) & (F.col("frame") / F.col("stride") < n)).drop("_length")


def confirmed(df: DataFrame, keys: Sequence[str], matched: str, needed: int) -> DataFrame:
    """A run length of consecutive matches up to each frame, and whether `needed` of them have ever stood in a row: confirmation sticks."""
    w = Window.partitionBy(*keys).orderBy("frame")
    island = df.withColumn("_misses", F.sum(F.when(F.col(matched), 0).otherwise(1)).over(w))
    run = F.sum(F.when(F.col(matched), 1).otherwise(0)).over(Window.partitionBy(*keys, "_misses").orderBy("frame"))
    out = island.withColumn("run", run.cast("long"))
    return out.withColumn("confirmed", F.max(F.when(F.col("run") >= needed, 1).otherwise(0)).over(w) == 1).drop("_misses")


#: Frames that are folded at a time.
FOLDED = 256


def kept_alive(df: DataFrame, keys: Sequence[str], matched: str, start: int, most: int, least: int) -> DataFrame:
    """The keep-alive counter of each object after each frame: one up for a match, one down for a miss, clamped after every step.

    Steps compose: any run of them adds a number and clamps between two bounds. Blocks of FOLDED frames are reduced to those three numbers, the blocks of an object to
    their values at the start, and only then is each block walked, so no array holds more than a block's frames.
    """
    up = F.when(F.col(matched), 1).otherwise(-1)
    placed = df.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1) / FOLDED))
    blocks = placed.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(F.struct("frame", up.alias("s")))).alias("_rows"))
    clamp = lambda v, low, high: F.least(high, F.greatest(low, v))
    low, high = F.lit(least), F.lit(most)

    def compose(a, r):
        return F.struct((a["add"] + r["s"]).alias("add"), clamp(a["low"] + r["s"], low, high).alias("low"), clamp(a["high"] + r["s"], low, high).alias("high"))

    one = F.struct(F.lit(0).alias("add"), low.alias("low"), high.alias("high"))
    reduced = blocks.select(*keys, "_block", F.aggregate("_rows", one, compose).alias("f"))
    every = reduced.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_block", "f"))).alias("_f"))
    step = lambda a, r: F.concat(a, F.array(clamp(F.element_at(a, -1) + r["f"]["add"], r["f"]["low"], r["f"]["high"])))
    starts = every.select(*keys, F.posexplode(F.aggregate("_f", F.array(F.lit(start)), step)).alias("_block", "_start")).withColumn("_block", F.col("_block").cast("long"))
    walk = lambda a, r: F.concat(a, F.array(F.struct(r["frame"].alias("frame"), clamp(F.coalesce(F.try_element_at(a, F.lit(-1))["alive"], F.col("_start")) + r["s"], low, high).alias("alive"))))
    walked = blocks.join(starts, [*keys, "_block"]).select(*keys, F.explode(F.aggregate("_rows", F.array().cast("array<struct<frame:bigint,alive:int>>"), walk)).alias("_s"))
    return walked.select(*keys, F.col("_s.frame").alias("frame"), F.col("_s.alive").cast("long").alias("alive"))


def hotstart_removed(df: DataFrame, keys: Sequence[str], matched: str, delay: int, misses: int) -> DataFrame:
    """Objects that are removed while their output is still held back: at least `misses` unmatched frames within `delay` frames of their first one; with the frame at
    which that happens."""
    w = Window.partitionBy(*keys).orderBy("frame")
    born = F.min("frame").over(Window.partitionBy(*keys))
    lost = df.withColumn("born", born).withColumn("lost", F.sum(F.when(F.col(matched), 0).otherwise(1)).over(w))
    return lost.where((F.col("lost") >= misses) & (F.col("born") > F.col("frame") - delay)).groupBy(*keys).agg(F.min("frame").alias("removed_at"))


def least_loaded(df: DataFrame, keys: Sequence[str], order: str, workers: int, loads: DataFrame | None = None) -> DataFrame:
    """keys, item and worker (from 0): items one by one, in order, each to the worker with least load, the first of equal ones. loads(keys, worker, load): what the
    workers of a group have at the start; nothing without a row.

    Each item adds one to a load, so worker w with start load s offers places at loads s, s + 1, ...; item n takes the n-th place by (load, worker), and no item has to
    wait for the one before.
    """
    ranked = df.select(*keys, F.col(order).alias("item"), F.row_number().over(Window.partitionBy(*keys).orderBy(order)).alias("_k"))
    sizes = ranked.groupBy(*keys).agg(F.max("_k").alias("_n"))
    every = sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(workers - 1).cast("long"))).alias("worker"))
    start = every.withColumn("load", F.lit(0).cast("long")) if loads is None else every.join(loads.select(*keys, "worker", "load"), [*keys, "worker"], "left").na.fill(0, ["load"])
    least = start.withColumn("_least", F.min("load").over(Window.partitionBy(*keys)))
    # A worker takes nothing beyond a load that even the least loaded one reaches only with all items.
    places = least.where(F.col("load") < F.col("_least") + F.col("_n")).select(*keys, "worker", F.explode(F.sequence(F.col("load"), F.col("_least") + F.col("_n") - 1)).alias("_at"))
    taken = places.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "worker"))).drop("_at")
    return ranked.join(taken, [*keys, "_k"]).select(*keys, "item", "worker")
