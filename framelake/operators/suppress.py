"""Suppression, top-k and first-wins de-duplication over groups of scored boxes.

The greedy folds are native: a group's boxes become one array, ordered by score, and an `aggregate` keeps those that no kept box overlaps. A group is an image
or a frame of a video, whose boxes are bounded by what a detector emits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions import boxes


def _folded(df: DataFrame, keys: Sequence[str], threshold: float, strict: bool, overlap, score: str, tie: str, box: Sequence[str]) -> DataFrame:
    """keys, the group's `rows` (neg, tie, box), best first, and those of them that are `kept`."""
    row = F.struct((-F.col(score)).alias("neg"), F.col(tie).alias("tie"), boxes.box(*box).alias("box"))
    ordered = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    beats = (lambda v: v > threshold) if strict else (lambda v: v >= threshold)
    none = F.array().cast("array<struct<neg:double,tie:bigint,box:struct<x0:double,y0:double,x1:double,y1:double>>>")
    kept = F.aggregate("rows", none, lambda kept, r: F.when(F.exists(kept, lambda k: beats(overlap(k["box"], r["box"]))), kept).otherwise(F.concat(kept, F.array(r))))
    return ordered.select(*keys, "rows", kept.alias("kept"))


def greedy_suppress(df: DataFrame, keys: Sequence[str], threshold: float, strict: bool = True, overlap=boxes.iou, score: str = "score", tie: str = "obj", box: Sequence[str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """The rows of df(keys, score, tie, box) that survive greedy suppression, best score first, ties by `tie`.

    strict: a box goes if its overlap with a kept one is above the threshold (as detectors do); else if it reaches it (as evaluations do).
    """
    folded = _folded(df, keys, threshold, strict, overlap, score, tie, box)
    survivors = folded.select(*keys, F.explode("kept").alias("k")).select(*keys, F.col("k.tie").alias(tie))
    return df.join(survivors, [*keys, tie], "left_semi")


def greedy_marked(df: DataFrame, keys: Sequence[str], threshold: float, strict: bool = True, overlap=boxes.iou, score: str = "score", tie: str = "obj", box: Sequence[str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """keys, tie, box (a struct) and kept of each row of df: as greedy_suppress(), but what goes stays in the table, and rows are not joined to their survivors."""
    each = _folded(df, keys, threshold, strict, overlap, score, tie, box).select(*keys, F.col("kept.tie").alias("_kept"), F.explode("rows").alias("r"))
    return each.select(*keys, F.col("r.tie").alias(tie), F.col("r.box").alias("box"), F.array_contains("_kept", F.col("r.tie")).alias("kept"))


def greedy_suppress_pairs(nodes: DataFrame, pairs: DataFrame, keys: Sequence[str], score: str, name: str) -> DataFrame:
    """nodes(keys, name, score) with `kept`: greedy suppression, best score first, where what overlaps too much is listed in pairs(keys, a, b), in either order.

    Suppressed rows stay in the table. A native fold over each group's nodes and their pairs.
    """
    either = pairs.select(*keys, F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).alias("p")).unionByName(pairs.select(*keys, F.struct(F.col("b").cast("long").alias("a"), F.col("a").cast("long").alias("b")).alias("p")))
    beaten_by = either.groupBy(*keys, F.col("p.a").alias(name)).agg(F.collect_set("p.b").alias("by"))
    own = nodes.select(*keys, F.col(name).cast("long").alias(name), score).join(beaten_by, [*keys, name], "left")
    row = F.struct((-F.col(score)).alias("neg"), F.col(name).alias("name"), F.coalesce("by", F.array().cast("array<bigint>")).alias("by"))
    ordered = own.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kept = F.aggregate("rows", F.array().cast("array<bigint>"), lambda kept, r: F.when(F.arrays_overlap(kept, r["by"]), kept).otherwise(F.concat(kept, F.array(r["name"]))))
    survivors = ordered.select(*keys, F.explode(kept).alias(name)).withColumn("kept", F.lit(True))
    return nodes.join(survivors, [*keys, name], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The k first rows of each group; all of `order` together must order a group's rows fully."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")


def first_source(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """All rows of each group that come from its first source; other sources' rows of the group go."""
    first = df.groupBy(*keys).agg(F.min(source).alias("_first"))
    return df.join(first, list(keys)).where(F.col(source) == F.col("_first")).drop("_first")


def with_limit_across_groups(df: DataFrame, keys: Sequence[str], budget: int, held: str, *order: Column) -> DataFrame:
    """New objects, best first, as far as the budget less what the group holds allows."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= F.lit(budget) - F.col(held)).drop("_rank")


def less_recent(pairs: DataFrame, threshold: float, reverse: bool = False) -> DataFrame:
    """Of overlapping tracks (a, b, last_a, last_b, iou), the one that was occluded more recently, if the other was ever occluded (> -1); reversed in time if asked."""
    later_a = F.col("last_a") > F.col("last_b") if not reverse else F.col("last_a") < F.col("last_b")
    later_b = F.col("last_b") > F.col("last_a") if not reverse else F.col("last_b") < F.col("last_a")
    gone = F.when(later_a & (F.col("last_b") > -1), F.col("a")).when(later_b & (F.col("last_a") > -1), F.col("b"))
    return pairs.where(F.col("iou") >= threshold).select(gone.alias("track")).where("track IS NOT NULL").distinct()
