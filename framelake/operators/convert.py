"""Tracks as parallel arrays and as rows, re-numbering, batch assembly, selection among annotators, running means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rows_to_tracks(rows: DataFrame, keys: Sequence[str], frame: str, values: Sequence[str], length: str) -> DataFrame:
    """One row per track with an array for each value, null where the track misses a frame; `length` names the number of frames, constant within a track."""
    own = rows.groupBy(*keys, length).agg(F.map_from_entries(F.collect_list(F.struct(frame, F.struct(*values)))).alias("_at"))
    frames = F.sequence(F.lit(0).cast("long"), F.col(length) - 1)
    return own.select(*keys, *[F.transform(frames, lambda t: F.try_element_at("_at", t)).getField(v).alias(f"{v}s") for v in values])


def tracks_to_rows(tracks: DataFrame, keys: Sequence[str], arrays: Sequence[str], present: str) -> DataFrame:
    """A row per track and frame at which `present` is not null."""
    zipped = F.arrays_zip(*arrays)
    long = tracks.select(*keys, F.posexplode(zipped).alias("frame", "_v"))
    return long.where(F.col(f"_v.{present}").isNotNull()).select(*keys, F.col("frame").cast("long").alias("frame"), *[F.col(f"_v.{a}").alias(a) for a in arrays])


def track_summaries(rows: DataFrame, keys: Sequence[str], score: str, label: str) -> DataFrame:
    """Mean score, most frequent label (the least of equally frequent ones) and number of frames of each track."""
    votes = rows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.sum(score).alias("s"))
    best = F.max(F.struct(F.col("n"), (-F.col(label)).alias("neg")))
    return votes.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean_score"), (-best["neg"]).alias("label"), F.sum("n").alias("n_frames"))


def dictionary_encoded(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the dense id, from 0 in order, of a column's text; rows without one go. Values are ranked among those of the same first three characters, so the one
    unpartitioned window sees a row for each such beginning."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("_begin", F.substring(column, 1, 3))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = values.groupBy("_begin").agg(F.count("*").alias("n")).withColumn("_before", before).drop("n")
    ranked = values.withColumn("_rank", F.row_number().over(Window.partitionBy("_begin").orderBy(column))).join(starts, "_begin")
    return df.join(ranked.select(column, (F.col("_before") + F.col("_rank") - 1).cast("long").alias(name)), column)


def best_annotator(scores: DataFrame, keys: Sequence[str], annotator: str, score: str) -> DataFrame:
    """The annotator whose score is highest; a null score (nothing to find, nothing found) wins over all, and the first of equal ones stays."""
    value = F.when(F.col(score).isNull(), F.lit(float("inf"))).otherwise(F.col(score))
    best = scores.groupBy(*keys).agg(F.max(F.struct(value.alias("v"), (-F.col(annotator)).alias("neg"))).alias("_b"))
    return best.select(*keys, (-F.col("_b.neg")).alias(annotator), F.when(F.col("_b.v") != float("inf"), F.col("_b.v")).alias(score))


def running_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, weight: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("running_mean", F.sum(F.col(value) * F.col(weight)).over(w) / F.sum(weight).over(w))


def sampled_per_group(df: DataFrame, keys: Sequence[str], n: int, seed: int, *by: str, first: str | None = None) -> DataFrame:
    """At most n rows of each group in the order of the MD5 of the seed and `by`, joined by bars; rows where `first` holds come before the others. The cap is the operator's purpose."""
    order = [F.col(first).desc()] if first else []
    w = Window.partitionBy(*keys).orderBy(*order, F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by])), *by)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")
