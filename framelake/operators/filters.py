"""Predicates over queries of a datapoint and its objects, and dense numbering of what stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_zero_box(w: Column, h: Column) -> Column:
    """An aggregate: some target of the query has no width or height."""
    return F.max(F.when((w <= 0) | (h <= 0), 1).otherwise(0)) == 1


def empty_target(area: Column, least: float = 1e-6) -> Column:
    return area < least


def exhaustive(instance: Column) -> Column:
    """Unknown does not pass."""
    return F.coalesce(instance, F.lit(False))


def pixel_exhaustive(pixel: Column) -> Column:
    """Unknown passes."""
    return F.coalesce(pixel, F.lit(True))


def invalid_geometric(box: Column, phrase: Column, n_targets: Column) -> Column:
    return box.isNotNull() & (phrase == "geometric") & (n_targets == 0)


def kept_queries(objects: DataFrame, image: str, query: str, most: int, crowd: str) -> DataFrame:
    """Queries (image, query) whose targets are no crowds and no more than `most`, with their number of targets, and a dense number from 0 within the image."""
    targets = objects.where(~F.col(crowd)).groupBy(image, query).agg(F.count("*").alias("n_targets"))
    kept = targets.where(F.col("n_targets") <= most)
    return kept.withColumn("local_id", (F.row_number().over(Window.partitionBy(image).orderBy(query)) - 1).cast("long"))


def used_objects(objects: DataFrame, queries: DataFrame, on: Sequence[str]) -> DataFrame:
    """Objects that some kept query has; the others go with their queries."""
    return objects.join(queries, list(on), "left_semi")


# ---- whole datapoints


def screened(queries: DataFrame, objects: DataFrame, on: Sequence[str], most: int, least_area: float = 1e-6) -> DataFrame:
    """queries with `failed`: the names of the rules, in order, that each query fails.

    queries(on, phrase, box, instance_exhaustive, pixel_exhaustive), objects(on, w, h, area, crowd), where on names a query and the objects it asks for. Rules: `zero_box`
    and `empty_target` (some object without width or height, or smaller than least_area), `too_many` (more than most objects), `crowd` (some object is one),
    `not_exhaustive` (unknown fails), `pixel_not_exhaustive` (unknown passes), `invalid_geometric` (a box prompt without an object).
    """
    some = lambda cond: F.max(F.when(cond, 1).otherwise(0)) == 1
    found = objects.groupBy(*on).agg(any_zero_box(F.col("w"), F.col("h")).alias("_zero"), some(empty_target(F.col("area"), least_area)).alias("_empty"), F.count("*").alias("_n"), some(F.col("crowd")).alias("_crowd"))
    joined = queries.join(found, list(on), "left").na.fill(False, ["_zero", "_empty", "_crowd"]).na.fill(0, ["_n"])
    rules = {
        "zero_box": F.col("_zero"), "empty_target": F.col("_empty"), "too_many": F.col("_n") > most, "crowd": F.col("_crowd"), "not_exhaustive": ~exhaustive(F.col("instance_exhaustive")),
        "pixel_not_exhaustive": ~pixel_exhaustive(F.col("pixel_exhaustive")), "invalid_geometric": invalid_geometric(F.col("box"), F.col("phrase"), F.col("_n")),
    }
    failed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return joined.withColumn("failed", failed).drop("_zero", "_empty", "_n", "_crowd")


def without_queries(queries: DataFrame, drop: Column, datapoint: Sequence[str], order: str, stage: str) -> DataFrame:
    """The queries of each datapoint that stay, with `local_id`, dense from 0 by order, and their stages made contiguous from 0.

    A datapoint that loses all its queries, or all those of stage 0, fails the job when its rows are read: what remains of it would be no datapoint.
    """
    one = Window.partitionBy(*datapoint)
    marked = queries.withColumn("_stays", ~drop)
    kept_first = F.max(F.when(F.col("_stays") & (F.col(stage) == 0), 1).otherwise(0)).over(one)
    said = F.concat(F.lit("no query of stage 0 is left in "), F.concat_ws(", ", *[F.col(c).cast("string") for c in datapoint]))
    checked = marked.withColumn("_ok", F.when(kept_first == 0, F.raise_error(said).cast("boolean")).otherwise(F.lit(True))).where(F.col("_ok") & F.col("_stays"))
    local = (F.row_number().over(one.orderBy(order)) - 1).cast("long")
    return checked.withColumn("local_id", local).withColumn(stage, (F.dense_rank().over(one.orderBy(stage)) - 1).cast("long")).drop("_stays", "_ok")
