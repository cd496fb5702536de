"""What a tracker decides frame by frame, as batch operators over logs of frames: memory to attend to, memory to drop, removals, updates, outputs, and what to propagate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def memory_frames(df: DataFrame, keys: Sequence[str], score: str, threshold: float, stride: int, most: int) -> DataFrame:
    """keys, frame and memory: for each frame after the first, the frame before it, and, going back from there at a stride (frame 0 apart), those whose score is above
    the threshold, `most` - 1 of them at most: df(keys, frame, score).

    Frames of one stride are numbered as far as they are good; a frame looks up the numbers right before its own.
    """
    good = (F.col("frame") > 0) & (F.col(score) > threshold)
    w = Window.partitionBy(*keys, "_lane").orderBy("frame")
    lanes = df.withColumn("_lane", F.col("frame") % stride).withColumn("_n", F.sum(F.when(good, 1).otherwise(0)).over(w))
    numbered = lanes.where(good).select(*keys, "_lane", "_n", F.col("frame").alias("memory"))
    ask = lanes.select(*keys, "_lane", (F.col("frame") + 1).alias("frame"), F.explode(F.sequence(F.greatest(F.col("_n") - most + 2, F.lit(1)), F.greatest(F.col("_n"), F.lit(1)))).alias("_n"))
    before = lanes.select(*keys, (F.col("frame") + 1).alias("frame"), F.col("frame").alias("memory"))
    found = ask.join(numbered, [*keys, "_lane", "_n"]).where("memory < frame").select(*keys, "frame", "memory").unionByName(before).distinct()
    return found.join(df.select(*keys, "frame"), [*keys, "frame"], "left_semi")


def without_memory_around(memory: DataFrame, inputs: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """memory(keys, frame) without what lies within `reach` frames, ends included, of an input(keys, frame). Both meet in ranges of frames."""
    width = reach + 1
    near = inputs.select(*keys, F.col("frame").alias("_at"), F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])).alias("_by")).select(*keys, "_at", (F.floor(F.col("_at") / width) + F.col("_by")).alias("_range"))
    own = memory.withColumn("_range", F.floor(F.col("frame") / width))
    hit = own.join(near, [*keys, "_range"]).where(F.abs(F.col("frame") - F.col("_at")) <= reach).select(*keys, "frame").distinct()
    return memory.join(hit, [*keys, "frame"], "left_anti")


def duplicate_removals(matches: DataFrame, births: DataFrame, keys: Sequence[str], delay: int, needed: int) -> DataFrame:
    """keys, object and removed_at of objects that share a detection with an older one in `needed` frames while younger than `delay` frames.

    matches(keys, frame, det, object), births(keys, object, born). Of the objects of one detection the oldest is the original, the least name among equally old ones.
    """
    aged = matches.join(births, [*keys, "object"])
    first = Window.partitionBy(*keys, "frame", "det").orderBy("born", "object")
    pairs = aged.withColumn("original", F.first("object").over(first)).where(F.col("object") != F.col("original"))
    times = F.row_number().over(Window.partitionBy(*keys, "original", "object").orderBy("frame", "det"))
    due = pairs.withColumn("_times", times).where((F.col("_times") >= needed) & (F.col("born") > F.col("frame") - delay))
    return due.groupBy(*keys, "object").agg(F.min("frame").alias("removed_at"))


def planned_objects(new: DataFrame, known: DataFrame, keys: Sequence[str], budget: int, score: str, tie: str, outside: Column) -> DataFrame:
    """keys, det and object of the new detections that become objects: not at the border, the best ones as far as the budget less the known objects allows, numbered from
    the largest known number on: new(keys, det, score), known(keys, n_objects, largest)."""
    held = new.where(~outside).join(known, list(keys), "left").na.fill(0, ["n_objects"]).na.fill(-1, ["largest"])
    ranked = held.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))).where(F.col("_k") <= F.lit(budget) - F.col("n_objects"))
    return ranked.withColumn("object", (F.col("largest") + F.row_number().over(Window.partitionBy(*keys).orderBy(tie))).cast("long")).drop("_k", "n_objects", "largest")


def reconditioned(tracks: DataFrame, detections: DataFrame, keys: Sequence[str], trust: float, least_iou: float, least_score: float) -> DataFrame:
    """tracks(keys, object, object_score, mask) with `det_mask`: the mask of the confident detection that overlaps the track most, where the track itself is trusted.

    detections(keys, object, iou, score, det, det_mask) are pairs of tracks and detections.
    """
    sure = detections.where((F.col("score") > least_score) & (F.col("iou") >= least_iou))
    best = sure.groupBy(*keys, "object").agg(F.max(F.struct("iou", (-F.col("det")).alias("_d"), "det_mask")).alias("_b"))
    out = tracks.join(best, [*keys, "object"], "left")
    return out.withColumn("det_mask", F.when(F.col("object_score") > trust, F.col("_b.det_mask"))).drop("_b")


def built_outputs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One mask for each object: existing(keys, object, mask, det_mask), of which a reconditioned mask replaces the propagated one, and new(keys, object, mask)."""
    return existing.withColumn("mask", F.coalesce("det_mask", "mask")).drop("det_mask").unionByName(new)


def visible_outputs(outputs: DataFrame, hidden: DataFrame, on: Sequence[str], area: Column) -> DataFrame:
    """Outputs with a mask, without the objects that are removed, suppressed or not confirmed."""
    return outputs.where(area > 0).join(hidden.select(*on).distinct(), list(on), "left_anti")


def propagation_passes(sessions: DataFrame, key: str, start: str, n_frames: str, direction: str = "both") -> DataFrame:
    """key, pass, step and frame of a propagation from a start frame: forward to the end, then backward to frame 0."""
    forward = F.transform(F.sequence(F.col(start), F.col(n_frames) - 1), lambda f, i: F.struct(F.lit("forward").alias("pass"), i.cast("long").alias("step"), f.cast("long").alias("frame")))
    backward = F.transform(F.sequence(F.col(start), F.lit(0), F.lit(-1)), lambda f, i: F.struct(F.lit("backward").alias("pass"), i.cast("long").alias("step"), f.cast("long").alias("frame")))
    both = {"both": F.concat(forward, backward), "forward": forward, "backward": backward}[direction]
    return sessions.select(key, F.explode(both).alias("_p")).select(key, "_p.*")


_RUNS = ("propagation_full", "propagation_partial")


def next_propagation(sessions: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """key, propagation and objects: what a session's next propagation is to do, from its log: sessions(key, n_frames), actions(key, seq, type, frame, objects).

    No log: all objects. After a fetch: fetch. After a full or partial run: fetch, if the action before was one too or it began at an end of the video, else the same
    again for the other direction. Else a partial run of what was added or refined since the last propagation, or a fetch if that is nothing.
    """
    w = Window.partitionBy(key).orderBy(F.desc("seq"))
    ranked = actions.withColumn("_k", F.row_number().over(w)).withColumn("_runs", F.sum(F.when(F.col("type").startswith("propagation"), 1).otherwise(0)).over(w))
    at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    since = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when((F.col("_runs") == 0) & F.col("type").isin("add", "refine"), F.col("objects"))))))
    log = ranked.groupBy(key).agg(at(1, "type").alias("last"), at(2, "type").alias("before"), at(1, "frame").alias("frame"), F.max(F.when(F.col("_k") == 1, F.col("objects"))).alias("same"), since.alias("since"))
    out = sessions.join(log, key, "left")
    at_end = (F.col("frame") == 0) | (F.col("frame") == F.col("n_frames") - 1)
    done = F.coalesce(F.col("before").isin(*_RUNS), F.lit(False)) | F.coalesce(at_end, F.lit(False))
    again = F.col("last").isin(*_RUNS) & ~done
    kind = F.when(F.col("last").isNull(), "propagation_full").when(again, F.col("last")).when(F.col("last").startswith("propagation"), "propagation_fetch").when(F.size("since") > 0, "propagation_partial").otherwise("propagation_fetch")
    objects = F.when(again, F.col("same")).when(~F.col("last").startswith("propagation") & (F.size("since") > 0), F.col("since"))
    return out.select(key, kind.alias("propagation"), objects.alias("objects"))


def held_back_outputs(outputs: DataFrame, keys: Sequence[str], delay: int, look: int) -> DataFrame:
    """keys, frame, released_at and objects of outputs(keys, frame, n_frames, last, objects, removed, suppressed, unconfirmed), whose frames leave late.

    A frame leaves with the one `delay` - 1 frames on, or with the last one; without either it doesn't. It leaves without the objects that were removed until then,
    those suppressed in it, and those unconfirmed `look` frames on, or in the video's last frame, if that frame was there by then. One run for each key.
    """
    in_order, whole = Window.partitionBy(*keys).orderBy("frame"), Window.partitionBy(*keys)
    timed = outputs.withColumn("released_at", F.coalesce(F.lead("frame", max(delay, 1) - 1).over(in_order), F.max(F.when(F.col("last"), F.col("frame"))).over(whole))).where("released_at IS NOT NULL")
    at = F.greatest(F.lit(0), F.least(F.col("frame") + look, F.col("n_frames") - 1)).alias("_at")
    ahead = outputs.select(*keys, F.col("frame").alias("_at"), F.col("unconfirmed").alias("_ahead"))
    gone = outputs.select(*keys, F.explode("removed").alias("_object"), "frame").groupBy(*keys, "_object").agg(F.min("frame").alias("_gone"))
    both = timed.select(*keys, "frame", "released_at", "objects", "suppressed", at).join(ahead, [*keys, "_at"], "left")
    each = both.select(*keys, "frame", "released_at", "suppressed", "_at", "_ahead", F.posexplode_outer("objects").alias("_k", "_object")).join(gone, [*keys, "_object"], "left")
    listed = lambda c: F.coalesce(F.array_contains(c, F.col("_object")), F.lit(False))
    hidden = listed("suppressed") | (listed("_ahead") & (F.col("_at") <= F.col("released_at"))) | F.coalesce(F.col("_gone") <= F.col("released_at"), F.lit(False))
    left = each.groupBy(*keys, "frame", "released_at").agg(F.sort_array(F.collect_list(F.when(~hidden & F.col("_object").isNotNull(), F.struct("_k", "_object")))).alias("_left"))
    return left.select(*keys, "frame", "released_at", F.transform("_left", lambda x: x["_object"]).alias("objects"))
