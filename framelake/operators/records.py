"""Records of annotations, results and queries: checks, numbering, nesting and un-nesting, remapping, sampling of stages.

Tables are images(image_id, video_id, frame, file_name), annotations(image_id, category_id, track_id, bbox as array x y w h, area), results of the same form, and queries
(image or video, phrase, inputs). Checks fail the job with an error that names what is missing; they add no action of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.chance import one_of, uniform

RANGE = 4096


def numbered(df: DataFrame, name: str, key: str, *order: str, first: int = 1) -> DataFrame:
    """df with a gapless number from `first` in the order of a whole-number key >= 0, then `order`. Rows are numbered within ranges of the key, ranges within ranges of
    ranges, so the one unpartitioned window sees a row for RANGE * RANGE keys.

    Rows and the counts of ranges come from the same ranked rows: all columns take part in the ranks (which settles ties too), and neither ranges nor blocks are ever null (else joins would
    filter one of them), so both need the same of df, and it is computed and shuffled once. Columns that have no order (maps) can't take part; with them df is computed twice.
    """
    rest = [c for c in df.columns if c not in (key, *order) and "map<" not in df.schema[c].dataType.simpleString()]
    part = lambda c: F.coalesce(F.floor(F.col(c) / RANGE), F.lit(-1).cast("long"))
    ranged = df.withColumn("_range", part(key)).withColumn("_rank", F.row_number().over(Window.partitionBy("_range").orderBy(key, *order, *rest)))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("_range").agg(F.max("_rank").alias("n")).withColumn("_block", part("_range"))
    blocks = counts.groupBy("_block").agg(F.sum("n").alias("n")).withColumn("_start", before("n", Window.orderBy("_block"))).drop("n")
    starts = counts.withColumn("_in", before("n", Window.partitionBy("_block").orderBy("_range"))).join(blocks, "_block").select("_range", (F.col("_start") + F.col("_in")).alias("_before"))
    return ranged.join(starts, "_range").withColumn(name, (F.col("_before") + F.col("_rank") - 1 + first).cast("long")).drop("_range", "_rank", "_before")


def required(df: DataFrame, table: DataFrame, on: Sequence[str], what: str) -> DataFrame:
    """df joined to a table in which all its keys must stand: a key that is missing fails the job."""
    found = df.join(table.withColumn("_there", F.lit(True)), list(on), "left")
    said = F.concat(F.lit(f"no {what} for "), F.concat_ws(", ", *[F.col(c).cast("string") for c in on]))
    return found.withColumn("_there", F.when(F.col("_there"), True).otherwise(F.raise_error(said).cast("boolean"))).where("_there").drop("_there")


# ---- scans


def phrase_pairs(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """pairs(video_id, category_id, noun_phrase) whose phrase is the name of the category; any other fails the job."""
    named = required(pairs, categories.select(F.col("id").alias("category_id"), "name"), ["category_id"], "category")
    same = F.when(F.col("name") == F.col("noun_phrase"), F.col("noun_phrase")).otherwise(F.raise_error(F.concat(F.lit("phrase and name differ: "), "noun_phrase")))
    return named.withColumn("noun_phrase", same).drop("name")


def frame_queries(pairs: DataFrame, videos: DataFrame) -> DataFrame:
    """A query for each phrase of a video and each of its frames; the stage is the frame's place: videos(video_id, file_names)."""
    frames = videos.select("video_id", F.posexplode("file_names").alias("stage", "file_name"))
    return pairs.join(frames, "video_id").withColumn("stage", F.col("stage").cast("long"))


def media_path(name: Column) -> Column:
    """path and frame of `video@frame`; a name without a frame is an image."""
    frame = F.regexp_extract(name, r"@(\d+)$", 1)
    return F.struct(F.regexp_replace(name, r"@\d+$", "").alias("path"), F.when(frame != "", frame.cast("long")).alias("frame"))


def frame_order(df: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """place, from 0, of each file of a group: by the number at the end of its name if all have one, else by name."""
    number = F.try_to_number(F.nullif(F.regexp_extract(path, r"(\d+)(?:\.[^./]*)?$", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    all_ = F.min(F.col("_n").isNotNull()).over(Window.partitionBy(*keys))
    ordered = df.withColumn("_n", number).withColumn("_n", F.when(all_, F.col("_n")))
    return ordered.withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy("_n", path)) - 1).cast("long")).drop("_n")


def image_timesteps(images: DataFrame, annotations: DataFrame, one_class: bool = True) -> DataFrame:
    """Annotations with the time step of their image in its video, dense from 0 by frame; those of images that are not listed are dropped. one_class: all categories are 1."""
    steps = images.withColumn("t", (F.dense_rank().over(Window.partitionBy("video_id").orderBy("frame")) - 1).cast("long")).select("image_id", "video_id", "t")
    out = annotations.drop("video_id").join(steps, "image_id")
    return out.withColumn("category_id", F.lit(1).cast("long")) if one_class else out


def indexed_tracks(tracks: DataFrame, one_class: bool = False) -> DataFrame:
    """Tracks(video_id, bboxes, areas): missing boxes are zeros, missing areas 0, and area is the mean of all frames'."""
    zeros = F.array(*[F.lit(0.0)] * 4)
    areas = F.transform("areas", lambda a: F.coalesce(a, F.lit(0.0)))
    out = tracks.withColumnRenamed("video_id", "image_id").withColumn("bboxes", F.transform("bboxes", lambda b: F.coalesce(b, zeros))).withColumn("areas", areas)
    out = out.withColumn("area", F.aggregate("areas", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("areas"), F.lit(1)))
    return out.withColumn("category_id", F.lit(-1).cast("long")) if one_class else out


def loaded_results(results: DataFrame, images: DataFrame, *order: str) -> DataFrame:
    """Results(image_id, bbox) with area w * h, which replaces one that was given, iscrowd 0 and id from 1; a result of an unknown image fails the job."""
    known = required(results, images.select("image_id").distinct(), ["image_id"], "image")
    out = known.withColumn("area", F.get("bbox", 2) * F.get("bbox", 3)).withColumn("iscrowd", F.lit(0))
    return numbered(out, "id", "image_id", *order)


def annotations_of_frame(tracks: DataFrame, video: int, frame: int) -> DataFrame:
    """The masks and phrases of one frame, in order of phrase: tracks(video_id, noun_phrase, segmentations)."""
    own = tracks.where(F.col("video_id") == video).withColumn("mask", F.get("segmentations", frame))
    return own.where(F.col("mask").isNotNull()).select("noun_phrase", "mask").orderBy("noun_phrase")


def with_media(ids: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """ids that have at least one file."""
    return ids.join(files.select(key).distinct(), key, "left_semi")


# ---- results and layouts


def predictions_to_rows(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per detection of predictions(keys, boxes as arrays of corners, scores, labels), boxes as x, y, w, h."""
    row = F.posexplode(F.arrays_zip("boxes", "scores", "labels")).alias("rank", "p")
    b = lambda k: F.get("p.boxes", k)
    return predictions.select(*keys, row).select(*keys, F.col("rank").cast("long").alias("rank"), F.col("p.labels").alias("category_id"), F.array(b(0), b(1), b(2) - b(0), b(3) - b(1)).alias("bbox"), F.col("p.scores").alias("score"))


def masks_to_rows(predictions: DataFrame, keys: Sequence[str], height: str, width: str) -> DataFrame:
    """One row per mask of predictions(keys, height, width, masks as run lengths, scores, labels); its area is a share of the image."""
    from framelake.functions.masks import mask_area

    row = F.explode(F.arrays_zip("masks", "scores", "labels")).alias("p")
    return predictions.select(*keys, height, width, row).select(*keys, F.col("p.labels").alias("category_id"), F.col("p.masks").alias("counts"), F.col("p.scores").alias("score"), (mask_area(F.col("p.masks")) / (F.col(height) * F.col(width))).alias("area"))


def tracks_to_images(tracks: DataFrame, images: DataFrame, *order: str) -> DataFrame:
    """A row per track and frame of tracks(video_id, track_id, category_id, score, bboxes, areas): frames without a box, or with an all-zero one, are skipped; the frame's
    image comes from images(image_id, video_id, frame), and a missing one fails the job; an area that is missing or 0 is w * h. Ids go from 1 in order of image."""
    shown = lambda box: box.isNotNull() & F.exists(box, lambda x: x != 0)
    known = images.groupBy("video_id").agg(F.collect_list(F.struct("frame", "image_id")).alias("_images"))
    held = tracks.join(known, "video_id", "left")  # by video, not by frame: tracks that lie by video stay where they are, and boxes are not sent
    frames = F.array_compact(F.transform("bboxes", lambda box, k: F.when(shown(box), k.cast("long"))))
    empty = F.array().cast("array<bigint>")
    missing = F.array_except(F.coalesce(frames, empty), F.coalesce("_images.frame", empty))
    said = F.concat(F.lit("no image for "), F.concat_ws(", ", F.col("video_id").cast("string"), F.get(missing, 0).cast("string")))
    held = held.where(F.when(F.size(missing) == 0, True).otherwise(F.raise_error(said).cast("boolean")))
    long = held.select("video_id", "track_id", "category_id", "score", "bboxes", "areas", F.explode_outer("_images").alias("_i"))  # explode() would filter tracks without images before they are checked
    at = F.when(F.col("_i.frame") < F.size("bboxes"), F.col("_i.frame")).cast("int")
    long = long.select("video_id", "_i.frame", "_i.image_id", "track_id", "category_id", "score", F.get("bboxes", at).alias("bbox"), F.get("areas", at).alias("area")).where(shown(F.col("bbox")))
    area = F.coalesce(F.nullif("area", F.lit(0.0)), F.get("bbox", 2) * F.get("bbox", 3))
    out = long.select("image_id", "video_id", "frame", "track_id", "category_id", "score", "bbox", area.alias("area"))
    return numbered(out, "id", "image_id", "track_id", *order)


def video_tables(annotations: DataFrame) -> DataFrame:
    """Videos with their tracks, each with its annotations in order of frame and its mean area: annotations(video_id, track_id, frame, image_id, area)."""
    row = F.struct("frame", "image_id", "area")
    tracks = annotations.groupBy("video_id", "track_id").agg(F.array_sort(F.collect_list(row)).alias("annotations"), F.avg("area").alias("area"))
    return tracks.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("track_id", "area", "annotations"))).alias("tracks"))


def unique_tracks(annotations: DataFrame) -> DataFrame:
    """Tracks that stand in several videos get a new number in each but the first, from the largest number on."""
    pairs = annotations.select("track_id", "video_id").distinct()
    again = pairs.withColumn("_k", F.row_number().over(Window.partitionBy("track_id").orderBy("video_id"))).where("_k > 1").drop("_k")
    largest = annotations.agg(F.max("track_id").alias("_largest"))
    new = numbered(again, "_n", "track_id", "video_id").join(F.broadcast(largest)).select("track_id", "video_id", (F.col("_largest") + F.col("_n")).alias("_new"))
    return annotations.join(new, ["track_id", "video_id"], "left").withColumn("track_id", F.coalesce("_new", "track_id")).drop("_new")


# ---- remapping and filters


def filled_video_ids(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations without a video take that of their image."""
    known = images.select("image_id", F.col("video_id").alias("_video"))
    return annotations.join(known, "image_id", "left").withColumn("video_id", F.coalesce("video_id", "_video")).drop("_video")


def merged_categories(annotations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Categories that stand for another take its id: aliases(category_id, of)."""
    return annotations.join(aliases.withColumnRenamed("of", "_of"), "category_id", "left").withColumn("category_id", F.coalesce("_of", "category_id")).drop("_of")


def of_categories(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows of known, unknown or distractor categories, as the table of categories says."""
    return rows.join(categories.select("category_id").distinct(), "category_id", "left_semi")


def positive_split(detections: DataFrame, truth: DataFrame) -> DataFrame:
    """Detections whose image has ground truth of their category."""
    return detections.join(truth.select("image_id", "category_id").distinct(), ["image_id", "category_id"], "left_semi")


def with_dummies(evaluated: DataFrame, images: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Every image, those without an evaluation with zeros."""
    return images.select("image_id").distinct().join(evaluated, "image_id", "left").na.fill(0, list(counts))


def class_agnostic(rows: DataFrame, keep: str = "orig_category_id") -> DataFrame:
    """Category 1 for all, the old one beside it, and tracks numbered anew over (video, category, track), from 1 in order of video."""
    tracks = rows.select("video_id", "category_id", "track_id").distinct()
    new = numbered(tracks, "_new", "video_id", "category_id", "track_id")
    out = rows.join(new, ["video_id", "category_id", "track_id"]).withColumn(keep, F.col("category_id"))
    return out.withColumn("category_id", F.lit(1).cast("long")).withColumn("track_id", F.col("_new")).drop("_new")


def dense_relabelled(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A column's values numbered from 0 in order within each group; a value that stands twice in a frame of it fails the job: rows(keys, t, name)."""
    here = Window.partitionBy(*keys).orderBy(name, "t")  # the one order that both need: equal values of a frame stand side by side
    twice = (F.lag(name).over(here) == F.col(name)) & (F.lag("t").over(here) == F.col("t"))
    number = (F.dense_rank().over(Window.partitionBy(*keys).orderBy(name)) - 1).cast("long")
    checked = F.when(F.col("_twice"), F.raise_error(F.lit(f"{name} stands twice in a frame")).cast("long"))
    return rows.withColumn("_twice", twice).withColumn(name, checked.otherwise(number)).drop("_twice")


def text_filtered(queries: DataFrame, phrase: str, excluded: Sequence[str]) -> DataFrame:
    return queries.where(~F.col(phrase).isin(list(excluded)))


def semantic_only(queries: DataFrame, box: str) -> DataFrame:
    """Queries without an input box."""
    return queries.where(F.col(box).isNull())


def without_boxes(queries: DataFrame, box: str) -> DataFrame:
    return queries.withColumn(box, F.lit(None).cast(queries.schema[box].dataType))


def overwritten_text(queries: DataFrame, phrase: str, text: str, p: float, seed: int, *keys: str) -> DataFrame:
    return queries.withColumn(phrase, F.when(uniform(seed, *[F.col(k) for k in keys]) <= p, F.lit(text)).otherwise(F.col(phrase)))


def text_to_visual(queries: DataFrame, phrase: str, targets: str, p: float, seed: int, *keys: str) -> DataFrame:
    """With probability p a query with targets gets the phrase `visual` and one of its targets' boxes as input."""
    by = [F.col(k) for k in keys]
    chosen = F.get(targets, F.floor(uniform(seed + 1, *by) * F.size(targets)).cast("int"))
    visual = (uniform(seed, *by) < p) & (F.size(targets) > 0)
    return queries.withColumn("input_box", F.when(visual, chosen)).withColumn(phrase, F.when(visual, F.lit("visual")).otherwise(F.col(phrase)))


# ---- stages


def kept_stages(queries: DataFrame, keys: Sequence[str], stage: str, kept: Column, backwards: bool = False) -> DataFrame:
    """Queries of the stages that are kept, numbered anew from 0 in order, or in reverse."""
    order = F.col(stage).desc() if backwards else F.col(stage)
    return queries.where(kept).withColumn(stage, (F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))


def tiled(queries: DataFrame, n: int, stage: str) -> DataFrame:
    """A single image's queries as those of n equal frames."""
    return queries.drop(stage).withColumn(stage, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(stage, F.col(stage).cast("long"))


def same_queries_per_frame(queries: DataFrame, keys: Sequence[str], stage: str, place: str, most: int, seed: int) -> DataFrame:
    """At most so many queries of each frame, the same places in all frames, drawn once for the video; frames of different numbers of queries fail the job."""
    sizes = queries.groupBy(*keys, stage).agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.min("_n").alias("_least"), F.max("_n").alias("_most"))
    even = F.when(F.col("_least") == F.col("_most"), True).otherwise(F.raise_error(F.lit("frames differ in their number of queries")).cast("boolean"))
    places = queries.select(*keys, place).distinct().withColumn("_u", uniform(seed, *[F.col(k) for k in [*keys, place]]))
    places = places.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_u", place))).where(F.col("_k") <= most).select(*keys, place)
    return queries.join(sizes.where(even).select(*keys), list(keys), "left_semi").join(places, [*keys, place], "left_semi")


def first_frame_cap(queries: DataFrame, keys: Sequence[str], stage: str, place: str, positive: str, most: int, seed: int) -> DataFrame:
    """At most so many queries, chosen on frame 0 (positive ones first, then drawn) and kept at their place in all frames."""
    first = queries.where(F.col(stage) == 0).withColumn("_u", uniform(seed, *[F.col(k) for k in [*keys, place]]))
    chosen = first.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(positive), "_u", place))).where(F.col("_k") <= most)
    return queries.join(chosen.select(*keys, place), [*keys, place], "left_semi")


# ---- arrays


def padded(df: DataFrame, keys: Sequence[str], values: str, pad) -> DataFrame:
    """Arrays of a group filled up to its longest, and a mask of what was added."""
    longest = F.max(F.size(values)).over(Window.partitionBy(*keys))
    rest = longest - F.size(values)
    return df.withColumn("padding", F.concat(F.transform(values, lambda _: F.lit(False)), F.array_repeat(F.lit(True), rest))).withColumn(values, F.concat(values, F.array_repeat(F.lit(pad), rest)))


def concatenated(a: Column, pad_a: Column, b: Column, pad_b: Column, pad) -> Column:
    """Two right-padded arrays as one: values of a, values of b, then all padding."""
    real = lambda v, m: F.filter(v, lambda _, i: ~F.get(m, i))
    own = F.concat(real(a, pad_a), real(b, pad_b))
    n = F.size(a) + F.size(b)
    return F.struct(F.concat(own, F.array_repeat(F.lit(pad), n - F.size(own))).alias("values"), F.concat(F.array_repeat(F.lit(False), F.size(own)), F.array_repeat(F.lit(True), n - F.size(own))).alias("padding"))


# ---- names


def stem(name: Column) -> Column:
    """A path's last part without its suffix."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"\.[^.]*$", "")


def last_wins(df: DataFrame, keys: Sequence[str], place: str, *values: str) -> DataFrame:
    """Of rows of one key, the last."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), place).alias("_v")).select(*keys, "_v.*")


def served_results(rows: DataFrame, keys: Sequence[str], score: str, mask: str, tie: str, least_length: int = 5) -> DataFrame:
    """Masks of a request, best first, without those whose packed form is too short to be one."""
    own = rows.where(F.length(mask) >= least_length)
    return own.withColumn("rank", (F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)) - 1).cast("long"))


def drawn(values: Sequence, seed: int, *keys: str) -> Column:
    return one_of(list(values), seed, *[F.col(k) for k in keys])


# ---- what of a tracker's output is scored


def without_unjudged(detections: DataFrame, matched: DataFrame, truth: DataFrame, negative: DataFrame, partial: DataFrame) -> DataFrame:
    """Detections(image_id, category_id, dt) without those that match nothing and can't be judged: their category is not known to be absent from the image, and the image
    has no ground truth of it or is not labelled exhaustively for it.

    matched(image_id, dt), truth(image_id, category_id), negative(image_id, category_id) and partial(image_id, category_id) are looked up, each by an equi-join.
    """
    pair = ["image_id", "category_id"]
    mark = lambda df, name, on: df.select(*on).distinct().withColumn(name, F.lit(True))
    out = detections.join(mark(matched, "_m", ["image_id", "dt"]), ["image_id", "dt"], "left").join(mark(truth, "_t", pair), pair, "left").join(mark(negative, "_n", pair), pair, "left").join(mark(partial, "_p", pair), pair, "left")
    judged = F.col("_m").isNotNull() | F.col("_n").isNotNull() | (F.col("_t").isNotNull() & F.col("_p").isNull())
    return out.where(judged).drop("_m", "_t", "_n", "_p")


def scored_tracks(near: DataFrame, assigned: DataFrame, tracks: DataFrame, exhaustive: DataFrame | None = None) -> DataFrame:
    """video_id, category_id and track_id of the tracks that are scored for a category: those near its ground truth, without those that are assigned to ground truth of
    another one, and, where labels are exhaustive, all tracks of the category itself.

    near(video_id, category_id, track_id) and assigned (the same) name the ground truth's category, tracks the predicted one; exhaustive(video_id, category_id).
    """
    mark = lambda df, **marks: df.select("video_id", "category_id", "track_id", *[F.lit(marks.get(c, False)).alias(c) for c in ("near", "assigned", "own")])
    rows = mark(near, near=True).unionByName(mark(assigned, assigned=True))
    if exhaustive is not None:
        rows = rows.unionByName(mark(tracks.join(exhaustive.select("video_id", "category_id").distinct(), ["video_id", "category_id"], "left_semi"), own=True))
    return marked_tracks(rows).where("kept OR own").select("video_id", "category_id", "track_id")


def marked_tracks(rows: DataFrame) -> DataFrame:
    """video_id, category_id, track_id, kept and own of scored_tracks(), once for each: kept for those near the category that no other one is assigned, own for those of a
    category with exhaustive labels. rows(video_id, category_id, track_id, near, assigned, own) with marks; they are shuffled once."""
    each = rows.repartition("video_id", "track_id").groupBy("video_id", "category_id", "track_id").agg(*[F.max(c).alias(c) for c in ("near", "assigned", "own")])
    others = F.count_if("assigned").over(Window.partitionBy("video_id", "track_id")) - F.col("assigned").cast("long")
    return each.withColumn("kept", F.col("near") & (others == 0)).select("video_id", "category_id", "track_id", "kept", "own")
