"""Annotation documents: one JSON object with arrays of images, annotations and categories, as typed tables, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "id BIGINT, file_name STRING, text_input STRING, width INT, height INT, queried_category STRING, is_instance_exhaustive INT, is_pixel_exhaustive INT"
ANNOTATIONS = "id BIGINT, image_id BIGINT, source STRING, area DOUBLE, bbox ARRAY<DOUBLE>, segmentation STRUCT<counts: STRING, size: ARRAY<INT>>, category_id INT, iscrowd INT"
CATEGORIES = "id INT, name STRING"
PREDICTIONS = "image_id BIGINT, category_id INT, bbox ARRAY<DOUBLE>, score DOUBLE, segmentation STRUCT<counts: STRING, size: ARRAY<INT>>, area DOUBLE"


def _part(spark: SparkSession, path: str, name: str, fields: str) -> DataFrame:
    document = spark.read.option("multiLine", True).schema(f"{name} ARRAY<STRUCT<{fields}>>").json(path)
    return document.select(F.inline(name))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return _part(spark, path, "images", IMAGES)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return _part(spark, path, "annotations", ANNOTATIONS)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return _part(spark, path, "categories", CATEGORIES)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rows, or lines of them."""
    return spark.read.option("multiLine", True).schema(PREDICTIONS).json(path)


def images_with_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every image, in order of id, with its annotations as an array, empty where it has none."""
    own = annotations.groupBy(F.col("image_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("id", "bbox", "area", "category_id", "iscrowd"))).alias("annotations"))
    return images.join(own, "id", "left").withColumn("annotations", F.coalesce("annotations", F.array()))


def rounded_predictions(predictions: DataFrame, digits: int = 5) -> DataFrame:
    """Coordinates and scores with so many digits, halves to even."""
    return predictions.withColumn("bbox", F.transform("bbox", lambda v: F.bround(v, digits))).withColumn("score", F.bround("score", digits))


def read_last_row(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """The last line of a file of JSON lines, with the fields that are asked for."""
    lines = spark.read.schema(fields).json(path).select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    return lines.agg(F.max_by("row", "at").alias("row")).select("row.*")


def list_files(spark: SparkSession, folder: str, pattern: str, without: str = "") -> DataFrame:
    """path of the files below a folder whose name fits a glob pattern; without: those whose path holds this text are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path")
    return found.where(~F.col("path").contains(without)) if without else found


def read_text_tracks(spark: SparkSession, path: str, separator: str, columns: Sequence[str], time: str, name: str, crowd: Mapping[str, Sequence[str]] | None = None, names: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Rows of a delimited text file, with `t`, `track` and `ignored`, the latter for rows that hold a crowd value in its column; names replace values of a column."""
    rows = spark.read.csv(path, sep=separator, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).toDF(*columns)
    for column, by in (names or {}).items():
        rows = rows.replace(dict(by), subset=[column])
    ignored = F.lit(False)
    for column, values in (crowd or {}).items():
        ignored = ignored | F.coalesce(F.col(column).isin(list(values)), F.lit(False))
    return rows.withColumn("t", F.col(time).cast("double").cast("long")).withColumn("track", F.col(name).cast("double").cast("long")).withColumn("ignored", ignored)


def wanted_clips(clips: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Clips of a metadata table that are wanted, with their length and the name of the video with its times."""
    own = clips.join(wanted.select(key).distinct(), key, "left_semi")
    return own.withColumn("length", F.col("end_time") - F.col("start_time")).withColumn("video", F.concat_ws("_", "yt_video_id", F.col("start_time").cast("string"), F.col("end_time").cast("string")))


def media_source(width: str, height: str, most: str) -> Column:
    """How an image is fetched: `full` where no limit is known or it is not passed, else `scaled`."""
    limit = F.col(most)
    return F.when(limit.isNull() | F.isnan(limit) | (F.col(width) * F.col(height) <= limit), "full").otherwise("scaled")


def write_table(rows: DataFrame, path: str, *first: str) -> None:
    """Summaries and details as CSV with a header; `first` columns come first, the others by name."""
    rest = sorted(set(rows.columns) - set(first))
    rows.select(*first, *rest).write.mode("overwrite").csv(path, header=True)


def read_table(spark: SparkSession, path: str, fields: str) -> DataFrame:
    return spark.read.schema(fields).csv(path, header=True)


def write_tracks(tracks: DataFrame, path: str, digits: int = 5) -> None:
    """Tracks(video_id, category_id, score, bboxes, segmentations, ...) as JSON lines, one file for each task; coordinates rounded, missing frames null."""
    rounded = F.transform("bboxes", lambda b: F.transform(b, lambda v: F.bround(v, digits)))
    tracks.withColumn("bboxes", rounded).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines, one file for each task."""
    rounded_predictions(predictions).write.mode("overwrite").json(path)
