"""Queries over track layouts, re-numbering, batch assembly, annotator selection, sampling and embedded JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.operators import convert

from .views import GT_SQL, detections, table

r6 = lambda c: F.round(c, 6)


def _track_rows(spark, d):
    """One detection per (video, track, month): frames of tracks."""
    o = detections(spark, d).withColumn("track", F.col("part") % 9).withColumn("frame", (F.month("day") - 1).cast("long")).withColumn("length", F.lit(12).cast("long"))
    own = o.groupBy("video_id", "track", "frame", "length").agg(F.max(F.struct("score", "x0", "y0", "category_id")).alias("m"))
    return own.select("video_id", "track", "frame", "length", "m.score", "m.x0", "m.y0", "m.category_id")


_TRACKS_SQL = f"""{GT_SQL}, k AS (SELECT video_id, part % 9 AS track, CAST(month(day) - 1 AS BIGINT) AS frame, score, x0, y0, category_id,
    row_number() OVER (PARTITION BY video_id, part % 9, month(day) ORDER BY score DESC, x0 DESC, y0 DESC, category_id DESC) AS r FROM dt),
tracks AS (SELECT video_id, track, frame, score, x0, y0, category_id FROM k WHERE r = 1)"""


def track_layout_round_trip(spark, d):
    t = convert.rows_to_tracks(_track_rows(spark, d), ["video_id", "track"], "frame", ["score", "x0", "y0"], "length")
    return convert.tracks_to_rows(t, ["video_id", "track"], ["scores", "x0s", "y0s"], "x0s").select("video_id", "track", "frame", F.col("scores").alias("score"), F.col("x0s").alias("x0"), F.col("y0s").alias("y0"))


def track_gaps(spark, d):
    t = convert.rows_to_tracks(_track_rows(spark, d), ["video_id", "track"], "frame", ["x0"], "length")
    return t.select("video_id", "track", F.size(F.filter("x0s", lambda v: v.isNull())).cast("long").alias("n_missing"))


def track_labels(spark, d):
    s = convert.track_summaries(_track_rows(spark, d).withColumn("score", F.round("score", 2)), ["video_id", "track"], "score", "category_id")
    return s.select("video_id", "track", r6(F.col("mean_score")).alias("mean_score"), F.col("label").alias("label"), "n_frames")


def batch_text_ids(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return convert.dictionary_encoded(p, "p_name", "text_id").select("p_partkey", "text_id")


def annotator_choice(spark, d):
    e = table(spark, d, "events").withColumn("annotator", F.col("event_id") % 3)
    s = e.groupBy("user_id", "annotator").agg(r6(F.avg(F.round("value", 2))).alias("score"))
    s = s.withColumn("score", F.when((F.col("user_id") + F.col("annotator")) % 11 != 0, F.col("score")))
    return convert.best_annotator(s, ["user_id"], "annotator", "score")


def running_averages(spark, d):
    """Of values in whole cents: sums of whole numbers depend on no order, and the quotient is left as it is, for at any digit it may lie just between two numbers."""
    e = table(spark, d, "events").withColumn("value", F.round(F.col("value") * 100).cast("long")).withColumn("weight", (F.col("event_id") % 4 + 1).cast("long"))
    return convert.running_mean(e, ["user_id"], ["ts", "event_id"], "value", "weight").select("event_id", "running_mean")


def capped_queries(spark, d):
    e = table(spark, d, "events").withColumn("positive", F.col("event_type") == "purchase")
    return convert.sampled_per_group(e, ["user_id"], 5, 11, "event_id", first="positive").select("user_id", "event_id", "positive")


def embedded_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def matching_names(spark, d):
    """Names that a glob pattern fits."""
    return table(spark, d, "part").where(F.col("p_name").rlike(r"^[a-z]* w.*t$")).select("p_partkey", "p_name")


QUERIES = {f.__name__: f for f in (track_layout_round_trip, track_gaps, track_labels, batch_text_ids, annotator_choice, running_averages, capped_queries, embedded_json, matching_names)}

ORACLE_SQL = {
    "capped_queries": """SELECT user_id, event_id, event_type = 'purchase' AS positive FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, md5('11|' || event_id), event_id) <= 5""",
    "track_layout_round_trip": f"WITH {_TRACKS_SQL} SELECT video_id, track, frame, score, x0, y0 FROM tracks",
    "track_gaps": f"WITH {_TRACKS_SQL} SELECT video_id, track, 12 - count(*) AS n_missing FROM tracks GROUP BY ALL",
    "track_labels": f"""WITH {_TRACKS_SQL}, v AS (SELECT video_id, track, category_id, count(*) AS n, sum(round(score, 2)) AS s FROM tracks GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY video_id, track ORDER BY n DESC, category_id) AS r FROM v)
        SELECT video_id, track, round(sum(s) / sum(n), 6) AS mean_score, max(CASE WHEN r = 1 THEN category_id END) AS label, CAST(sum(n) AS BIGINT) AS n_frames FROM b GROUP BY ALL""",
    "batch_text_ids": "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS text_id FROM part",
    "annotator_choice": """WITH m AS (SELECT user_id, event_id % 3 AS annotator, round(avg(round(value, 2)), 6) AS v FROM events GROUP BY user_id, event_id % 3),
        s AS (SELECT user_id, annotator, CASE WHEN (user_id + annotator) % 11 <> 0 THEN v END AS score FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN score IS NULL THEN 1e300 ELSE score END DESC, annotator) AS k FROM s) SELECT user_id, annotator, score FROM r WHERE k = 1""",
    "running_averages": """SELECT event_id, CAST(sum(CAST(round(value * 100) AS BIGINT) * (event_id % 4 + 1)) OVER w AS DOUBLE) / CAST(sum(event_id % 4 + 1) OVER w AS DOUBLE) AS running_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "embedded_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "matching_names": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-z]* w.*t$')",
}
