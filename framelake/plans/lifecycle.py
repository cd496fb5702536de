"""Queries of what a tracker decides: events are frames of objects (types) in sessions (users), orders logs of actions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import lifecycle, sequences
from framelake.streaming import tracker

from .tracking import _FRAMES_SQL, _frames
from .views import GT_SQL, HEIGHT, WIDTH, detections, table


def _scored(spark, d):
    return _frames(spark, d).join(table(spark, d, "events").select("event_id", F.round("value", 2).alias("score")), "event_id")


_SCORED_SQL = f"{_FRAMES_SQL}, sc AS (SELECT f.*, round(e.value, 2) AS score FROM frames f JOIN events e USING (event_id))"


def memory_of_frames(spark, d):
    return lifecycle.memory_frames(_scored(spark, d), ["session", "object"], "score", 10.0, 3, 4).select("session", "object", "frame", "memory")


def memory_kept(spark, d):
    """Memory without that around purchases of the session."""
    s = _scored(spark, d).where("object <> 'purchase'")
    inputs = _scored(spark, d).where("object = 'purchase' and frame % 5 = 0").select("session", "frame")
    return lifecycle.without_memory_around(s.select("session", "frame", "object"), inputs, ["session"], 2).groupBy("session", "object").agg(F.count("*").alias("n"), F.sum("frame").alias("frames"))


def duplicates_removed(spark, d):
    """Categories of a customer's images as objects, the status of the line as the detection that they share."""
    o = detections(spark, d).select((F.col("image_id") % 40).alias("session"), (F.col("image_id") / 40).cast("long").alias("frame"), F.col("rf").alias("det"), F.col("category_id").alias("object")).distinct()
    births = o.groupBy("session", "object").agg(F.min("frame").alias("born"))
    return lifecycle.duplicate_removals(o, births, ["session"], 12, 2)


def objects_planned(spark, d):
    o = detections(spark, d).select("image_id", F.col("obj").alias("det"), "score", "x0")
    known = table(spark, d, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").cast("long").alias("image_id"), (F.col("o_orderkey") % 4).cast("long").alias("n_objects"), (F.col("o_orderkey") % 9).cast("long").alias("largest"))
    return lifecycle.planned_objects(o, known, ["image_id"], 4, "score", "det", F.col("x0") < 20).select("image_id", "det", "object")


def outputs_built(spark, d):
    """Tracks (even objects) with reconditioned masks, new objects (odd ones), without hidden ones and empty masks."""
    o = detections(spark, d).select("image_id", F.col("obj").alias("object"), F.round("score", 2).alias("object_score"), (F.col("w") * (F.col("tax") % 4)).alias("mask"))
    tracks = o.where("object % 2 = 0")
    pairs = tracks.select("image_id", "object").join(o.select("image_id", F.col("object").alias("det"), F.col("object_score").alias("score"), (F.col("mask") + 1000).alias("det_mask")), "image_id").withColumn("iou", ((F.col("object") * 3 + F.col("det") * 5) % 10) / 10)
    built = lifecycle.built_outputs(lifecycle.reconditioned(tracks, pairs, ["image_id"], 0.5, 0.6, 0.4), o.where("object % 2 = 1"))
    hidden = o.where("(image_id + object) % 5 = 0").select("image_id", "object")
    return lifecycle.visible_outputs(built, hidden, ["image_id", "object"], F.col("mask")).select("image_id", "object", "mask")


def passes(spark, d):
    s = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("session"), (F.col("n_nationkey") % 7).cast("long").alias("start"), F.lit(9).cast("long").alias("n_frames"))
    return lifecycle.propagation_passes(s, "session", "start", "n_frames")


_TYPES = ["add", "refine", "remove", "propagation_full", "propagation_partial", "propagation_fetch"]


def next_propagations(spark, d):
    o = table(spark, d, "orders").where("o_custkey % 10 <> 0").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    kind = F.get(F.array(*map(F.lit, _TYPES)), (F.col("o_orderkey") % 6).cast("int"))
    actions = o.select(F.col("o_custkey").cast("long").alias("session"), F.col("k").alias("seq"), kind.alias("type"), (F.col("o_orderkey") % 4).cast("long").alias("frame"), F.array((F.col("o_orderkey") % 5).cast("long")).alias("objects"))
    sessions = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("session"), F.lit(4).cast("long").alias("n_frames"))
    return lifecycle.next_propagation(sessions, actions, "session").select("session", "propagation", F.array_join(F.col("objects").cast("array<string>"), ",").alias("objects"))


def outputs_of_sessions(spark, d):
    """The objects of a session's frames; some are removed for good, suppressed in a frame, or unconfirmed in it."""
    f = _frames(spark, d)
    some = lambda every: F.array_sort(F.collect_list(F.when(F.col("event_id") % every == 0, F.col("object"))))
    own = f.groupBy("session", "frame").agg(F.array_sort(F.collect_list("object")).alias("objects"), some(97).alias("removed"), some(11).alias("suppressed"), some(5).alias("unconfirmed"))
    n = F.max("frame").over(Window.partitionBy("session")) + 1
    return own.withColumn("n_frames", n).withColumn("last", F.col("frame") == F.col("n_frames") - 1)


def held_back(spark, d):
    return lifecycle.held_back_outputs(outputs_of_sessions(spark, d), ["session"], 5, 2).withColumn("objects", F.array_join("objects", ","))


def frames_to_plan(spark, d):
    """Boxes in a unit image, on a grid of five places with jitter, so that they meet again in later frames of the video; a third of the frames see objects drift."""
    o = sequences.frame_index(detections(spark, d), ["video_id"], ["day"])
    x, y = F.col("part") % 5 / 5 + F.col("tax") / 200, F.col("category_id") % 2 / 2
    det = F.struct((F.col("image_id") * 10 + F.col("obj")).alias("det"), F.least(F.col("score") / 2 + 0.5, F.lit(1.0)).alias("score"), x.alias("x0"), y.alias("y0"), (x + 0.2).alias("x1"), (y + 0.4).alias("y1"))
    drift = F.array(F.struct(F.lit(0).cast("long").alias("object"), F.lit(0.1).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.3).alias("x1"), F.lit(0.4).alias("y1")))
    rows = o.groupBy(F.col("video_id").alias("session"), "frame").agg(F.array_sort(F.collect_list(det)).alias("detections"))
    return rows.withColumn("frame", F.col("frame").cast("long")).withColumn("tracks", F.when(F.col("frame") % 3 == 2, drift))


def planned_sessions(spark, d):
    """What happens in each frame of a video, by kind."""
    rules = tracker.Rules(near=0.3, strict=0.3, budget=8, delay=12, misses=3, repeats=2, start=4, most=6, recondition_every=4)
    return tracker.plan_sessions(frames_to_plan(spark, d), rules).groupBy("session", "frame", "kind").agg(F.count("*").alias("n"), F.sum("object").alias("objects"))


QUERIES = {f.__name__: f for f in (memory_of_frames, memory_kept, duplicates_removed, objects_planned, outputs_built, passes, next_propagations, held_back, planned_sessions)}

_RUN = "('propagation_full', 'propagation_partial')"
ORACLE_SQL = {
    "memory_of_frames": f"""WITH {_SCORED_SQL}, b AS (SELECT a.session, a.object, a.frame, m.frame AS memory FROM sc a JOIN sc m ON m.session = a.session AND m.object = a.object AND m.frame > 0 AND m.frame < a.frame AND (a.frame - 1 - m.frame) % 3 = 0 AND m.score > 10
            QUALIFY row_number() OVER (PARTITION BY a.session, a.object, a.frame ORDER BY m.frame DESC) <= 3)
        SELECT * FROM b UNION SELECT session, object, frame, frame - 1 FROM sc WHERE frame > 0""",
    "memory_kept": f"""WITH {_SCORED_SQL}, i AS (SELECT session, frame FROM sc WHERE object = 'purchase' AND frame % 5 = 0)
        SELECT session, object, count(*) AS n, CAST(sum(frame) AS BIGINT) AS frames FROM sc s WHERE object <> 'purchase' AND NOT EXISTS (SELECT 1 FROM i WHERE i.session = s.session AND abs(i.frame - s.frame) <= 2) GROUP BY ALL""",
    "duplicates_removed": f"""WITH {GT_SQL}, o AS (SELECT DISTINCT image_id % 40 AS session, image_id // 40 AS frame, rf AS det, category_id AS object FROM dt), b AS (SELECT session, object, min(frame) AS born FROM o GROUP BY ALL),
        a AS (SELECT o.*, born, first_value(object) OVER (PARTITION BY session, frame, det ORDER BY born, object) AS original FROM o JOIN b USING (session, object)),
        p AS (SELECT *, row_number() OVER (PARTITION BY session, original, object ORDER BY frame, det) AS times FROM a WHERE object <> original) SELECT session, object, min(frame) AS removed_at FROM p WHERE times >= 2 AND born > frame - 12 GROUP BY ALL""",
    "objects_planned": f"""WITH {GT_SQL}, r AS (SELECT image_id, obj AS det, CASE WHEN image_id % 3 <> 0 THEN image_id % 4 ELSE 0 END AS n, CASE WHEN image_id % 3 <> 0 THEN image_id % 9 ELSE -1 END AS largest, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, obj) AS k FROM dt WHERE x0 >= 20)
        SELECT image_id, det, CAST(largest + row_number() OVER (PARTITION BY image_id ORDER BY det) AS BIGINT) AS object FROM r WHERE k <= 4 - n""",
    "outputs_built": f"""WITH {GT_SQL}, o AS (SELECT image_id, obj AS object, round(score, 2) AS s, w * (tax % 4) AS mask FROM dt),
        p AS (SELECT t.image_id, t.object, d.mask + 1000 AS det_mask FROM o t JOIN o d ON d.image_id = t.image_id WHERE t.object % 2 = 0 AND t.s > 0.5 AND d.s > 0.4 AND ((t.object * 3 + d.object * 5) % 10) / 10 >= 0.6
              QUALIFY row_number() OVER (PARTITION BY t.image_id, t.object ORDER BY (t.object * 3 + d.object * 5) % 10 DESC, d.object) = 1),
        b AS (SELECT image_id, object, coalesce(det_mask, mask) AS mask FROM o LEFT JOIN p USING (image_id, object)) SELECT * FROM b WHERE mask > 0 AND (image_id + object) % 5 <> 0""",
    "passes": """WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS session, n_nationkey % 7 AS start FROM nation), f AS (SELECT unnest(range(0, 9)) AS frame)
        SELECT session, 'forward' AS pass, CAST(frame - start AS BIGINT) AS step, frame FROM s JOIN f ON frame >= start UNION ALL SELECT session, 'backward', CAST(start - frame AS BIGINT), frame FROM s JOIN f ON frame <= start""",
    "next_propagations": f"""WITH a AS (SELECT CAST(o_custkey AS BIGINT) AS session, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k, {_TYPES}[CAST(o_orderkey % 6 AS INT) + 1] AS type, o_orderkey % 4 AS frame, o_orderkey % 5 AS o FROM orders WHERE o_custkey % 10 <> 0),
        p AS (SELECT *, min(CASE WHEN type LIKE 'propagation%' THEN k END) OVER (PARTITION BY session) AS lastp FROM a),
        l AS (SELECT session, max(type) FILTER (k = 1) AS t1, max(type) FILTER (k = 2) AS t2, max(frame) FILTER (k = 1) AS f1, max(o) FILTER (k = 1) AS o1, string_agg(DISTINCT CAST(o AS VARCHAR), ',' ORDER BY CAST(o AS VARCHAR)) FILTER (type IN ('add', 'refine') AND (lastp IS NULL OR k < lastp)) AS since FROM p GROUP BY 1),
        j AS (SELECT CAST(c_custkey AS BIGINT) AS session, l.*, t1 IN {_RUN} AND NOT (coalesce(t2 IN {_RUN}, false) OR f1 IN (0, 3)) AS again FROM customer LEFT JOIN l ON l.session = c_custkey)
        SELECT session, CASE WHEN t1 IS NULL THEN 'propagation_full' WHEN again THEN t1 WHEN t1 LIKE 'propagation%' THEN 'propagation_fetch' WHEN since IS NOT NULL THEN 'propagation_partial' ELSE 'propagation_fetch' END AS propagation,
            CASE WHEN again THEN CAST(o1 AS VARCHAR) WHEN t1 NOT LIKE 'propagation%' THEN since END AS objects FROM j""",
    "held_back": f"""WITH {_FRAMES_SQL}, o AS (SELECT session, frame, list(object) AS objects, list(object) FILTER (event_id % 97 = 0) AS rem, list(object) FILTER (event_id % 11 = 0) AS sup, list(object) FILTER (event_id % 5 = 0) AS unc FROM frames GROUP BY ALL),
        t AS (SELECT *, max(frame) OVER (PARTITION BY session) AS top, coalesce(lead(frame, 4) OVER (PARTITION BY session ORDER BY frame), max(frame) OVER (PARTITION BY session)) AS released_at FROM o),
        g AS (SELECT session, object, min(frame) AS gone FROM (SELECT session, frame, unnest(rem) AS object FROM o) GROUP BY ALL),
        e AS (SELECT t.session, t.frame, t.released_at, t.top, t.sup, unnest(t.objects) AS object FROM t),
        v AS (SELECT e.*, gone <= released_at OR list_contains(e.sup, e.object) OR (a.frame <= released_at AND list_contains(a.unc, e.object)) AS hidden
              FROM e LEFT JOIN g ON g.session = e.session AND g.object = e.object LEFT JOIN o a ON a.session = e.session AND a.frame = least(e.frame + 2, e.top))
        SELECT session, frame, released_at, coalesce(string_agg(object, ',' ORDER BY object) FILTER (NOT coalesce(hidden, false)), '') AS objects FROM v GROUP BY ALL""",
}
