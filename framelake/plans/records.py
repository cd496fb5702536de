"""Queries over records of annotations: images are orders, videos suppliers, tracks parts, phrases brands."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.operators import records

from .views import GT_SQL, OBJECTS_SQL, detections, ground_truth, objects, table

r6 = lambda c: F.round(c, 6)


def _images(spark, d):
    """Images of the test: orders by customer (video), frames by key."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("image_id"), F.col("o_custkey").cast("long").alias("video_id"))
    return o.withColumn("frame", (F.row_number().over(Window.partitionBy("video_id").orderBy("image_id")) - 1).cast("long"))


_IMAGES_SQL = "images AS (SELECT CAST(o_orderkey AS BIGINT) AS image_id, CAST(o_custkey AS BIGINT) AS video_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS frame FROM orders)"


def phrase_frames(spark, d):
    """Each brand of a supplier's lines as a phrase, on each month of the supplier as a frame."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 2").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = li.select(F.col("l_suppkey").cast("long").alias("video_id"), F.substring("p_brand", 7, 2).cast("long").alias("category_id"), F.col("p_brand").alias("noun_phrase")).distinct()
    names = table(spark, d, "part").select(F.substring("p_brand", 7, 2).cast("long").alias("id"), F.col("p_brand").alias("name")).distinct()
    videos = li.select(F.col("l_suppkey").cast("long").alias("video_id"), F.date_format("l_shipdate", "yyyy").alias("f")).distinct().groupBy("video_id").agg(F.array_sort(F.collect_set("f")).alias("file_names"))
    return records.frame_queries(records.phrase_pairs(pairs, names), videos).select("video_id", "stage", "file_name", "category_id", "noun_phrase")


def media_paths(spark, d):
    p = table(spark, d, "pages").withColumn("name", F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("@"), (F.col("page_id") % 50).cast("string"))).otherwise(F.col("url")))
    m = records.media_path(F.col("name"))
    return p.select("page_id", F.sha2(m["path"], 256).alias("path_sha"), m["frame"].alias("frame"), F.sha2(records.stem(F.col("url")), 256).alias("stem_sha"))


def file_frames(spark, d):
    """Files of two folders: one with numbers, one with a name that has none."""
    e = table(spark, d, "events").select((F.col("event_id") % 2).cast("long").alias("folder"), F.col("event_id")).where("event_id < 500 or event_id % 2 = 0")
    e = e.withColumn("path", F.concat(F.lit("v/"), F.when((F.col("folder") == 1) & (F.col("event_id") == 1), F.lit("first")).otherwise((F.col("event_id") * 7 % 1009).cast("string")), F.lit("_"), F.col("event_id").cast("string"), F.when((F.col("folder") == 1) & (F.col("event_id") == 1), F.lit("x")).otherwise(F.lit("")), F.lit(".jpg")))
    return records.frame_order(e, ["folder"], "path").select("folder", "path", "place")


def image_steps(spark, d):
    """Annotations at time steps; images of customers divisible by 3 are not listed."""
    ann = ground_truth(spark, d).select("image_id", "obj", "video_id", "category_id")
    return records.image_timesteps(_images(spark, d).where("video_id % 3 <> 0"), ann).select("image_id", "obj", "video_id", "t", "category_id")


def _tracks(spark, d):
    """Tracks of a customer's videos: the objects' numbers, an array with a place for each image."""
    o = objects(spark, d).join(_images(spark, d).select("image_id", F.col("video_id").alias("video"), "frame"), "image_id")
    own = o.repartition("video").groupBy("video", "obj").agg(F.map_from_entries(F.collect_list(F.struct("frame", F.struct(F.array("x0", "y0", "w", "h").alias("bbox"), (F.col("w") * F.col("h") * (F.col("tax") % 2)).alias("area"))))).alias("at"), F.max(F.round("score", 2)).alias("score"), F.min("category_id").alias("category_id"), F.max("frame").alias("last"))
    at = F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda t: F.try_element_at("at", t))
    return own.select(F.col("video").alias("video_id"), F.col("obj").alias("track_id"), "category_id", "score", F.transform(at, lambda x: x["bbox"]).alias("bboxes"), F.transform(at, lambda x: x["area"]).alias("areas"))


_LONG_SQL = f"""{OBJECTS_SQL}, {_IMAGES_SQL}, long AS (SELECT i.video_id AS video, o.obj, i.frame, o.image_id, o.x0, o.y0, o.w, o.h, o.w * o.h * (o.tax % 2) AS area, round(o.score, 2) AS score, o.category_id FROM objs o JOIN images i USING (image_id)),
    tr AS (SELECT video, obj, max(score) AS score, min(category_id) AS category_id, max(frame) AS last, sum(area) AS areas FROM long GROUP BY ALL)"""


def track_index(spark, d):
    t = records.indexed_tracks(_tracks(spark, d))
    return t.select("image_id", "track_id", F.size("bboxes").cast("long").alias("n_frames"), F.size(F.filter("bboxes", lambda b: F.get(b, 2) == 0)).cast("long").alias("n_zero"), r6(F.col("area")).alias("area"))


def tracks_as_images(spark, d):
    return records.tracks_to_images(_tracks(spark, d), _images(spark, d)).select("id", "image_id", "track_id", "category_id", "score", F.get("bbox", 0).alias("x"), "area")


def loaded_result_rows(spark, d):
    o = detections(spark, d).select("image_id", "obj", F.array("x0", "y0", "w", "h").alias("bbox"), F.lit(-1.0).alias("area"))
    return records.loaded_results(o, _images(spark, d), "obj").select("id", "image_id", "obj", "area", "iscrowd")


def prediction_rows(spark, d):
    """Nested predictions of an image as rows."""
    o = detections(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("obj", F.array("x0", "y0", "x1", "y1").alias("b"), "score", "category_id"))).alias("p"))
    nested = o.select("image_id", F.col("p.b").alias("boxes"), F.col("p.score").alias("scores"), F.col("p.category_id").alias("labels"))
    return records.predictions_to_rows(nested, ["image_id"]).select("image_id", "rank", "category_id", F.get("bbox", 2).alias("w"), F.get("bbox", 3).alias("h"), "score")


def videos_of_tracks(spark, d):
    o = ground_truth(spark, d).join(_images(spark, d).select("image_id", "frame", F.col("video_id").alias("video")), "image_id")
    v = records.video_tables(o.select(F.col("video").alias("video_id"), F.col("category_id").alias("track_id"), "frame", "image_id", (F.col("w") * F.col("h")).alias("area")))
    t = v.select("video_id", F.explode("tracks").alias("t"))
    return t.select("video_id", F.col("t.track_id").alias("track_id"), F.size("t.annotations").cast("long").alias("n"), r6(F.col("t.area")).alias("area"), F.get("t.annotations", 0)["image_id"].alias("first_image"))


def tracks_made_unique(spark, d):
    o = ground_truth(spark, d).where("image_id % 4 = 0").select("image_id", "obj", "video_id", F.col("part").alias("track_id"))
    return records.unique_tracks(o).select("image_id", "obj", "video_id", "track_id")


def remapped_annotations(spark, d):
    """Videos from images where they are missing, aliases of categories, known categories, one class."""
    o = ground_truth(spark, d).select("image_id", "obj", F.col("part").alias("track_id"), "category_id", F.when(F.col("tax") > 2, F.col("video_id")).alias("video_id"))
    o = records.filled_video_ids(o, _images(spark, d))
    aliases = spark.createDataFrame([(5, 1), (6, 2)], "category_id long, of long")
    known = spark.range(4).withColumnRenamed("id", "category_id")
    return records.class_agnostic(records.of_categories(records.merged_categories(o, aliases), known)).select("image_id", "obj", "video_id", "category_id", "orig_category_id", "track_id")


def positive_detections(spark, d):
    """Detections of categories that their image has, counted, and images without any."""
    kept = records.positive_split(detections(spark, d), ground_truth(spark, d)).groupBy("image_id").agg(F.count("*").alias("n"))
    return records.with_dummies(kept, _images(spark, d), ["n"])


def relabelled_tracks(spark, d):
    o = objects(spark, d).withColumn("track", F.col("part") * 8 + F.row_number().over(Window.partitionBy("video_id", "image_id", "part").orderBy("obj")))
    return records.dense_relabelled(o.select(F.col("video_id").alias("seq"), F.col("image_id").alias("t"), "track"), ["seq"], "track").groupBy("seq").agg(F.count("*").alias("n"), (F.max("track") + 1).alias("n_tracks"), F.max("track").alias("last"))  # the numbers have no gaps


def prompted_queries(spark, d):
    """Queries (image, category) after text filters, visual prompts and overwritten phrases."""
    q = ground_truth(spark, d).groupBy("image_id", "category_id").agg(F.array_sort(F.collect_list("x0")).alias("targets")).withColumn("phrase", F.concat(F.lit("c"), F.col("category_id").cast("string")))
    q = records.text_to_visual(records.text_filtered(q, "phrase", ["c3", "c4"]), "phrase", "targets", 0.4, 200, "image_id", "category_id")
    return records.overwritten_text(q, "phrase", "object", 0.1, 210, "image_id", "category_id").select("image_id", "category_id", "phrase", "input_box")


def semantic_queries(spark, d):
    o = objects(spark, d).withColumn("box", F.when(F.col("tax") > 3, F.col("x0")))
    return records.without_boxes(records.semantic_only(o, "box"), "box").groupBy("category_id").agg(F.count("*").alias("n"), F.count("box").alias("n_boxes"))


def _stages(spark, d):
    """Queries of customers' videos: stages are images, places the 5 first statuses of a day's hash."""
    return _images(spark, d).select("video_id", F.col("frame").alias("stage"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("video_id") % 4 + 2)).alias("place")).withColumn("positive", (F.col("video_id") + F.col("place")) % 3 == 0)


_STAGES_SQL = f"{_IMAGES_SQL}, st AS (SELECT video_id, frame AS stage, unnest(range(0, video_id % 4 + 3)) AS place FROM images), s AS (SELECT *, (video_id + place) % 3 = 0 AS positive FROM st)"


def stages_remapped(spark, d):
    q = records.kept_stages(_stages(spark, d), ["video_id"], "stage", F.col("stage") % 3 != 1, backwards=True)
    return q.groupBy("video_id", "stage").agg(F.count("*").alias("n"))


def stages_subsampled(spark, d):
    return records.same_queries_per_frame(_stages(spark, d), ["video_id"], "stage", "place", 2, 300).select("video_id", "stage", "place")


def stages_capped(spark, d):
    return records.first_frame_cap(_stages(spark, d), ["video_id"], "stage", "place", "positive", 3, 310).select("video_id", "stage", "place")


def tiled_images(spark, d):
    r = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("image_id"), F.lit(0).cast("long").alias("stage"))
    return records.tiled(r, 8, "stage")


def padded_sequences(spark, d):
    """Scores of an image's objects, padded within the customer, and joined to those of the next image."""
    o = objects(spark, d).join(_images(spark, d).select("image_id", F.col("video_id").alias("video"), "frame"), "image_id").groupBy("video", "frame").agg(F.array_sort(F.collect_list("tax")).alias("v"))
    p = records.padded(o, ["video"], "v", -1)
    nxt = p.select("video", (F.col("frame") - 1).alias("frame"), F.col("v").alias("v2"), F.col("padding").alias("p2"))
    both = p.join(nxt, ["video", "frame"])
    c = records.concatenated(F.col("v"), F.col("padding"), F.col("v2"), F.col("p2"), -1)
    return both.select("video", "frame", F.array_join(c["values"], ",").alias("joined"), F.size(F.filter(c["padding"], lambda x: x)).cast("long").alias("n_padding"))


def last_sizes(spark, d):
    e = table(spark, d, "events")
    return records.last_wins(e.withColumn("place", F.struct("ts", "event_id")), ["user_id", "event_type"], "place", "value", "event_id").select("user_id", "event_type", F.col("event_id"), r6(F.col("value")).alias("value"))


def served_masks(spark, d):
    o = detections(spark, d).withColumn("mask", F.repeat(F.lit("a"), F.col("tax")))
    return records.served_results(o, ["image_id"], "score", "mask", "obj").select("image_id", "obj", "rank")


def media_ids(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("video_id"))
    return records.with_media(c, _images(spark, d), "video_id")


QUERIES = {
    f.__name__: f
    for f in (
        phrase_frames, media_paths, file_frames, image_steps, track_index, tracks_as_images, loaded_result_rows, prediction_rows, videos_of_tracks, tracks_made_unique, remapped_annotations, positive_detections,
        relabelled_tracks, prompted_queries, semantic_queries, stages_remapped, stages_subsampled, stages_capped, tiled_images, padded_sequences, last_sizes, served_masks, media_ids,
    )
}


def _u(seed: int, *keys: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}|' || {" || '|' || ".join(keys)}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


_IC, _VP = ("image_id", "category_id"), ("video_id", "place")
ORACLE_SQL = {
    "phrase_frames": """WITH li AS (SELECT CAST(l_suppkey AS BIGINT) AS video_id, p_brand, year(l_shipdate) AS y FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2),
        f AS (SELECT video_id, y, CAST(row_number() OVER (PARTITION BY video_id ORDER BY y) - 1 AS BIGINT) AS stage FROM (SELECT DISTINCT video_id, y FROM li))
        SELECT video_id, stage, CAST(y AS VARCHAR) AS file_name, CAST(substr(p_brand, 7, 2) AS BIGINT) AS category_id, p_brand AS noun_phrase FROM (SELECT DISTINCT video_id, p_brand FROM li) JOIN f USING (video_id)""",
    "media_paths": """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN url || '@' || (page_id % 50) ELSE url END AS name FROM pages)
        SELECT page_id, sha256(regexp_replace(name, '@\\d+$', '')) AS path_sha, CAST(nullif(regexp_extract(name, '@(\\d+)$', 1), '') AS BIGINT) AS frame, sha256(regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '')) AS stem_sha FROM p""",
    "file_frames": """WITH e AS (SELECT CAST(event_id % 2 AS BIGINT) AS folder, event_id, CASE WHEN event_id = 1 THEN 'v/first_1x.jpg' ELSE 'v/' || (event_id * 7 % 1009) || '_' || event_id || '.jpg' END AS path FROM events WHERE event_id < 500 OR event_id % 2 = 0)
        SELECT folder, path, CAST(row_number() OVER (PARTITION BY folder ORDER BY CASE WHEN folder = 0 THEN event_id END, path) - 1 AS BIGINT) AS place FROM e""",
    "image_steps": f"""WITH {GT_SQL}, {_IMAGES_SQL} SELECT g.image_id, g.obj, i.video_id, i.frame AS t, CAST(1 AS BIGINT) AS category_id FROM gt g JOIN images i ON g.image_id = i.image_id AND i.video_id % 3 <> 0""",
    "track_index": f"""WITH {_LONG_SQL}, n AS (SELECT video, obj, count(*) AS n FROM long GROUP BY ALL) SELECT t.video AS image_id, t.obj AS track_id, t.last + 1 AS n_frames, t.last + 1 - n AS n_zero, round(t.areas / (t.last + 1), 6) AS area FROM tr t JOIN n USING (video, obj)""",
    "tracks_as_images": f"""WITH {_LONG_SQL} SELECT CAST(row_number() OVER (ORDER BY l.image_id, l.obj) AS BIGINT) AS id, l.image_id, l.obj AS track_id, t.category_id, t.score, l.x0 AS x, CASE WHEN l.area = 0 THEN l.w * l.h ELSE l.area END AS area FROM long l JOIN tr t USING (video, obj)""",
    "loaded_result_rows": f"""WITH {GT_SQL} SELECT CAST(row_number() OVER (ORDER BY image_id, obj) AS BIGINT) AS id, image_id, obj, w * h AS area, 0 AS iscrowd FROM dt""",
    "prediction_rows": f"""WITH {GT_SQL} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY obj) - 1 AS BIGINT) AS rank, category_id, x1 - x0 AS w, y1 - y0 AS h, score FROM dt""",
    "videos_of_tracks": f"""WITH {GT_SQL}, {_IMAGES_SQL} SELECT i.video_id, g.category_id AS track_id, count(*) AS n, round(avg(g.w * g.h), 6) AS area, min(g.image_id) AS first_image FROM gt g JOIN images i ON g.image_id = i.image_id GROUP BY ALL""",
    "tracks_made_unique": f"""WITH {GT_SQL}, o AS (SELECT image_id, obj, video_id, part AS track_id FROM gt WHERE image_id % 4 = 0), k AS (SELECT track_id, video_id, row_number() OVER (PARTITION BY track_id ORDER BY video_id) AS k FROM (SELECT DISTINCT track_id, video_id FROM o)),
        n AS (SELECT track_id, video_id, (SELECT max(track_id) FROM o) + row_number() OVER (ORDER BY track_id, video_id) AS new FROM k WHERE k > 1) SELECT image_id, obj, o.video_id, coalesce(new, o.track_id) AS track_id FROM o LEFT JOIN n USING (track_id, video_id)""",
    "remapped_annotations": f"""WITH {GT_SQL}, {_IMAGES_SQL}, o AS (SELECT g.image_id, g.obj, g.part, CASE g.category_id WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE g.category_id END AS c, CASE WHEN g.tax > 2 THEN g.video_id ELSE i.video_id END AS video_id FROM gt g JOIN images i ON g.image_id = i.image_id)
        SELECT image_id, obj, video_id, CAST(1 AS BIGINT) AS category_id, CAST(c AS BIGINT) AS orig_category_id, CAST(dense_rank() OVER (ORDER BY video_id, c, part) AS BIGINT) AS track_id FROM o WHERE c < 4""",
    "positive_detections": f"""WITH {GT_SQL}, k AS (SELECT image_id, count(*) AS n FROM dt SEMI JOIN gt USING (image_id, category_id) GROUP BY 1) SELECT CAST(o_orderkey AS BIGINT) AS image_id, coalesce(n, 0) AS n FROM orders LEFT JOIN k ON image_id = o_orderkey""",
    "relabelled_tracks": f"""WITH {OBJECTS_SQL}, o AS (SELECT video_id AS seq, part * 8 + row_number() OVER (PARTITION BY video_id, image_id, part ORDER BY obj) AS track FROM objs) SELECT seq, count(*) AS n, count(DISTINCT track) AS n_tracks, count(DISTINCT track) - 1 AS last FROM o GROUP BY 1""",
    "prompted_queries": f"""WITH {GT_SQL}, q AS (SELECT image_id, category_id, list_sort(list(x0)) AS targets FROM gt WHERE category_id NOT IN (3, 4) GROUP BY ALL), v AS (SELECT *, {_u(200, *_IC)} < 0.4 AS visual FROM q)
        SELECT image_id, category_id, CASE WHEN {_u(210, *_IC)} <= 0.1 THEN 'object' WHEN visual THEN 'visual' ELSE 'c' || category_id END AS phrase, CASE WHEN visual THEN targets[CAST(floor({_u(201, *_IC)} * len(targets)) AS INT) + 1] END AS input_box FROM v""",
    "semantic_queries": f"""WITH {OBJECTS_SQL} SELECT category_id, count(*) AS n, CAST(0 AS BIGINT) AS n_boxes FROM objs WHERE tax <= 3 GROUP BY 1""",
    "stages_remapped": f"""WITH {_STAGES_SQL}, k AS (SELECT video_id, dense_rank() OVER (PARTITION BY video_id ORDER BY stage DESC) - 1 AS stage FROM s WHERE stage % 3 <> 1) SELECT video_id, CAST(stage AS BIGINT) AS stage, count(*) AS n FROM k GROUP BY ALL""",
    "stages_subsampled": f"""WITH {_STAGES_SQL}, p AS (SELECT video_id, place FROM (SELECT DISTINCT video_id, place FROM s) QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY {_u(300, *_VP)}, place) <= 2) SELECT video_id, stage, place FROM s SEMI JOIN p USING (video_id, place)""",
    "stages_capped": f"""WITH {_STAGES_SQL}, p AS (SELECT video_id, place FROM s WHERE stage = 0 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY positive DESC, {_u(310, *_VP)}, place) <= 3) SELECT video_id, stage, place FROM s SEMI JOIN p USING (video_id, place)""",
    "tiled_images": "SELECT CAST(n_nationkey AS BIGINT) AS image_id, unnest(range(0, 8)) AS stage FROM nation",
    "padded_sequences": f"""WITH {OBJECTS_SQL}, {_IMAGES_SQL}, o AS (SELECT i.video_id AS video, i.frame, list_sort(list(o.tax)) AS v FROM objs o JOIN images i USING (image_id) GROUP BY ALL), m AS (SELECT *, max(len(v)) OVER (PARTITION BY video) AS m FROM o)
        SELECT a.video, a.frame, array_to_string(list_concat(a.v, b.v) || [-1 FOR x IN range(0, 2 * a.m - len(a.v) - len(b.v))], ',') AS joined, CAST(2 * a.m - len(a.v) - len(b.v) AS BIGINT) AS n_padding FROM m a JOIN m b ON a.video = b.video AND b.frame = a.frame + 1""",
    "last_sizes": """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "served_masks": f"""WITH {GT_SQL} SELECT image_id, obj, CAST(row_number() OVER (PARTITION BY image_id ORDER BY score DESC, obj) - 1 AS BIGINT) AS rank FROM dt WHERE tax >= 5""",
    "media_ids": "SELECT CAST(c_custkey AS BIGINT) AS video_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
}
