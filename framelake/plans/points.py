"""Queries of points and boxes of masks. An object's mask is its box in whole pixels, on an image with room around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import boxes, masks, points
from framelake.functions.chance import uniform
from framelake.operators import suppress

from .detection import _nms_sql
from .views import GT_SQL, HEIGHT, OBJECTS_SQL, WIDTH, detections, objects, table

H, W = HEIGHT + 160, WIDTH + 120
r6 = lambda c: F.round(c, 6)


def _masks(spark, d, of=objects):
    """Corners moved by 8 pixels, so that no mask touches the border; tax 0 gives an empty mask."""
    whole = lambda c: (F.floor(c) + 8).cast("long")
    o = of(spark, d)
    o = o.select("image_id", "obj", "score", "tax", whole("x0").alias("a"), whole("y0").alias("b"), whole(F.col("x0") + F.when(F.col("tax") == 0, 0).otherwise(F.col("w"))).alias("c"), whole(F.col("y0") + F.col("h")).alias("e"))
    return o.withColumn("counts", masks.box_mask("a", "b", "c", "e", F.lit(H), F.lit(W)))


_MASKS_SQL = f"{OBJECTS_SQL}, m AS (SELECT image_id, obj, score, tax, CAST(x0 + 8 AS BIGINT) AS a, CAST(y0 + 8 AS BIGINT) AS b, CAST(x0 + 8 + CASE WHEN tax = 0 THEN 0 ELSE w END AS BIGINT) AS c, CAST(y0 + h + 8 AS BIGINT) AS e FROM objs)"


def inclusive_boxes(spark, d):
    o = _masks(spark, d).withColumn("box", masks.mask_box("counts", F.lit(H)))
    zeros, turned = points.inclusive_box(F.col("box"), F.lit(H), F.lit(W)), points.inclusive_box(F.col("box"), F.lit(H), F.lit(W), "turned")
    return o.select("image_id", "obj", *[F.get(zeros, k).alias(f"z{k}") for k in range(4)], *[F.get(turned, k).alias(f"t{k}") for k in range(4)], points.inner_area(zeros).alias("inner_area"))


def drawn_pixels(spark, d):
    """A pixel drawn evenly from each mask, and whether a place drawn in its image lies on it."""
    o = _masks(spark, d)
    key = [F.col("image_id"), F.col("obj")]
    area = masks.pixels("counts")
    p = points.nth_pixel(F.col("counts"), F.floor(uniform(600, *key) * area), F.lit(H))
    x, y = F.floor(F.col("a") - 10 + uniform(601, *key) * 60).cast("long"), F.floor(F.col("b") - 10 + uniform(602, *key) * 60).cast("long")
    return o.select("image_id", "obj", p["x"].alias("px"), p["y"].alias("py"), points.has_pixel(F.col("counts"), F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0)), F.lit(H)).alias("covered"))


def inner_pixels(spark, d):
    """The innermost pixel of each mask."""
    o = _masks(spark, d).withColumn("p", F.get(points.inner_points("counts", F.lit(H), F.lit(W), F.lit(1)), 0))
    return o.select("image_id", "obj", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def sampled_grids(spark, d):
    """Vectors as grids of 8 by 8, sampled between their cells."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    x, y = uniform(610, F.col("vec_id")), uniform(611, F.col("vec_id"))
    return e.select("vec_id", F.round(points.bilinear(F.col("embedding"), x, y, 8, 8), 6).alias("value"))


def iom_suppression(spark, d):
    """Greedy suppression by the intersection over the smaller box; what goes is marked."""
    o = detections(spark, d)
    kept = suppress.greedy_suppress(o, ["image_id"], 0.3, overlap=boxes.iom).select("image_id", "obj").withColumn("kept", F.lit(True))
    return o.select("image_id", "obj").join(kept, ["image_id", "obj"], "left").select("image_id", "obj", F.coalesce("kept", F.lit(False)).alias("kept"))


def place_measures(spark, d):
    """Similarity of centres, distances of a point to the sides, keypoint bins, relative boxes."""
    o = objects(spark, d).withColumn("box", boxes.from_xywh(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")))
    b, x, y = F.col("box"), F.col("x0") + F.col("tax") * 9 - 10, F.col("y0") + F.col("w") / 2
    dist = points.point_distances(x, y, b)
    bin_ = points.heatmap_bin(x, y, F.col("tax") % 3, b, 14)
    rel = points.relative_box(F.when(F.col("tax") > 3, F.array("x0", "y0", "w", "h")).otherwise(F.array(F.lit(0.5), F.lit(0.25), F.lit(0.1), F.lit(1.0))), F.lit(float(WIDTH)), F.lit(float(HEIGHT)))
    return o.select("image_id", "obj", r6(points.centre_similarity(F.array("x0", "y0"), F.array(x, y), 50.0)).alias("similarity"), *[F.get(dist, k).alias(f"d{k}") for k in range(4)], bin_["bin"].alias("bin"), bin_["valid"].alias("valid"), F.round(F.get(rel, 0), 9).alias("rel_x"), F.round(F.get(rel, 3), 9).alias("rel_h"))


def mask_ioms(spark, d):
    o = _masks(spark, d, detections)
    a, b = o.select("image_id", F.col("obj").alias("o1"), *[F.col(c).alias(f"{c}1") for c in "abce"]), o.select("image_id", F.col("obj").alias("o2"), *[F.col(c).alias(f"{c}2") for c in "abce"])
    p = a.join(b, "image_id").where("o1 < o2")
    i = F.greatest(F.least("c1", "c2") - F.greatest("a1", "a2"), F.lit(0)) * F.greatest(F.least("e1", "e2") - F.greatest("b1", "b2"), F.lit(0))
    s = lambda k: (F.col(f"c{k}") - F.col(f"a{k}")) * (F.col(f"e{k}") - F.col(f"b{k}"))
    return p.withColumn("i", i).where("i > 0").select("image_id", "o1", "o2", r6(points.mask_iom(F.col("i"), s(1), s(2))).alias("iom"), r6(points.mask_iom(F.col("i"), s(1), s(2), 1e-8)).alias("iom_eps"))


QUERIES = {f.__name__: f for f in (inclusive_boxes, drawn_pixels, inner_pixels, sampled_grids, iom_suppression, place_measures, mask_ioms)}


def _u(seed: int, *keys: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}|' || {" || '|' || ".join(keys)}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


_IO = ("image_id", "obj")
_AT = lambda i, j: f"(CASE WHEN {i} BETWEEN 0 AND 7 AND {j} BETWEEN 0 AND 7 THEN CAST(embedding[{i} * 8 + {j} + 1] AS DOUBLE) ELSE 0.0 END)"
ORACLE_SQL = {
    "inclusive_boxes": f"""WITH {_MASKS_SQL} SELECT image_id, obj, {", ".join(f"CASE WHEN c > a THEN {v} ELSE 0 END AS z{k}" for k, v in enumerate(("a", "b", "c - 1", "e - 1")))},
        {", ".join(f"CASE WHEN c > a THEN {v} ELSE {n} END AS t{k}" for k, (v, n) in enumerate((("a", W), ("b", H), ("c - 1", 0), ("e - 1", 0))))}, CASE WHEN c > a THEN (c - 1 - a) * (e - 1 - b) ELSE 0 END AS inner_area FROM m""",
    "drawn_pixels": f"""WITH {_MASKS_SQL}, k AS (SELECT *, CAST(floor({_u(600, *_IO)} * ((c - a) * (e - b))) AS BIGINT) AS k, greatest(CAST(floor(a - 10 + {_u(601, *_IO)} * 60) AS BIGINT), 0) AS x, greatest(CAST(floor(b - 10 + {_u(602, *_IO)} * 60) AS BIGINT), 0) AS y FROM m)
        SELECT image_id, obj, CASE WHEN c > a THEN a + k // (e - b) END AS px, CASE WHEN c > a THEN b + k % (e - b) END AS py, x >= a AND x < c AND y >= b AND y < e AS covered FROM k""",
    "inner_pixels": f"""WITH {_MASKS_SQL} SELECT image_id, obj, CASE WHEN c > a THEN a + (least(c - a, e - b) + 1) // 2 - 1 END AS px, CASE WHEN c > a THEN b + (least(c - a, e - b) + 1) // 2 - 1 END AS py FROM m""",
    "sampled_grids": f"""WITH p AS (SELECT vec_id, embedding, {_u(610, "vec_id")} * 8 - 0.5 AS px, {_u(611, "vec_id")} * 8 - 0.5 AS py FROM embeddings), q AS (SELECT *, CAST(floor(px) AS INT) AS j, CAST(floor(py) AS INT) AS i FROM p), f AS (SELECT *, px - j AS fx, py - i AS fy FROM q)
        SELECT vec_id, round({_AT("i", "j")} * (1 - fx) * (1 - fy) + {_AT("i", "(j + 1)")} * fx * (1 - fy) + {_AT("(i + 1)", "j")} * (1 - fx) * fy + {_AT("(i + 1)", "(j + 1)")} * fx * fy, 6) AS value FROM f""",
    "iom_suppression": _nms_sql(">").replace("(a.w * a.h + b.w * b.h - greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0))", "least(a.w * a.h, b.w * b.h)").replace("SELECT a.image_id, a.obj, a.score FROM", "SELECT a.image_id, a.obj, list_contains(l.kept, a.k) AS kept FROM").replace(" WHERE list_contains(l.kept, a.k)", ""),
    "place_measures": f"""WITH {OBJECTS_SQL}, p AS (SELECT *, x0 + tax * 9 - 10 AS x, y0 + w / 2 AS y FROM objs), k AS (SELECT *, CASE WHEN x = x0 + w THEN 13 ELSE CAST(floor((x - x0) * 14 / w) AS BIGINT) END AS bx, CASE WHEN y = y0 + h THEN 13 ELSE CAST(floor((y - y0) * 14 / h) AS BIGINT) END AS by_ FROM p),
        v AS (SELECT *, bx BETWEEN 0 AND 13 AND by_ BETWEEN 0 AND 13 AND tax % 3 > 0 AS ok FROM k)
        SELECT image_id, obj, round(greatest(0.0, 1 - sqrt((x0 - x) * (x0 - x) + (y0 - y) * (y0 - y)) / 50), 6) AS similarity, x - x0 AS d0, y - y0 AS d1, x0 + w - x AS d2, y0 + h - y AS d3, CASE WHEN ok THEN by_ * 14 + bx ELSE 0 END AS bin, ok AS valid,
            round(CASE WHEN tax > 3 AND greatest(x0, y0, w, h) > 1 THEN x0 / {WIDTH} ELSE 0.5 END, 9) AS rel_x, round(CASE WHEN tax > 3 THEN h / {HEIGHT} ELSE 1.0 END, 9) AS rel_h FROM v""",
    "mask_ioms": f"""WITH {GT_SQL}, m AS (SELECT image_id, obj, CAST(floor(x0) + 8 AS BIGINT) AS a, CAST(floor(y0) + 8 AS BIGINT) AS b, CAST(floor(x0 + CASE WHEN tax = 0 THEN 0 ELSE w END) + 8 AS BIGINT) AS c, CAST(floor(y0 + h) + 8 AS BIGINT) AS e FROM dt),
        p AS (SELECT s.image_id, s.obj AS o1, t.obj AS o2, greatest(least(s.c, t.c) - greatest(s.a, t.a), 0) * greatest(least(s.e, t.e) - greatest(s.b, t.b), 0) AS i, least((s.c - s.a) * (s.e - s.b), (t.c - t.a) * (t.e - t.b)) AS low FROM m s JOIN m t ON s.image_id = t.image_id AND s.obj < t.obj)
        SELECT image_id, o1, o2, round(i / greatest(low, 1), 6) AS iom, round(i / (low + 1e-8), 6) AS iom_eps FROM p WHERE i > 0""",
}

_PIXELS = f"image_id, CAST(least(greatest(floor(x0), 0), {WIDTH}) AS BIGINT) AS x0, CAST(least(greatest(floor(y0), 0), {HEIGHT}) AS BIGINT) AS y0, CAST(least(greatest(floor(x1), 0), {WIDTH}) AS BIGINT) AS x1, CAST(least(greatest(floor(y1), 0), {HEIGHT}) AS BIGINT) AS y1"
ORACLE_SQL["image_semantic_masks"] = f"""WITH {GT_SQL}, k AS (SELECT {_PIXELS} FROM dt),
    xs AS (SELECT image_id, x, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS nx FROM (SELECT image_id, x0 AS x FROM k UNION SELECT image_id, x1 FROM k)), ys AS (SELECT image_id, y, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS ny FROM (SELECT image_id, y0 AS y FROM k UNION SELECT image_id, y1 FROM k)),
    c AS (SELECT DISTINCT k.image_id, x, nx, y, ny FROM k JOIN xs ON xs.image_id = k.image_id AND k.x0 <= x AND nx <= k.x1 JOIN ys ON ys.image_id = k.image_id AND k.y0 <= y AND ny <= k.y1), s AS (SELECT image_id, sum((nx - x) * (ny - y)) AS area FROM c GROUP BY 1)
    SELECT i.image_id, CAST(coalesce(area, 0) AS BIGINT) AS area FROM (SELECT DISTINCT image_id FROM k) i LEFT JOIN s ON s.image_id = i.image_id"""
