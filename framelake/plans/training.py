"""Queries of matching at least cost, of losses, and of raw outputs. Targets of an image (order) are its first objects, predictions its detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import boxes
from framelake.operators import matching

from .views import GT_SQL, HEIGHT, INTER, UNION, WIDTH, detections, ground_truth, objects

r6 = lambda c: F.round(c, 6)


def _pairs(spark, d):
    """Pairs of an image's detections with its targets, at most half as many as detections; boxes as shares of the image, logits from scores."""
    side = lambda df, name: df.select("image_id", F.col("obj").alias(name), boxes.box(F.col("x0") / WIDTH, F.col("y0") / HEIGHT, F.col("x1") / WIDTH, F.col("y1") / HEIGHT).alias(f"{name}_box"), F.col("score").alias(f"{name}_score"))
    n = detections(spark, d).groupBy("image_id").agg(F.floor(F.count("*") / 2).alias("n"))
    gt = side(ground_truth(spark, d).join(n, "image_id").where("obj < n"), "gt")
    return gt.join(side(detections(spark, d), "dt"), "image_id").withColumn("logit", F.col("dt_score") * 4 - 2)


def _costs(spark, d, kind):
    p = _pairs(spark, d)
    logit, giou = F.col("logit"), boxes.giou(F.col("dt_box"), F.col("gt_box"))
    class_cost = {"plain": matching.softmax_class_cost(matching.probability(logit)), "focal": matching.binary_focal_cost(logit), "stable": matching.binary_focal_cost(logit, giou), "eps": matching.focal_class_cost(matching.probability(logit))}[kind]
    return p.withColumn("cost", matching.set_cost(F.col("dt_box"), F.col("gt_box"), class_cost, 5.0, 2.0, 2.0))


def _totals(matched):
    return matched.groupBy("image_id").agg(F.count("*").alias("n"), r6(F.sum("cost")).alias("total"))


def matched_at_least_cost(spark, d):
    return _totals(matching.least_cost(_costs(spark, d, "plain"), ["image_id"]))


def matched_by_focal_cost(spark, d):
    return _totals(matching.least_cost(_costs(spark, d, "focal"), ["image_id"]))


def matched_with_repeats(spark, d):
    """Two predictions for each target, in the stable focal form."""
    return _totals(matching.least_cost(_costs(spark, d, "stable"), ["image_id"], repeats=2))


def matched_valid_pairs(spark, d):
    """Detections of odd number are not valid."""
    return _totals(matching.least_cost(_costs(spark, d, "eps"), ["image_id"], valid=F.col("dt") % 2 == 0))


def pair_costs(spark, d):
    p = _pairs(spark, d)
    logit, giou = F.col("logit"), boxes.giou(F.col("dt_box"), F.col("gt_box"))
    return p.select("image_id", "gt", "dt", F.round(matching.l1(F.col("dt_box"), F.col("gt_box")), 9).alias("l1"), r6(giou).alias("giou"), r6(matching.binary_focal_cost(logit)).alias("focal"), r6(matching.binary_focal_cost(logit, giou)).alias("stable"), r6(matching.focal_class_cost(matching.probability(logit))).alias("eps_focal"))


def matched_losses(spark, d):
    """Losses over pairs of equal number in an image, as shares of the image."""
    return matching.box_losses(_pairs(spark, d).where("gt = dt"), ["image_id"], "dt_box", "gt_box", F.lit(4.0)).select("image_id", F.round("loss_bbox", 11).alias("loss_bbox"), F.round("loss_giou", 11).alias("loss_giou"))


def mask_losses(spark, d):
    """Predicted overlap against that of whole-pixel boxes, and the mean overlap of targets."""
    box = lambda: boxes.clip(boxes.box(F.floor("x0"), F.floor("y0"), F.floor("x1"), F.floor("y1")), WIDTH, HEIGHT)
    g = ground_truth(spark, d).select("image_id", "obj", box().alias("a"))
    t = detections(spark, d).select("image_id", "obj", box().alias("b"), "score")
    p = g.join(t, ["image_id", "obj"]).select("image_id", "score", boxes.intersection(F.col("a"), F.col("b")).alias("i"), boxes.union(F.col("a"), F.col("b")).alias("u"), boxes.area(F.col("a")).alias("ga"))
    loss = p.groupBy("image_id").agg((matching.exact_sum(matching.iou_losses(F.col("score"), F.col("i"), F.col("u"))) / 1e9).alias("squared"), (matching.exact_sum(matching.iou_losses(F.col("score"), F.col("i"), F.col("u"), True)) / 1e9).alias("absolute"))
    return loss.join(matching.mean_mask_iou(p, ["image_id"], "i", "u", "ga"), "image_id").select("image_id", F.round("squared", 9).alias("squared"), F.round("absolute", 9).alias("absolute"), r6(F.col("miou")).alias("miou"))


def best_masks(spark, d):
    o = detections(spark, d).withColumn("iou", F.greatest(F.round(F.col("score") - 0.4, 2), F.lit(0.0)))
    return matching.best_of_masks(o, ["image_id"], "iou", "score", "obj").select("image_id", "obj", "iou")


def uncertain_samples(spark, d):
    o = objects(spark, d).withColumn("logit", F.round(F.col("score") * 4 - 2, 3)).withColumn("id", F.col("image_id") * 100 + F.col("obj"))
    return matching.uncertain_points(o, ["category_id"], "logit", "id", 40, 0.75, 500).select("category_id", "id", "certain")


def memory_scores(spark, d):
    o = detections(spark, d)
    return o.groupBy("image_id").agg(r6(matching.exact_sum(matching.memory_score(F.col("score") * 6 - 3, F.col("score"))) / 1e9 / F.count("*")).alias("memory_score"))


def processed_outputs(spark, d):
    o = detections(spark, d).withColumn("logits", F.array(F.round(F.col("score") * 4 - 2, 6), F.round(F.col("tax") / 4.0 - 1, 6), F.lit(-0.25))).withColumn("presence", F.col("image_id") % 5 - 1)
    o = o.withColumn("rel", boxes.to_cxcywh(boxes.box(F.col("x0") / WIDTH, F.col("y0") / HEIGHT, F.col("x1") / WIDTH, F.col("y1") / HEIGHT)))
    out = matching.processed_boxes(o, "logits", "rel", F.lit(WIDTH), F.lit(HEIGHT), 0.35, "presence")
    return out.select("image_id", "obj", "label", r6(F.col("out.x0")).alias("out_x0"), r6(F.col("out.y1")).alias("out_y1"), F.round("score", 9).alias("probability"))


def best_track_masks(spark, d):
    return matching.best_per_track(detections(spark, d), ["video_id", "category_id", "image_id"], "score", "obj").select("video_id", "category_id", "image_id", "obj")


def remaining_masks(spark, d):
    """What is left of each detection if every pixel goes to the best one, and whether it shrank too far."""
    whole = lambda c, most: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(most)).cast("long").alias(c)
    o = detections(spark, d).select("image_id", "obj", "score", whole("x0", WIDTH), whole("y0", HEIGHT), whole("x1", WIDTH), whole("y1", HEIGHT)).where("x1 > x0 AND y1 > y0")
    out = matching.remaining_areas(o, ["image_id"], "score", "obj")
    return out.select("image_id", "obj", "area", "left", matching.shrunk(F.col("area"), F.col("left")).alias("suppressed"))


QUERIES = {
    f.__name__: f
    for f in (
        matched_at_least_cost, matched_by_focal_cost, matched_with_repeats, matched_valid_pairs, pair_costs, matched_losses, mask_losses, best_masks, uncertain_samples, memory_scores, processed_outputs, best_track_masks, remaining_masks,
    )
}

_SHARES = "x0 / 640 AS x0, y0 / 480 AS y0, x1 / 640 AS x1, y1 / 480 AS y1"
_HULL = "((greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0)))"
_U = f"((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {INTER})"
_PAIRS_SQL = f"""{GT_SQL}, nd AS (SELECT image_id, count(*) // 2 AS n FROM dt GROUP BY 1), a AS (SELECT image_id, obj, {_SHARES} FROM gt JOIN nd USING (image_id) WHERE obj < n), b AS (SELECT image_id, obj, score, {_SHARES} FROM dt),
    q AS (SELECT a.image_id, a.obj AS gt, b.obj AS dt, 1 / (1 + exp(-(b.score * 4 - 2))) AS p, b.score * 4 - 2 AS z,
            abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) + abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) + abs((a.x1 - a.x0) - (b.x1 - b.x0)) + abs((a.y1 - a.y0) - (b.y1 - b.y0)) AS l1,
            CASE WHEN {_U} > 0 THEN {INTER} / {_U} ELSE 0 END - ({_HULL} - {_U}) / {_HULL} AS giou FROM a JOIN b ON a.image_id = b.image_id),
    f AS (SELECT *, -0.25 * pow(1 - p, 2) * -ln(1 + exp(-z)) + 0.75 * pow(p, 2) * -ln(1 + exp(z)) AS focal, p * (giou + 1) / 2 AS s, 0.25 * pow(1 - p, 2) * -ln(p + 1e-8) - 0.75 * pow(p, 2) * -ln(1 - p + 1e-8) AS eps FROM q),
    c AS (SELECT *, -0.25 * pow(1 - s, 2) * ln(s) + 0.75 * pow(s, 2) * ln(1 - s) AS stable FROM f)"""


def _matched_sql(class_cost: str, repeats: int = 1, valid: str = "true") -> str:
    """The least total cost for each set of predictions that are taken, target by target; a target may go without one where valid ones run out."""
    return f"""WITH RECURSIVE {_PAIRS_SQL}, rep AS (SELECT unnest(range(0, {repeats})) AS rep), slots AS (SELECT image_id, gt, rep, row_number() OVER (PARTITION BY image_id ORDER BY rep, gt) AS k FROM (SELECT DISTINCT image_id, gt FROM c) CROSS JOIN rep),
    e AS (SELECT c.image_id, k, CAST(1 AS BIGINT) << CAST(c.dt AS INT) AS bit, 5 * l1 + 2 * ({class_cost}) - 2 * giou AS cost, 1 AS used FROM c JOIN slots ON slots.image_id = c.image_id AND slots.gt = c.gt WHERE {valid} UNION ALL SELECT image_id, k, 0, 0.0, 0 FROM slots),
    walk AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS mask, CAST(0.0 AS DOUBLE) AS total, 0 AS n FROM c
             UNION ALL
             SELECT image_id, k, mask, total, n FROM (SELECT w.image_id, e.k, w.mask | e.bit AS mask, w.total + e.cost AS total, w.n + e.used AS n FROM walk w JOIN e ON e.image_id = w.image_id AND e.k = w.k + 1 AND w.mask & e.bit = 0
                 QUALIFY row_number() OVER (PARTITION BY w.image_id, e.k, w.mask | e.bit ORDER BY w.n + e.used DESC, w.total + e.cost) = 1)),
    m AS (SELECT image_id, n, total FROM walk QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k DESC, n DESC, total) = 1)
    SELECT image_id, CAST(n AS BIGINT) AS n, round(total, 6) AS total FROM m WHERE n > 0"""


_WHOLE = f"image_id, obj, score, least(greatest(floor(x0), 0), {WIDTH}) AS x0, least(greatest(floor(y0), 0), {HEIGHT}) AS y0, least(greatest(floor(x1), 0), {WIDTH}) AS x1, least(greatest(floor(y1), 0), {HEIGHT}) AS y1"
ORACLE_SQL = {
    "matched_at_least_cost": _matched_sql("-p"),
    "matched_by_focal_cost": _matched_sql("focal"),
    "matched_with_repeats": _matched_sql("stable", 2),
    "matched_valid_pairs": _matched_sql("eps", valid="c.dt % 2 = 0"),
    "pair_costs": f"WITH {_PAIRS_SQL} SELECT image_id, gt, dt, round(l1, 9) AS l1, round(giou, 6) AS giou, round(focal, 6) AS focal, round(stable, 6) AS stable, round(eps, 6) AS eps_focal FROM c",
    "matched_losses": f"WITH {_PAIRS_SQL} SELECT image_id, round(sum(CAST(round(l1 * 1e9) AS BIGINT)) / 1e9 / 4, 11) AS loss_bbox, round(sum(CAST(round((1 - giou) * 1e9) AS BIGINT)) / 1e9 / 4, 11) AS loss_giou FROM c WHERE gt = dt GROUP BY 1",
    "mask_losses": f"""WITH {GT_SQL}, a AS (SELECT {_WHOLE} FROM gt), b AS (SELECT {_WHOLE} FROM dt), p AS (SELECT a.image_id, b.score, {INTER} AS i, {_U} AS u, (a.x1 - a.x0) * (a.y1 - a.y0) AS ga FROM a JOIN b ON a.image_id = b.image_id AND a.obj = b.obj), v AS (SELECT *, score - i / greatest(u, 1) AS off FROM p)
        SELECT image_id, round(sum(CAST(round(off * off * 1e9) AS BIGINT)) / 1e9, 9) AS squared, round(sum(CAST(round(abs(off) * 1e9) AS BIGINT)) / 1e9, 9) AS absolute, round(CASE WHEN count(*) FILTER (ga > 0) = 0 THEN 1.0 ELSE sum(CAST(round(i / greatest(u, 1) * 1e9) AS BIGINT)) / 1e9 / greatest(count(*) FILTER (ga > 0), 1) END, 6) AS miou FROM v GROUP BY 1""",
    "best_masks": f"WITH {GT_SQL}, o AS (SELECT image_id, obj, greatest(round(score - 0.4, 2), 0.0) AS iou FROM dt) SELECT image_id, obj, iou FROM o QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, obj) = 1",
    "uncertain_samples": f"""WITH {GT_SQL}, o AS (SELECT category_id, image_id * 100 + obj AS id, -abs(round(score * 4 - 2, 3)) AS u FROM objs), r AS (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY u DESC, id) AS k FROM o),
        s AS (SELECT *, CASE WHEN k > 30 THEN CAST(CAST('0x' || substr(md5('500|' || category_id || '|' || id), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 ELSE -1.0 END AS draw FROM r)
        SELECT category_id, id, k > 30 AS certain FROM s QUALIFY row_number() OVER (PARTITION BY category_id ORDER BY draw, k) <= 40""",
    "memory_scores": f"WITH {GT_SQL} SELECT image_id, round(sum(CAST(round(greatest(2 / (1 + exp(-(score * 6 - 3))) - 1, 0.0) * score * 1e9) AS BIGINT)) / 1e9 / count(*), 6) AS memory_score FROM dt GROUP BY 1",
    "processed_outputs": f"""WITH {GT_SQL}, o AS (SELECT *, round(score * 4 - 2, 6) AS l0, round(tax / 4 - 1, 6) AS l1 FROM dt), b AS (SELECT *, greatest(l0, l1, -0.25) AS best FROM o), s AS (SELECT *, 1 / (1 + exp(-best)) / (1 + exp(-(image_id % 5 - 1))) AS p FROM b)
        SELECT image_id, obj, CAST(CASE best WHEN l0 THEN 0 WHEN l1 THEN 1 ELSE 2 END AS BIGINT) AS label, round(x0, 6) AS out_x0, round(y1, 6) AS out_y1, round(p, 9) AS probability FROM s WHERE p > 0.35""",
    "best_track_masks": f"WITH {GT_SQL} SELECT video_id, category_id, image_id, obj FROM dt QUALIFY row_number() OVER (PARTITION BY video_id, category_id, image_id ORDER BY score DESC, obj) = 1",
    "remaining_masks": f"""WITH {GT_SQL}, o AS (SELECT {_WHOLE} FROM dt), k AS (SELECT image_id, obj, score, CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1 FROM o WHERE x1 > x0 AND y1 > y0),
        xs AS (SELECT image_id, x, lead(x) OVER (PARTITION BY image_id ORDER BY x) AS nx FROM (SELECT image_id, x0 AS x FROM k UNION SELECT image_id, x1 FROM k)), ys AS (SELECT image_id, y, lead(y) OVER (PARTITION BY image_id ORDER BY y) AS ny FROM (SELECT image_id, y0 AS y FROM k UNION SELECT image_id, y1 FROM k)),
        c AS (SELECT k.image_id, obj, (nx - x) * (ny - y) AS cell FROM k JOIN xs ON xs.image_id = k.image_id AND k.x0 <= x AND nx <= k.x1 JOIN ys ON ys.image_id = k.image_id AND k.y0 <= y AND ny <= k.y1 QUALIFY row_number() OVER (PARTITION BY k.image_id, x, y ORDER BY score DESC, obj) = 1),
        l AS (SELECT image_id, obj, CAST(sum(cell) AS BIGINT) AS left_ FROM c GROUP BY ALL)
        SELECT k.image_id, k.obj, (x1 - x0) * (y1 - y0) AS area, coalesce(left_, 0) AS "left", coalesce(left_, 0) / greatest((x1 - x0) * (y1 - y0), 1) < 0.3 AS suppressed FROM k LEFT JOIN l USING (image_id, obj)""",
}
