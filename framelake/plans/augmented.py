"""Seeded augmentation of images (orders) and their objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import boxes
from framelake.operators import augment

from .views import HEIGHT, OBJECTS_SQL, WIDTH, objects, table

_SIZES, _SCHEDULE = [320, 352, 384, 416], [(0, [256, 288]), (3, [320, 352, 384]), (9, [640])]
r6 = lambda c: F.round(c, 6)


def augmented_images(spark, d):
    """What is drawn for each image, at epoch 5: sizes, crops, paddings, mosaic tiles, branches. Sizes follow the order's key."""
    image = F.col("o_orderkey").cast("long")
    o = table(spark, d, "orders").select(image.alias("image_id"), (480 + image % 200).alias("w"), (300 + image % 310).alias("h"))
    key, w, h = F.col("image_id"), F.col("w"), F.col("h")
    size = augment.fitted_size(w, h, augment.random_size(_SIZES, 1, key), 512)
    crop = augment.random_crop(w, h, 200, 280, 20, key)
    jitter = augment.jitter_crop(w, h, 0.8, (0.1, 1.0), (0.5, 2.0), 30, key)
    pad, square, fixed, tile = augment.random_pad(16, 40, key), augment.pad_to_size(w, h, 700, 50, key), augment.pad_to_size(w, h, 512), augment.mosaic(0.5, [2, 3], 60, key)
    middle, small = augment.centre_crop(w, h, 224, 225), augment.smaller_if_above(w, h, 500)
    return o.select(
        "image_id", size["w"].alias("w1"), size["h"].alias("h1"), augment.scheduled_size(_SCHEDULE, 5, 10, key).cast("long").alias("scheduled"),
        *[crop[c].alias(f"crop_{c}") for c in "xywh"], *[jitter[c].alias(f"jitter_{c}") for c in "xywh"], pad["right"].alias("pad_right"), pad["below"].alias("pad_below"),
        *[square[c].alias(f"square_{c}") for c in ("left", "top", "right", "below")], fixed["right"].alias("fixed_right"), fixed["below"].alias("fixed_below"),
        tile["side"].alias("side"), tile["row"].alias("tile_row"), tile["column"].alias("tile_column"), tile["mirrored"].alias("mirrored"),
        middle["x"].alias("mid_x"), middle["y"].alias("mid_y"), small["w"].alias("small_w"), small["h"].alias("small_h"),
        augment.chosen_branch([F.lit("crop"), F.lit("resize"), F.lit("none")], [1, 2, 1], 70, key).alias("branch"),
    )


def augmented_boxes(spark, d):
    """Boxes after a flip drawn for the image, a crop, a mosaic tile, and noise of their own."""
    o = objects(spark, d).withColumn("box", boxes.from_xywh(F.col("x0"), F.col("y0"), F.col("w"), F.col("h")))
    b, image, obj = F.col("box"), F.col("image_id"), F.col("obj")
    flip = augment.flipped_sometimes(b, WIDTH, 0.5, 80, image)
    crop = augment.crop_box(b, augment.random_crop(F.lit(WIDTH), F.lit(HEIGHT), 200, 280, 20, image))
    tile = augment.in_tile(b, F.lit(WIDTH), F.lit(HEIGHT), augment.mosaic(0.5, [2, 4], 60, image))
    noisy = augment.noisy_box(b, WIDTH, HEIGHT, 0.1, 20, 16.0, 90, image, obj)
    around = augment.random_crop(F.lit(WIDTH), F.lit(HEIGHT), 50, 80, 20, image, obj, around=boxes.clip(b, WIDTH, HEIGHT))
    return o.select(
        "image_id", "obj", flip["x0"].alias("flip_x0"), crop["x0"].alias("crop_x0"), crop["y1"].alias("crop_y1"), tile["x0"].alias("tile_x0"), tile["y1"].alias("tile_y1"),
        *[r6(noisy[c]).alias(f"noisy_{c}") for c in ("x0", "y0", "x1", "y1")], *[around[c].alias(f"around_{c}") for c in "xywh"],
    )


def box_prompts(spark, d):
    """Point prompts of boxes, and the inputs of geometric queries with one target."""
    o = objects(spark, d).withColumn("box", boxes.from_xywh(F.col("x0"), F.col("y0"), F.col("w"), F.col("h"))).withColumn("n_targets", F.col("tax") % 2 + 1).withColumn("phrase", F.when(F.col("rf") == "N", "geometric").otherwise(F.col("rf")))
    corners = augment.box_points(F.col("box"), WIDTH, HEIGHT, 0.1, 10.0, 100, F.col("image_id"), F.col("obj"))
    o = augment.geometric_inputs(o, "phrase", "n_targets", "box", 3, 0.5, 120, "image_id", "obj")
    p = lambda k, c: F.get(corners, k)[c]
    return o.select("image_id", "obj", r6(p(0, "x")).alias("px0"), r6(p(0, "y")).alias("py0"), r6(p(1, "x")).alias("px1"), r6(p(1, "y")).alias("py1"), p(0, "label").alias("label0"), F.coalesce(F.size("points"), F.lit(-1)).cast("long").alias("n_points"), F.get("points", 0)["x"].alias("first_x"), F.get("points", 1)["y"].alias("second_y"), F.col("input_box.x1").alias("input_x1"))


QUERIES = {f.__name__: f for f in (augmented_images, augmented_boxes, box_prompts)}


def _u(seed: int, *keys: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5('{seed}|' || {" || '|' || ".join(keys)}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def _n(seed: int, *keys: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {_u(seed, *keys)})) * cos(2 * pi() * {_u(seed + 1, *keys)}))"


def _whole(least: int, most: int, seed: int, *keys: str) -> str:
    return f"CAST(floor({least} + {_u(seed, *keys)} * {most - least + 1}) AS BIGINT)"


def _crop_sql(least: int, most: int, seed: int, w: str, h: str, *keys: str) -> str:
    return f"""least({_whole(least, most, seed, *keys)}, {w}) AS cw, least({_whole(least, most, seed + 1, *keys)}, {h}) AS ch,
        CAST(floor({_u(seed + 2, *keys)} * ({w} - least({_whole(least, most, seed, *keys)}, {w}) + 1)) AS BIGINT) AS cx, CAST(floor({_u(seed + 3, *keys)} * ({h} - least({_whole(least, most, seed + 1, *keys)}, {h}) + 1)) AS BIGINT) AS cy"""


def _noise(c: str, size: str, most: int, seed: int) -> str:
    return f"greatest(0.0, least({most}, {c} + greatest(-20.0, least(20.0, {_n(seed, 'image_id', 'obj')} * 0.1 * {size}))))"


def _corner(c: str, size: str, most: int, seed: int) -> str:
    return f"greatest(0.0, least({most - 1}, {c} + greatest(-10.0, least(10.0, {_n(seed, 'image_id', 'obj')} * 0.1 * {size}))))"


_I, _IO = ("image_id",), ("image_id", "obj")
_AREA = f"(w * h * (0.1 + {_u(31, *_I)} * (1.0 - 0.1)))"
_ASPECT = f"exp(ln(0.5) + {_u(32, *_I)} * (ln(2.0) - ln(0.5)))"
_SIDE = lambda grids: f"(CASE WHEN {_u(60, *_I)} < 0.5 THEN {grids}[CAST(floor({_u(61, *_I)} * 2) AS INT) + 1] ELSE 1 END)"
ORACLE_SQL = {
    "augmented_images": f"""WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS image_id, CAST(480 + o_orderkey % 200 AS BIGINT) AS w, CAST(300 + o_orderkey % 310 AS BIGINT) AS h FROM orders),
        s AS (SELECT *, least(CAST({_SIZES}[CAST(floor({_u(1, *_I)} * 4) AS INT) + 1] AS DOUBLE), 512 * CAST(least(w, h) AS DOUBLE) / greatest(w, h)) AS side0, least(w, h) AS low, {_crop_sql(200, 280, 20, "w", "h", *_I)},
            CAST(floor(sqrt({_AREA} * {_ASPECT}) + 0.5) AS BIGINT) AS jw, CAST(floor(sqrt({_AREA} / {_ASPECT}) + 0.5) AS BIGINT) AS jh, {_SIDE("[2, 3]")} AS side FROM o),
        j AS (SELECT *, {_u(30, *_I)} < 0.8 AND jw <= w AND jh <= h AND jw > 0 AND jh > 0 AS fits FROM s)
        SELECT image_id, CAST(floor(w * side0 / low + 0.5) AS BIGINT) AS w1, CAST(floor(h * side0 / low + 0.5) AS BIGINT) AS h1, CAST([320, 352, 384][CAST(floor({_u(10, *_I)} * 3) AS INT) + 1] AS BIGINT) AS scheduled,
            cx AS crop_x, cy AS crop_y, cw AS crop_w, ch AS crop_h, CASE WHEN fits THEN CAST(floor({_u(33, *_I)} * (w - jw + 1)) AS BIGINT) ELSE 0 END AS jitter_x, CASE WHEN fits THEN CAST(floor({_u(34, *_I)} * (h - jh + 1)) AS BIGINT) ELSE 0 END AS jitter_y,
            CASE WHEN fits THEN jw ELSE w END AS jitter_w, CASE WHEN fits THEN jh ELSE h END AS jitter_h, {_whole(0, 16, 40, *_I)} AS pad_right, {_whole(0, 16, 41, *_I)} AS pad_below,
            CAST(floor({_u(50, *_I)} * (700 - w + 1)) AS BIGINT) AS square_left, CAST(floor({_u(51, *_I)} * (700 - h + 1)) AS BIGINT) AS square_top,
            700 - w - CAST(floor({_u(50, *_I)} * (700 - w + 1)) AS BIGINT) AS square_right, 700 - h - CAST(floor({_u(51, *_I)} * (700 - h + 1)) AS BIGINT) AS square_below,
            greatest(512 - w, 0) AS fixed_right, greatest(512 - h, 0) AS fixed_below, CAST(side AS BIGINT) AS side, CAST(floor({_u(62, *_I)} * side) AS BIGINT) AS tile_row, CAST(floor({_u(63, *_I)} * side) AS BIGINT) AS tile_column, {_u(64, *_I)} < 0.5 AS mirrored,
            CAST(floor((w - 224) / 2.0 + 0.5) AS BIGINT) AS mid_x, CAST(floor((h - 225) / 2.0 + 0.5) AS BIGINT) AS mid_y,
            CASE WHEN greatest(w, h) > 500 THEN CAST(floor(w * 500 / greatest(w, h) + 0.5) AS BIGINT) ELSE w END AS small_w, CASE WHEN greatest(w, h) > 500 THEN CAST(floor(h * 500 / greatest(w, h) + 0.5) AS BIGINT) ELSE h END AS small_h,
            CASE WHEN {_u(70, *_I)} < 0.25 THEN 'crop' WHEN {_u(70, *_I)} < 0.75 THEN 'resize' ELSE 'none' END AS branch FROM j""",
    "augmented_boxes": f"""WITH {OBJECTS_SQL}, b AS (SELECT *, x0 + w AS x1, y0 + h AS y1, {_crop_sql(200, 280, 20, str(WIDTH), str(HEIGHT), *_I)}, {_SIDE("[2, 4]")} AS side FROM objs),
        n AS (SELECT *, CAST(floor({_u(63, *_I)} * side) AS BIGINT) AS tc, CAST(floor({_u(62, *_I)} * side) AS BIGINT) AS tr, {_noise("x0", "w", WIDTH, 90)} AS a0, {_noise("y0", "h", HEIGHT, 92)} AS b0, {_noise("x1", "w", WIDTH, 94)} AS a1, {_noise("y1", "h", HEIGHT, 96)} AS b1,
            least(greatest(x0, 0), {WIDTH}) AS k0, least(greatest(x1, 0), {WIDTH}) AS k1, least(greatest(y0, 0), {HEIGHT}) AS l0, least(greatest(y1, 0), {HEIGHT}) AS l1 FROM b),
        m AS (SELECT *, a1 > a0 AND b1 > b0 AND (a1 - a0) * (b1 - b0) > 16 AS ok, greatest({_whole(50, 80, 20, *_IO)}, CAST(ceil(k1 - k0) AS BIGINT)) AS aw, greatest({_whole(50, 80, 21, *_IO)}, CAST(ceil(l1 - l0) AS BIGINT)) AS ah FROM n),
        x AS (SELECT *, CAST(floor({_u(22, *_IO)} * ({WIDTH} - aw + 1)) AS BIGINT) AS ax, CAST(floor({_u(23, *_IO)} * ({HEIGHT} - ah + 1)) AS BIGINT) AS ay FROM m)
        SELECT image_id, obj, CASE WHEN {_u(80, *_I)} < 0.5 THEN {WIDTH} - x1 ELSE x0 END AS flip_x0, CAST(least(greatest(x0 - cx, 0), cw) AS DOUBLE) AS crop_x0, CAST(least(greatest(y1 - cy, 0), ch) AS DOUBLE) AS crop_y1,
            x0 * (1.0 / side) + {WIDTH} / side * tc AS tile_x0, y1 * (1.0 / side) + {HEIGHT} / side * tr AS tile_y1,
            round(CASE WHEN ok THEN a0 ELSE x0 END, 6) AS noisy_x0, round(CASE WHEN ok THEN b0 ELSE y0 END, 6) AS noisy_y0, round(CASE WHEN ok THEN a1 ELSE x1 END, 6) AS noisy_x1, round(CASE WHEN ok THEN b1 ELSE y1 END, 6) AS noisy_y1,
            least(greatest(ax, CAST(ceil(k1) AS BIGINT) - aw), CAST(floor(k0) AS BIGINT)) AS around_x, least(greatest(ay, CAST(ceil(l1) AS BIGINT) - ah), CAST(floor(l0) AS BIGINT)) AS around_y, aw AS around_w, ah AS around_h FROM x""",
    "box_prompts": f"""WITH {OBJECTS_SQL}, q AS (SELECT *, x0 + w AS x1, y0 + h AS y1, rf = 'N' AND tax % 2 + 1 = 1 AS own, {_u(120, *_IO)} < 0.5 AS boxed FROM objs)
        SELECT image_id, obj, round({_corner("x0", "w", WIDTH, 100)}, 6) AS px0, round({_corner("y0", "h", HEIGHT, 102)}, 6) AS py0, round({_corner("x1", "w", WIDTH, 104)}, 6) AS px1, round({_corner("y1", "h", HEIGHT, 106)}, 6) AS py1, 2 AS label0,
            CAST(CASE WHEN own AND boxed THEN 2 WHEN own THEN 3 ELSE -1 END AS BIGINT) AS n_points, CASE WHEN own THEN CAST(floor(x0 + {_u(121, *_IO)} * w) AS BIGINT) END AS first_x, CASE WHEN own THEN CAST(floor(y0 + {_u(124, *_IO)} * h) AS BIGINT) END AS second_y,
            CASE WHEN own AND boxed THEN x1 END AS input_x1 FROM q""",
}
