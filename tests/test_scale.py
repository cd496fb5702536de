"""What queries send between tasks and how they reach their rows: plans and results that would grow faster than the tables."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import boxes, masks, points, rotated, runs
from framelake.operators import assign, evaluation, matching, metrics, records, shapes, suppress
from framelake.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    """The columns, without numbers, by which a plan deals rows, one set for each shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [set(re.findall(r"([A-Za-z_]\w*)#\d+", x)) for x in re.findall(r"Exchange hashpartitioning\((.*)", plan)]


def test_average_precision_sends_objects_once(spark):
    for name in ("average_precision_levels", "average_precision_summary", "recall_of_the_best"):
        found = _exchanges(QUERIES[name](spark, SF))
        assert {"image_id"} in found
        assert not [x for x in found if "image_id" in x and x != {"image_id"}], name  # neither pairs nor their thresholds go by image again


def test_hota_spreads_over_alphas_after_counting(spark):
    for name in ("hota_combined", "hota_by_sequence", "phrase_hota", "teta_by_class", "teta_of_predictions"):
        found = _exchanges(QUERIES[name](spark, SF))
        assert not [x for x in found if "alpha" in x and x & {"gt", "dt"}], name


def test_owners_of_many_groups_share_a_call(spark):
    plan = QUERIES["owned_pixels"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "ArrowEvalPython" in plan


def test_rotated_boxes_are_cut_by_batches(spark):
    plan = QUERIES["rotated_overlaps"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "across" in plan


def test_batches_of_masks_equal_single_masks(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(300):
        h, w = (int(v) for v in rng.integers(1, 9, 2))
        m = rng.random((h, w)) < rng.choice([0.0, 0.3, 0.8, 1.0])
        if k % 3 == 0:  # boxes, at borders too
            m[:] = False
            y, x = sorted(rng.integers(0, h + 1, 2)), sorted(rng.integers(0, w + 1, 2))
            m[y[0] : y[1], x[0] : x[1]] = True
        rows.append((k, masks.encode(m), h, w, int(rng.integers(0, 12)), int(rng.integers(0, w)), int(rng.integers(0, h)), 1 + k % 2))
    df = spark.createDataFrame(rows, "id long, counts array<int>, h int, w int, k long, x long, y long, n int")
    box = masks.mask_box("counts", "h")
    got = df.select("*", box.alias("box"), points.inner_points("counts", "h", "w", "n").alias("inner"), points.nth_pixel("counts", "k", "h").alias("p"), points.has_pixel("counts", "x", "y", "h").alias("on"), masks.pixels("counts").alias("area"))
    for r in got.collect():
        m = masks.decode(r.counts, r.h, r.w)
        assert r.box == masks.bounds(r.counts, r.h)
        assert [p.asDict() for p in r.inner] == points._inner(r.counts, r.h, r.w, r.n)
        found = np.flatnonzero(m.T.ravel())
        assert (r.p and (r.p.x, r.p.y)) == ((found[r.k] // r.h, found[r.k] % r.h) if r.k < len(found) else None)
        assert r.on == m[r.y, r.x] and r.area == m.sum()


def test_box_masks_of_a_batch(spark):
    rows = [(a, b, c, d, h, w) for h, w in ((3, 4), (5, 2)) for a in (-1, 0, 1, 2) for b in (-2, 0, 1) for c in (0, 1, 2, 4, 9) for d in (1, 3, 5, 9)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, h int, w int")
    for r in df.withColumn("counts", masks.box_mask("a", "b", "c", "d", "h", "w")).collect():
        m = np.zeros((r.h, r.w), bool)
        m[max(r.b, 0) : max(r.d, 0), max(r.a, 0) : max(r.c, 0)] = True
        assert r.counts == masks.encode(m)


def test_pixels_are_found_by_batches(spark):
    for name in ("drawn_pixels", "inner_pixels"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "aggregate(" not in plan and "box_mask" in plan
    many = spark.range(20000).select(points.inner_points(masks.box_mask(F.lit(1), F.lit(1), F.lit(401), F.lit(401), F.lit(402), F.lit(402)), F.lit(402), F.lit(402), F.lit(1)).alias("p"))
    began = time.perf_counter()
    assert many.distinct().first().p == [(200, 200)]
    assert time.perf_counter() - began < 120  # distances of all their pixels take hours


def _plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_runs_stay_in_the_call_that_makes_them(spark):
    assert "aggregate(" not in _plan(spark, "mask_table") and "aggregate(" not in _plan(spark, "image_semantic_masks")
    assert "Join" not in _plan(spark, "ragged_overlaps")  # an image's masks are compared in one row
    assert _plan(spark, "error_samples").count("ArrowEvalPython") == 1


def test_unions_and_overlaps_of_lists_of_masks(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(200):
        h, w = (int(v) for v in rng.integers(1, 8, 2))
        rows.append((k, h, w, [masks.encode(rng.random((h, w)) < rng.choice([0.0, 0.2, 0.7, 1.0])) for _ in range(int(rng.integers(0, 6)))]))
    rows.append((200, 3, 3, None))
    df = spark.createDataFrame(rows, "id long, h int, w int, lists array<array<int>>")
    got = df.select("*", runs.union_area("lists").alias("area"), runs.overlaps("lists").alias("pairs"), F.transform("lists", lambda c: c).alias("same")).collect()
    for r in got:
        if r.lists is None:
            assert r.area is None and r.pairs is None
            continue
        m = [masks.decode(c, r.h, r.w) for c in r.lists]
        assert r.area == (np.any(m, axis=0).sum() if m else 0)
        want = [(a, b, int((m[a] & m[b]).sum()), int(m[a].sum()), int(m[b].sum())) for a in range(len(m)) for b in range(a + 1, len(m)) if (m[a] & m[b]).any()]
        assert [tuple(p) for p in r.pairs] == want
    one = df.select("h", F.explode("lists").alias("c")).select("h", "c", masks.measured("c", "h").alias("m"), masks.mask_box("c", F.col("h")).alias("box"), masks.pixels("c").alias("n")).collect()
    assert all(r.m.area == r.n and ([r.m.x0, r.m.y0, r.m.x1, r.m.y1] == (r.box or [None] * 4)) for r in one)


def test_remaining_areas_join_nothing(spark):
    assert "Join" not in _plan(spark, "remaining_masks")
    rng = np.random.default_rng(8)
    rows = []
    for k in range(60):
        for n in range(int(rng.integers(1, 9))):
            x, y = (int(v) for v in rng.integers(0, 10, 2))
            rows.append((k, n, None if rng.random() < 0.1 else float(rng.integers(0, 3)), x, y, x + int(rng.integers(0, 8)), y + int(rng.integers(0, 8))))
    df = spark.createDataFrame(rows, "image long, obj long, score double, x0 long, y0 long, x1 long, y1 long")
    got = {(r.image, r.obj): (r.area, r.left) for r in matching.remaining_areas(df, ["image"], "score", "obj").collect()}
    assert len(got) == len(rows)
    taken = {}
    for image, obj, score, x0, y0, x1, y1 in sorted(rows, key=lambda r: (r[0], r[2] is None, -(r[2] or 0), r[1])):
        free = taken.setdefault(image, np.ones((20, 20), bool))
        left = int(free[y0:y1, x0:x1].sum())
        free[y0:y1, x0:x1] = False
        assert got[image, obj] == ((x1 - x0) * (y1 - y0), left)


def test_tracks_of_phrases_are_sent_once(spark):
    for name in ("phrase_track_overlap", "video_phrase_rows", "video_gated_f1", "phrase_average_precision", "phrase_hota"):
        found = _exchanges(QUERIES[name](spark, SF))
        assert {"video_id", "category_id"} in found, name
        assert not [x for x in found if "video_id" in x and x & {"t", "track"}], (name, found)


def test_small_assignments_equal_large_ones(spark):
    rng = np.random.default_rng(9)
    for _ in range(300):
        c = rng.integers(-3, 4, rng.integers(1, 7, 2)) / 4.0
        c[rng.random(c.shape) < 0.1] = matching.NEVER
        if c.shape[0] <= c.shape[1]:
            assert assign._few(c.tolist()) == assign._many(c)
    for name in ("optimal_assignment", "gated_f1", "image_match_counts"):
        assert _plan(spark, name).split("ArrowEvalPython")[-1].count("Join") == 0, name  # no join makes the pairs


def test_suppressed_frames_are_not_joined_to_their_survivors(spark):
    assert "Join" not in _plan(spark, "frame_suppression")


def test_rotated_boxes_of_an_image_meet_in_one_row(spark):
    assert "Join" not in _plan(spark, "rotated_overlaps")
    rng = np.random.default_rng(10)
    box = lambda: (*(float(v) for v in rng.uniform(-6, 6, 2)), *(float(v) for v in rng.integers(0, 7, 2)), float(rng.integers(0, 9) * 45))
    rows = [(k, [box() for _ in range(rng.integers(0, 6))], [box() for _ in range(rng.integers(0, 6))]) for k in range(200)] + [(200, None, [box()]), (201, [box()], None)]
    side = "array<struct<x: double, y: double, w: double, h: double, t: double>>"
    df = spark.createDataFrame(rows, f"k long, a {side}, b {side}").repartition(2)
    of = lambda r: [r[c] for c in ("x", "y", "w", "h", "t")]
    turned = df.select("k", *[F.transform(c, lambda r: rotated.turned(*of(r))).alias(c) for c in "ab"])
    got = {(r.k, r.p.a, r.p.b): r.p.iou for r in turned.select("k", F.explode(rotated.met("a", "b")).alias("p")).collect()}
    each = df.select("k", F.posexplode("a").alias("i", "a"), "b").select("k", "i", "a", F.posexplode("b").alias("j", "b"))
    iou = rotated.iou(rotated.corners(*of(F.col("a"))), rotated.corners(*of(F.col("b"))), F.col("a.w") * F.col("a.h"), F.col("b.w") * F.col("b.h"))
    want = {(r.k, r.i, r.j): r.v for r in each.select("k", "i", "j", iou.alias("v")).collect() if r.v > 0}
    assert len(want) > 100 and got == want


def test_errors_of_a_group_are_judged_in_its_row(spark):
    plan = _plan(spark, "precision_lost")
    assert "image_id" not in "".join(x for x in plan.splitlines() if "Join" in x)  # objects, detections and their pairs are not joined
    rng = np.random.default_rng(11)
    sides = {"g": [], "d": []}
    for k in range(150):
        for name, rows in sides.items():
            for n in range(int(rng.integers(0, 7))):
                x, y = (float(v) for v in rng.integers(0, 8, 2))
                rows.append((k, n, int(rng.integers(0, 2)), x, y, x + float(rng.integers(5, 8)), y + float(rng.integers(5, 8)), float(rng.integers(0, 4)) / 4))
    columns = ["x0", "y0", "x1", "y1"]
    g, d = (spark.createDataFrame(sides[n], "i long, number long, cls long, x0 double, y0 double, x1 double, y1 double, score double") for n in "gd")
    grouped = lambda df, n: df.groupBy("i").agg(F.collect_list(F.struct("number", "cls", *columns, "score")).alias(n))
    rows = grouped(g, "g").join(grouped(d, "d"), "i", "full").repartition(2).select(F.explode(evaluation.judged("g", "d")).alias("r")).select("r.*")
    gt, dt = g.select("i", F.col("number").alias("gt"), "cls", boxes.box(*columns).alias("gb")), d.select("i", F.col("number").alias("dt"), "cls", "score", boxes.box(*columns).alias("db"))
    pairs = gt.drop("cls").join(dt.drop("cls", "score"), "i").withColumn("iou", boxes.iou(F.col("gb"), F.col("db"))).where("iou > 0")
    same = pairs.join(gt.select("i", "gt", "cls"), ["i", "gt"]).join(dt.select("i", "dt", "cls", "score"), ["i", "dt", "cls"])
    typed, found = evaluation.error_types(gt.drop("gb"), dt.drop("db"), pairs, metrics.greedy_matches(same, ["i", "cls"], 50), ["i"], "cls")
    own = evaluation.tally(rows).collect()
    assert sum(r.n for r in own if r.is_gt) == len(sides["g"]) and sum(r.n for r in own if r.missed) == found.where("missed").count() > 0
    of = gt.select("i", F.col("gt").alias("mends"), F.col("cls").alias("to"))
    want = typed.join(of, ["i", "mends"], "left").groupBy("cls", "score", "error", "to").count().collect()
    assert {(r.cls, r.score, r.error, r.to): r.n for r in own if not r.is_gt} == {(r["cls"], r["score"], r["error"], r["to"]): r["count"] for r in want}
    assert {r.error for r in want} == {None, *evaluation.ERRORS[:-1]}
    assert sorted(evaluation.precision_lost_of(evaluation.tally(rows)).collect()) == sorted(evaluation.precision_lost(found, typed, ["i"], "cls").collect())


def test_tracks_of_videos_are_numbered_from_one_shuffle(spark):
    assert not [x for x in _exchanges(QUERIES["tracks_as_images"](spark, SF)) if "frame" in x]  # boxes are not sent to the frames of their videos
    seen = spark.sparkContext.accumulator(0)

    def kept(k):
        seen.add(1)
        return k % 3 > 0

    df = spark.range(20000, numPartitions=2).select((F.col("id") * 7 % 20011).alias("key"), F.lit("x").alias("more")).where(F.udf(kept, "boolean")("key"))
    got = sorted((r.key, r.n) for r in records.numbered(df, "n", "key").collect())
    assert [n for _, n in got] == list(range(1, len(got) + 1)) and got and seen.value == 20000  # rows and counts of ranges have one source


def test_tracks_to_images_by_hand(spark):
    kind = "video_id long, track_id long, category_id long, score double, bboxes array<array<double>>, areas array<double>"
    box = [1.0, 2.0, 3.0, 4.0]
    tracks = [(1, 5, 0, 0.5, [box, None, [0.0] * 4, box], [7.0, None, 1.0]), (2, 6, 0, 0.5, None, None), (3, 7, 0, 0.5, [], []), (4, 8, 0, 0.5, [None, box], [None, 0.0])]
    images = spark.createDataFrame([(10, 1, 3), (11, 1, 0), (12, 1, 9), (20, 4, 1), (21, 4, 1)], "image_id long, video_id long, frame long")
    got = records.tracks_to_images(spark.createDataFrame(tracks, kind), images).select("id", "image_id", "frame", "track_id", "area").collect()
    assert sorted(map(tuple, got)) == [(1, 10, 3, 5, 12.0), (2, 11, 0, 5, 7.0), (3, 20, 1, 8, 12.0), (4, 21, 1, 8, 12.0)]
    for video in (1, 9):
        with pytest.raises(Exception, match=f"no image for {video}, 1"):
            records.tracks_to_images(spark.createDataFrame([(video, 1, 0, 0.5, [None, box], [None, None])], kind), images).collect()


def test_scored_tracks_are_marked_in_one_pass(spark):
    assert "Join" not in _plan(spark, "scored_categories")
    rows = lambda *r: spark.createDataFrame(r, "video_id long, category_id long, track_id long")
    near, assigned = rows((1, 1, 5), (1, 2, 5), (1, 3, 6), (2, 1, 5), (1, 4, 7), (1, 4, 7)), rows((1, 2, 5), (1, 4, 7))
    tracks, full = rows((1, 1, 5), (1, 1, 8), (1, 1, 8), (1, 9, 6), (2, 1, 5)), spark.createDataFrame([(1, 1), (1, 1)], "video_id long, category_id long")
    found = lambda *more: sorted(map(tuple, records.scored_tracks(near, assigned, tracks, *more).collect()))
    assert found() == [(1, 2, 5), (1, 3, 6), (1, 4, 7), (2, 1, 5)]
    assert found(full) == [(1, 1, 5), (1, 1, 8), (1, 2, 5), (1, 3, 6), (1, 4, 7), (2, 1, 5)]


def test_relabelled_tracks_are_sorted_once_after_they_are_sent(spark):
    plan = _plan(spark, "relabelled_tracks")
    assert plan.count("Sort [") == 3  # objects, their numbers, and tracks of a sequence
    assert not [x for x in plan.splitlines() if "HashAggregate(keys" in x and "track" in x.split("functions")[0]]  # no map of all tracks


def _some_masks(rng, h, w):
    """Random, empty and full masks, and boxes at the borders."""
    m = rng.random((h, w)) < rng.choice([0.0, 0.2, 0.6, 1.0])
    if rng.random() < 0.4:
        y, x = sorted(rng.integers(0, h + 1, 2)), sorted(rng.integers(0, w + 1, 2))
        m = np.zeros((h, w), bool)
        m[y[0] : y[1], x[0] : x[1]] = True
    return m


def test_outlines_of_a_pair_are_counted_in_one_call(spark):
    plan = _plan(spark, "outline_scores")
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and plan.count("FileScan") == 1
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for k in range(1500):  # more than one part of a batch
        h, w, reach = (int(v) for v in rng.integers(1, 8, 3))
        t, f = _some_masks(rng, h, w), _some_masks(rng, h, w)
        rows.append((k, masks.encode(t), masks.encode(f), h, w, reach))
        lines = [masks.boundary(m) for m in (t, f)]
        ys, xs = np.mgrid[:h, :w]
        near = [np.any([(abs(ys - y) <= reach) & (abs(xs - x) <= reach) for y, x in zip(*np.nonzero(b))], axis=0) & np.ones((h, w), bool) if b.any() else np.zeros((h, w), bool) for b in lines]
        want[k] = tuple(int(m.sum()) for m in (*lines, *near, lines[1] & near[0], lines[0] & near[1]))
    rows.append((1500, None, [4], 2, 2, 1))
    df = spark.createDataFrame(rows, "k long, t array<int>, f array<int>, h int, w int, reach int").repartition(1)
    got = {r.k: r.n for r in df.select("k", runs.outlines("t", "f", "h", "w", "reach").alias("n")).collect()}
    assert got.pop(1500) is None and {k: tuple(n) for k, n in got.items()} == want
    with pytest.raises(Exception, match="masks of different sizes"):
        spark.createDataFrame([([4], [6], 2, 2, 1)], "t array<int>, f array<int>, h int, w int, reach int").select(runs.outlines("t", "f", "h", "w", "reach")).collect()


def test_outlines_of_a_group_are_compared_in_its_row(spark):
    plan = _plan(spark, "region_and_outline")
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan and plan.count("FileScan") == 1
    rng = np.random.default_rng(13)
    sides = {n: [(k, o, masks.encode(_some_masks(rng, 6, 7))) for k in range(1200) for o in range(int(rng.integers(0, 4)))] for n in ("gt", "dt")}
    sides["gt"].append((5000, 1, None))
    kind = "k long, obj long, counts array<int>"
    g, d = (spark.createDataFrame(sides[n], kind) for n in ("gt", "dt"))
    got = {r.k: r for r in shapes.region_and_outline(g, d, ["k"], F.lit(6), F.lit(7)).collect()}
    reach = 1
    by = {n: {} for n in sides}
    for n, rows in sides.items():
        for k, _, c in rows:
            by[n].setdefault(k, []).append(c and masks.decode(c, 6, 7))
    assert set(got) == {k for v in by.values() for k in v}
    for k, r in got.items():
        gs, ds = by["gt"].get(k, []), by["dt"].get(k, [])
        assert (r.n_gt, r.n_dt, r.n) == (len(gs), len(ds), min(len(gs), len(ds)))
        if not r.n:
            assert (r.j, r.f, r.jf) == (-1.0, -1.0, -1.0)
            continue
        iou = np.array([[(a & b).sum() / max(1, (a | b).sum()) for b in ds] for a in gs])
        f = np.array([[masks.boundary_f(b, a, reach) if (a & b).any() else 0.0 for b in ds] for a in gs])
        best = max((sum(iou[i, j] + f[i, j] * 1e-9 for i, j in p), sum(iou[i, j] for i, j in p), sum(f[i, j] for i, j in p)) for p in _pairings(len(gs), len(ds)))
        assert abs(r.j - best[1] / r.n) < 1e-8 and abs(r.f - best[2] / r.n) < 1e-8


def _pairings(n, m):
    from itertools import permutations

    return [list(zip(range(n), p)) for p in permutations(range(m), n)] if n <= m else [[(i, j) for j, i in enumerate(p)] for p in permutations(range(n), m)]


def test_teta_is_counted_in_one_pass(spark):
    plan = _plan(spark, "teta_by_class")
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("MapInArrow") == 1
    assert _exchanges(QUERIES["teta_by_class"](spark, SF)).count({"image_id"}) == 1
    rows = [(c, s, t) for c, s, n in ((None, 1, 2), (None, 2, 1), ("a", 1, 7), ("a", 2, 1), ("b", 1, 3)) for t in range(n)]
    batches = [pa.RecordBatch.from_pydict({k: [r[i] for r in rows[a : a + 2]] for i, k in enumerate(("cls", "seq", "t"))}, pa.schema({"cls": pa.string(), "seq": pa.int64(), "t": pa.int64()})) for a in range(0, len(rows), 2)]
    for least in (1, 3, 100):
        old, metrics._COUNTED = metrics._COUNTED, least
        try:
            found = [[tuple(r.values()) for r in t.to_pylist()] for t in metrics._units(batches, ["cls", "seq"])]
        finally:
            metrics._COUNTED = old
        assert [r for t in found for r in t] == rows and all(a[-1][:2] != b[0][:2] for a, b in zip(found, found[1:])) and (least > 1 or len(found) > 1)


def test_teta_of_odd_tables(spark):
    """Ground truth alone, tracks alone, pairs of unknown objects, null classes, and frames that need an assignment."""
    make = lambda rows, name: spark.createDataFrame(rows, f"seq long, t long, {name} long, cls string")
    sims = lambda rows: spark.createDataFrame(rows, "seq long, t long, gt long, dt long, iou double")
    gt = [(1, t, k, "a") for t in range(3) for k in (1, 2)] + [(2, 0, 1, "b"), (3, 0, 1, None)]
    dt = [(1, t, k, "a" if k == 5 else "c") for t in range(3) for k in (5, 6)] + [(3, 0, 5, "b")]
    sim = [(1, t, g, d, 0.9 if (g, d) in ((1, 5), (2, 6)) else 0.6) for t in range(3) for g in (1, 2) for d in (5, 6)] + [(3, 0, 1, 5, 0.8), (1, 7, 1, 5, 0.8), (1, 0, 9, 5, 0.1)]
    got = {r.cls: r for r in metrics.teta(make(gt, "gt"), make(dt, "dt"), sims(sim)).collect()}
    assert set(got) == {"a", "b", None} and got["b"].teta == got[None].teta == 0
    levels = 19 / 20  # 0.9 is reached by all but 0.95
    assert (got["a"].loc_re, got["a"].assoc_a) == (pytest.approx(levels), pytest.approx(levels)) and got["a"].cls_re == pytest.approx(0.5 * 9 / 10)
    assert metrics.teta(make([], "gt"), make(dt, "dt"), sims([])).count() == 0


def test_suppressed_tracks_of_an_image_are_paired_in_its_row(spark):
    plan = _plan(spark, "teta_of_predictions")
    assert plan.count("FileScan") == 1 and "Join" not in plan  # detections are not joined to those that survive
    rng = np.random.default_rng(14)
    rows = []
    for k in range(300):
        for n in range(int(rng.integers(0, 9))):
            x, y = (float(v) for v in rng.integers(0, 5, 2))
            g = (x, y, x + float(rng.integers(0, 6)), y + float(rng.integers(1, 6)))
            rows.append((k, n, int(rng.integers(0, 2)), int(rng.integers(0, 2)), "abc"[n % 3], bool(rng.random() < 0.7), bool(rng.random() < 0.7), float(rng.integers(0, 4)), *g, *(v + 1 for v in g)))
    corners = [f"{s}{c}" for s in "gd" for c in ("x0", "y0", "x1", "y1")]
    names = ["image", "obj", "seq", "part", "cls", "is_gt", "is_dt", "score", *corners]
    df = spark.createDataFrame(rows, f"image long, obj long, seq long, part long, cls string, is_gt boolean, is_dt boolean, score double, {', '.join(c + ' double' for c in corners)}")
    images = df.groupBy("image").agg(F.collect_list(F.struct(*names[1:])).alias("rows")).repartition(2)
    tracks = lambda own, s, name: own.select("image", "seq", (F.col("part") * 8 + F.row_number().over(Window.partitionBy("image", "seq", "part").orderBy("obj")) - 1).alias(name), F.col("cls").alias(f"{name}_cls"), boxes.box(*[f"{s}{c}" for c in ("x0", "y0", "x1", "y1")]).alias(f"{name}_box"))
    for threshold in (None, 0.5):
        found = df.where("is_dt")
        if threshold:
            found = suppress.greedy_suppress(found, ["image"], threshold, strict=False, box=("dx0", "dy0", "dx1", "dy1"))
            assert 0 < found.count() < df.where("is_dt").count()
        g, d = tracks(df.where("is_gt"), "g", "gt"), tracks(found, "d", "dt")
        pairs = g.join(d, ["image", "seq"]).withColumn("iou", boxes.iou(F.col("gt_box"), F.col("dt_box"))).where("iou > 0")
        want = sorted(map(tuple, pairs.select("image", "gt_cls", "seq", "gt", "dt", "iou", "dt_cls").collect()))
        got = images.select("image", F.explode(assign.track_pairs(F.col("rows"), "string", threshold)).alias("r")).select("image", "r.*").collect()
        assert len(want) > 100 and sorted(tuple(r)[:-1] for r in got if r.dt is not None) == want
        assert sum(r.objects for r in got) == df.where("is_gt").count() and sorted({(r.image, r.seq, r.gt) for r in got}) == sorted((r.image, r.seq, r.gt) for r in got if r.objects)
