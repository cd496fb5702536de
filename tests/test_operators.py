import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import boxes, masks
from framelake.operators import assign, metrics, sequences, suppress
from framelake.sources import documents
from framelake.streaming.lifecycle import track_objects


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 6, (n, m)).astype(float)
        pairs = assign.solve(cost)
        k = int(min(n, m))
        small, large = (range(n), range(m)) if n <= m else (range(m), range(n))
        value = lambda p: sum((cost[i, j] if n <= m else cost[j, i]) for i, j in zip(small, p))
        best = min(value(p) for p in itertools.permutations(large, k))
        assert len(pairs) == k and len({i for i, _ in pairs}) == k == len({j for _, j in pairs})
        assert sum(cost[i, j] for i, j in pairs) == best
    assert assign.solve(np.zeros((0, 3))) == []


def _images(spark, images, matched):
    n = spark.createDataFrame(images, "image_id long, num_gt long, num_dt long")
    m = spark.createDataFrame(matched, "image_id long, iou double")
    return metrics.classification_gated_f1(metrics.image_counts(n, m, ["image_id"])).first()


def test_gated_f1_by_hand(spark):
    matched = [(0, 1.0), (0, 0.62)]
    one = _images(spark, [(0, 2, 2), (1, 1, 0), (2, 0, 1), (3, 0, 0)], matched)
    assert one.precision == one.recall == pytest.approx(0.433319, abs=1e-6) and one.il_mcc == 0
    assert one.positive_micro_f1 == pytest.approx(0.519931, abs=1e-6) and one.positive_macro_f1 == pytest.approx(0.649918, abs=1e-6)
    assert one.positive_w0dt_macro_f1 == pytest.approx(0.324959, abs=1e-6)
    three = _images(spark, [(0, 2, 2), (1, 1, 0), (2, 0, 1), (3, 0, 0), (4, 0, 0), (5, 0, 0)], matched)
    assert three.il_mcc == pytest.approx(0.25, abs=1e-6) and three.cgf1 == pytest.approx(0.129983, abs=1e-6)


def test_hota_by_hand(spark):
    gt = spark.createDataFrame([(0, t, 1) for t in range(4)] + [(1, 0, 1)], "seq long, t long, gt long")
    trk = spark.createDataFrame([(0, t, 10 if t < 2 else 11) for t in range(4)], "seq long, t long, dt long")
    sim = spark.createDataFrame([(0, t, 1, 10 if t < 2 else 11, 1.0) for t in range(4)], "seq long, t long, gt long, dt long, iou double")
    found = metrics.hota(gt, trk, sim)
    rows = found.where("seq = 0").collect()
    assert len(rows) == 19
    for r in rows:
        assert (r.det_a, r.ass_a, r.ass_re, r.ass_pr) == (1, 0.5, 0.5, 1) and r.hota == pytest.approx(0.707107, abs=1e-6)
    alone = found.where("seq = 1").first()
    assert alone.loc_a == 1 and alone.hota == 0 and alone.fn == 1
    both = metrics.combine_hota(found).first()
    assert (both.tp, both.fn, both.fp) == (4, 1, 0) and both.det_a == pytest.approx(0.8)


def test_teta_by_hand(spark):
    gt = [(0, t, 1, "a") for t in range(4)]
    trk = [(0, t, 10 if t < 2 else 11, "a" if t < 3 else "b") for t in range(4)] + [(0, 0, 12, "a")]
    sim = [(0, t, 1, 10 if t < 2 else 11, 1.0) for t in range(4)] + [(0, 0, 1, 12, 0.6)]
    make = lambda rows, names: spark.createDataFrame(rows, names)
    r = metrics.teta(make(gt, "seq long, t long, gt long, cls string"), make(trk, "seq long, t long, dt long, cls string"), make(sim, "seq long, t long, gt long, dt long, iou double")).first()
    assert r.loc_a == pytest.approx(4 / 5) and r.loc_re == 1 and r.loc_pr == pytest.approx(4 / 5)  # track 12 is near, and not matched
    assert (r.assoc_a, r.assoc_re, r.assoc_pr) == (0.5, 0.5, 1) and r.cls_a == 0.75 and r.cls_pr == 1
    assert r.teta == pytest.approx((0.8 + 0.5 + 0.75) / 3)


def test_suppression_at_the_threshold(spark):
    rows = [(0, 0, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 1, 0.8, 0.0, 0.0, 10.0, 5.0)]  # IoU is exactly 0.5
    df = spark.createDataFrame(rows, "image_id long, obj long, score double, x0 double, y0 double, x1 double, y1 double")
    assert suppress.greedy_suppress(df, ["image_id"], 0.5, strict=True).count() == 2
    assert suppress.greedy_suppress(df, ["image_id"], 0.5, strict=False).count() == 1
    once = suppress.greedy_suppress(df, ["image_id"], 0.2)
    assert suppress.greedy_suppress(once, ["image_id"], 0.2).collect() == once.collect()


def test_less_recent(spark):
    pairs = spark.createDataFrame([(1, 2, 5, 3, 0.8), (3, 4, 5, -1, 0.8), (5, 6, 2, 9, 0.9), (7, 8, 1, 9, 0.1)], "a long, b long, last_a long, last_b long, iou double")
    assert {r.track for r in suppress.less_recent(pairs, 0.7).collect()} == {1, 6}
    assert {r.track for r in suppress.less_recent(pairs, 0.7, reverse=True).collect()} == {2, 4, 5}


def test_average_precision_by_hand(spark):
    ranked = spark.createDataFrame([("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.7, 1)], "k string, score double, tp int")
    n = spark.createDataFrame([("a", 2)], "k string, n_gt long")
    ap = metrics.average_precision(ranked, n, ["k"]).first().ap
    assert ap == pytest.approx((51 * 1.0 + 50 * 2 / 3) / 101)


def test_runs_of_masks():
    rng = np.random.default_rng(2)
    for _ in range(60):
        h, w = rng.integers(1, 12, 2)
        a, b = (rng.random((h, w)) < rng.random() for _ in range(2))
        ca, cb = masks.encode(a), masks.encode(b)
        assert (masks.decode(ca, h, w) == a).all() and masks.from_string(masks.to_string(ca)) == ca
        assert masks.intersection(ca, cb) == int((a & b).sum())
        ys, xs = np.nonzero(a)
        assert masks.bounds(ca, h) == ([int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1] if len(xs) else None)
    long = [0, 100000, 3, 40, 1, 2, 70000]
    assert masks.from_string(masks.to_string(long)) == long


def test_mask_shapes(spark):
    rng = np.random.default_rng(5)
    for _ in range(30):
        h, w = (int(x) for x in rng.integers(2, 9, 2))
        m = rng.random((h, w)) < 0.45
        labels, seen = masks.components(m), np.zeros((h, w), int)
        n = 0
        for i in range(h):
            for j in range(w):
                if m[i, j] and not seen[i, j]:
                    n += 1
                    stack = [(i, j)]
                    while stack:
                        a, b = stack.pop()
                        if 0 <= a < h and 0 <= b < w and m[a, b] and not seen[a, b]:
                            seen[a, b] = n
                            stack += [(a + x, b + y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
        assert (labels == seen).all()
        grown = masks.dilated(m, 3)
        assert all(grown[i, j] == m[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].any() for i in range(h) for j in range(w))
        assert masks.boundary_f(m, m, 1) == 1.0
    both = [rng.random((6, 5)) < 0.4 for _ in range(3)]
    df = spark.createDataFrame([([masks.encode(x) for x in both],)], "all array<array<int>>")
    assert (masks.decode(df.select(masks.mask_union("all").alias("u")).first().u, 6, 5) == (both[0] | both[1] | both[2])).all()


def test_box_identities(spark):
    rng = np.random.default_rng(3)
    rows = [tuple(map(float, v)) for v in rng.integers(0, 30, (200, 8))]
    df = spark.createDataFrame(rows, "a0 double, a1 double, a2 double, a3 double, b0 double, b1 double, b2 double, b3 double")
    a = boxes.box(F.least("a0", "a2"), F.least("a1", "a3"), F.greatest("a0", "a2"), F.greatest("a1", "a3"))
    b = boxes.box(F.least("b0", "b2"), F.least("b1", "b3"), F.greatest("b0", "b2"), F.greatest("b1", "b3"))
    for r in df.select(boxes.iou(a, b).alias("x"), boxes.iou(b, a).alias("y"), boxes.giou(a, b).alias("g"), boxes.iou(a, a).alias("s"), boxes.area(a).alias("area")).collect():
        assert r.x == r.y and 0 <= r.x <= 1 and -1 <= r.g <= r.x and (r.s == 1 or r.area == 0)


def test_stream_equals_batch(spark, tmp_path):
    from framelake.plans.tracking import _frames

    frames = _frames(spark, "/root/testdata/sf0.001")
    flat = frames.select("session", "object", "frame", "matched")
    for part in range(3):  # in order of time
        flat.where(f"floor(frame / 10) = {part}" if part < 2 else "frame >= 20").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    batches = [spark.read.parquet(str(tmp_path / f"in/{k}")) for k in range(3)]
    source = tmp_path / "source"
    out: list = []
    query = None
    for k, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(flat.schema).parquet(str(source))
        query = track_objects(stream, delay=15, misses=8).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    got = {(r.session, r.object, r.frame): (r.run, r.confirmed) for r in out}
    want = {(r.session, r.object, r.frame): (r.run, r.confirmed) for r in sequences.confirmed(frames, ["session", "object"], "matched", 3).collect()}
    assert got == want
    removed = {(r.session, r.object) for r in out if r.removed}
    assert removed == {(r.session, r.object) for r in sequences.hotstart_removed(frames, ["session", "object"], "matched", 15, 8).collect()}
    alive = {(r.session, r.object, r.frame): r.alive for r in out}
    assert alive == {(r.session, r.object, r.frame): r.alive for r in sequences.kept_alive(frames, ["session", "object"], "matched", 0, 30, -1).collect()}


def test_annotation_documents(spark, tmp_path):
    doc = {
        "images": [{"id": 2, "file_name": "b.jpg", "text_input": "cat", "width": 10, "height": 8, "queried_category": "1", "is_instance_exhaustive": 1}, {"id": 1, "file_name": "a.jpg", "width": 4, "height": 4}],
        "annotations": [{"id": 7, "image_id": 2, "area": 0.5, "bbox": [0.1, 0.2, 0.3, 0.4], "segmentation": {"counts": "05", "size": [8, 10]}, "category_id": 1, "iscrowd": 0}],
        "categories": [{"id": 1, "name": "cat"}],
    }
    path = tmp_path / "gt.json"
    path.write_text(json.dumps(doc, indent=1))
    images, annotations = documents.read_images(spark, str(path)), documents.read_annotations(spark, str(path))
    assert {r.id: len(r.annotations) for r in documents.images_with_annotations(images, annotations).collect()} == {1: 0, 2: 1}
    assert documents.read_categories(spark, str(path)).first().name == "cat" and images.where("id = 1").first().text_input is None
    p = spark.createDataFrame([(1, 1, [0.123456789, 1.0, 2.0, 3.0], 0.987654321, None, 1.0)], documents.PREDICTIONS)
    documents.write_predictions(p, str(tmp_path / "p"))
    back = documents.read_predictions(spark, str(tmp_path / "p")).first()
    assert back.bbox[0] == 0.12346 and back.score == 0.98765


def test_sessions(spark, tmp_path):
    import random

    from framelake.streaming.sessions import apply_command, run_sessions

    rng = random.Random(1)
    rows = [(rng.randrange(4), k, rng.choice(["start", "add", "add", "add", "remove", "propagate", "reset", "close", "other"]), rng.choice("abc")) for k in range(200)]
    schema = "session long, seq long, command string, object string"
    out: list = []
    for part in range(2):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = run_sessions(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    states: dict = {}
    want = {}
    for session, seq, command, name in rows:
        states[session], ok, number = apply_command(states.get(session), command, name)
        want[seq] = (session, ok, number, len(states[session][1]) if states[session] else 0)
    assert {r.seq: (r.session, r.ok, r.number, r.n_objects) for r in out} == want
    assert any(ok for _, ok, _, _ in want.values()) and not all(ok for _, ok, _, _ in want.values())


def test_category_chunks_beyond_the_hundredth(spark, tmp_path):
    from framelake.plans import tables

    spark.createDataFrame([(f"Brand#{k:03d}", k) for k in range(130)], "p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = tables.category_chunks(spark, str(tmp_path)).collect()
    assert len(got) == 5 * 130 and {r.chunk for r in got} == set(range(33)) and sum(r.n_objects for r in got) == 130
