import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import masks, points, text
from framelake.operators import evaluation, metrics, records
from framelake.sources import documents


def _naive_ids(word, codec):
    parts = [codec.byte[b] for b in word.encode()]
    parts[-1] += "</w>"
    while True:
        pairs = [(codec.rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in codec.rank]
        if not pairs:
            return [codec.id_of[p] for p in parts]
        rank, _ = min(pairs)
        k = 0
        while k < len(parts) - 1:
            if codec.rank.get((parts[k], parts[k + 1])) == rank:
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            k += 1


MERGES = [("t", "h"), ("th", "e</w>"), ("a", "a"), ("i", "n"), ("in", "g</w>"), ("aa", "aa</w>"), ("r", "e"), ("l", "l</w>"), ("s", "t"), ("Ã", "©")]


def test_codec(spark):
    codec = text.Codec(MERGES)
    rng = random.Random(1)
    for _ in range(500):
        word = "".join(rng.choice("thaeingrlsé") for _ in range(rng.randint(1, 12)))
        assert codec.word(word) == _naive_ids(word, codec)
    phrases = ["The  thing's\tin 2 halls!", "&amp;lt;b&amp;gt; café", "aaaa aaa", "", None, "<start_of_text> the"]
    df = spark.createDataFrame(list(enumerate(phrases)), "id int, t string")
    words = text.words(text.cleaned(F.col("t"), "lower"), ("<start_of_text>", "<end_of_text>"))
    ids = df.withColumn("w", words).withColumn("ids", text.encoded(F.col("w"), MERGES))
    out = ids.withColumn("back", text.decoded(F.col("ids"), MERGES)).withColumn("frame", text.framed(F.col("ids"), 900, 901, 8)).orderBy("id").collect()
    assert out[0].w == ["the", "thing", "'s", "in", "2", "halls", "!"] and out[0].back == "the thing 's in 2 halls ! "
    assert out[1].w == ["<", "b", ">", "café"] and out[3].w == [] and out[4].w is None and out[5].w[0] == "<start_of_text>"
    for r in out[:4]:
        assert r.ids == [k for w in r.w for k in codec.word(w)]
        assert len(r.frame) == 8 and r.frame[0] == 900 and 901 in r.frame
    assert out[0].frame[-1] == 901 and out[3].frame == [900, 901] + [0] * 6
    kept = spark.range(1).select(text.canonical_keeping(F.lit("A {} of_the {x}, {}!"), "{}").alias("k"), text.symbol_pairs(F.array(*map(F.lit, "abab"))).alias("p"), text.cleaned(F.lit(" A  b. "), "whitespace").alias("c")).first()
    assert kept.k == "a {} of the x {}" and [tuple(p) for p in kept.p] == [("a", "b"), ("b", "a")] and kept.c == "A b."


def test_distances_and_points(spark):
    rng = np.random.default_rng(2)
    for _ in range(60):
        m = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.7
        want = np.array([[min([((y - b) ** 2 + (x - a) ** 2) for b, a in np.argwhere(~m)], default=None) if m[y, x] else 0 for x in range(m.shape[1])] for y in range(m.shape[0])])
        if (~m).any():
            assert (points.squared_distance(m) == want).all()
    truth, found = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    truth[2:11, 2:9], found[2:5, 2:9], found[15:18, 15:18] = True, True, True
    rows = [(1, masks.encode(truth), masks.encode(found)), (2, masks.encode(found), masks.encode(truth)), (3, masks.encode(truth), masks.encode(truth))]
    df = spark.createDataFrame(rows, "id int, t array<int>, f array<int>")
    got = {r.id: tuple(r.p) for r in df.select("id", points.error_centre("t", "f", F.lit(20), F.lit(20)).alias("p")).collect()}
    assert got[1] == (4, 7, 1) and got[2] == (4, 7, 0) and got[3][2] == 0
    inner = df.where("id = 1").select(points.inner_points("t", F.lit(20), F.lit(20), F.lit(3)).alias("p")).first().p
    assert tuple(inner[0]) == (5, 5) and len({tuple(p) for p in inner}) == 3 and all(truth[p.y, p.x] for p in inner)
    every = df.where("id = 1").select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"), "t").select("k", points.pixel(F.col("t"), F.col("k"), F.lit(20)).alias("p"), points.covers(F.col("t"), F.col("k") % 8, F.col("k") % 13, F.lit(20)).alias("c")).orderBy("k").collect()
    flat = [(int(x), int(y)) for x, y in np.argwhere(truth.T)]
    assert [tuple(r.p) if r.p else None for r in every] == [*flat, None] and all(r.c == bool(truth[r.k % 13, r.k % 8]) for r in every)


def test_rasters_and_specks(spark):
    square, hole = [2.0, 2.0, 12.0, 2.0, 12.0, 8.0, 2.0, 8.0], [0.0, 0.0, 20.0, 0.0, 0.0, 20.0]
    m = points.raster([square], 20, 20)
    assert m.sum() == 60 and m[2:8, 2:12].all()
    t = points.raster([hole], 20, 20)
    assert all(t[y, x] == (x + y + 1 < 20) for y in range(20) for x in range(20))
    runs = spark.createDataFrame([([square, hole],)], "p array<array<double>>").select(points.polygon_mask("p", F.lit(20), F.lit(20)).alias("m")).first().m
    assert (masks.decode(runs, 20, 20) == (m | t)).all()
    m = np.zeros((12, 12), bool)
    m[1:9, 1:9], m[3:5, 3:5], m[11, 11] = True, False, True
    clean = points.without_specks(m, 4)
    assert clean[1:9, 1:9].all() and not clean[11, 11] and clean.sum() == 64
    assert (points.without_specks(m, 0) == m).all() and points.without_specks(m, 3)[3, 3] == 0
    own = spark.createDataFrame([(masks.encode(m),)], "m array<int>").select(points.cleaned_mask("m", F.lit(12), F.lit(12), F.lit(4)).alias("c")).first().c
    assert (masks.decode(own, 12, 12) == clean).all()


def test_readers(spark, tmp_path):
    (tmp_path / "log.json").write_text("".join(json.dumps({"epoch": k, "ap": k / 10}) + "\n" for k in range(5)))
    assert tuple(documents.read_last_row(spark, str(tmp_path / "log.json"), "epoch long, ap double").first()) == (4, 0.4)
    for name in ("a/config.yaml", "b/c/config.yaml", "b/skip/config.yaml", "b/other.txt"):
        (tmp_path / "runs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / name).write_text("x")
    found = documents.list_files(spark, str(tmp_path / "runs"), "config.yaml", "skip")
    assert sorted(r.path.rsplit("runs/")[1] for r in found.collect()) == ["a/config.yaml", "b/c/config.yaml"]
    (tmp_path / "tracks.txt").write_text("1.0, 7, car, 0\n2, 8, van, 1\n")
    got = documents.read_text_tracks(spark, str(tmp_path / "tracks.txt"), ",", ["frame", "id", "class", "crowd"], "frame", "id", {"crowd": ["1"]}, {"class": {"van": "car"}}).select("t", "track", "class", "ignored").collect()
    assert [tuple(r) for r in got] == [(1, 7, "car", False), (2, 8, "car", True)]
    table = spark.createDataFrame([(1, 0.5, "x")], "id int, score double, name string")
    documents.write_table(table, str(tmp_path / "t.csv"), "name")
    assert tuple(documents.read_table(spark, str(tmp_path / "t.csv"), "name string, id int, score double").first()) == ("x", 1, 0.5)
    tracks = spark.createDataFrame([(1, 2, 0.5, [[0.123456, 1.0, 2.0, 3.0], None])], "video_id int, category_id int, score double, bboxes array<array<double>>")
    documents.write_tracks(tracks, str(tmp_path / "tracks.json"))
    assert tuple(spark.read.json(str(tmp_path / "tracks.json")).first().bboxes) == ([0.12346, 1.0, 2.0, 3.0], None)
    clips = spark.createDataFrame([("a", "v", 1, 4), ("b", "w", 2, 9)], "id string, yt_video_id string, start_time int, end_time int")
    assert [(r.length, r.video) for r in documents.wanted_clips(clips, spark.createDataFrame([("b",), ("b",)], "id string"), "id").collect()] == [(7, "w_2_9")]
    sizes = spark.createDataFrame([(10, 10, float("nan")), (10, 10, 50.0), (5, 10, 50.0)], "w int, h int, m double")
    assert [r[0] for r in sizes.select(documents.media_source("w", "h", "m")).collect()] == ["full", "scaled", "full"]


def test_checks_fail_loudly(spark):
    images = spark.createDataFrame([(1, 1, 0)], "image_id long, video_id long, frame long")
    results = spark.createDataFrame([(2, [0.0, 0.0, 1.0, 1.0])], "image_id long, bbox array<double>")
    with pytest.raises(Exception, match="no image for 2"):
        records.loaded_results(results, images).collect()
    twice = spark.createDataFrame([(0, 1, 5), (0, 1, 5)], "seq long, t long, track long")
    with pytest.raises(Exception, match="stands twice"):
        records.dense_relabelled(twice, ["seq"], "track").collect()
    uneven = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0)], "video_id long, stage long, place long")
    with pytest.raises(Exception, match="differ in their number"):
        records.same_queries_per_frame(uneven, ["video_id"], "stage", "place", 1, 3).collect()
    pairs = spark.createDataFrame([(1, 7, "cat")], "video_id long, category_id long, noun_phrase string")
    with pytest.raises(Exception, match="differ: cat"):
        records.phrase_pairs(pairs, spark.createDataFrame([(7, "dog")], "id long, name string")).collect()


def test_numbering_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(records, "RANGE", 4)
    rng = random.Random(3)
    rows = [(rng.randrange(200), k) for k in range(300)]
    got = records.numbered(spark.createDataFrame(rows, "key long, k long"), "n", "key", "k").collect()
    assert [(r.key, r.k) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(1, 301))


def test_small_records(spark):
    df = spark.createDataFrame([(1, 4, 5, [[3, 4, 13], [0, 20]], [0.5, 0.9], [1, 2])], "image_id long, height int, width int, masks array<array<int>>, scores array<double>, labels array<int>")
    assert [(r.category_id, r.area) for r in records.masks_to_rows(df, ["image_id"], "height", "width").collect()] == [(1, 0.2), (2, 1.0)]
    tracks = spark.createDataFrame([(1, "b", ["x", None]), (1, "a", ["y", "z"]), (2, "c", ["q", "r"])], "video_id long, noun_phrase string, segmentations array<string>")
    assert [tuple(r) for r in records.annotations_of_frame(tracks, 1, 0).collect()] == [("a", "y"), ("b", "x")]
    assert [tuple(r) for r in records.annotations_of_frame(tracks, 1, 1).collect()] == [("a", "z")]


def test_evaluation_by_hand(spark):
    """Track overlap of hand case: identical, half overlapping and one-sided frames give 150 / 300."""
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    gt = spark.createDataFrame([(1, 1, 0, (0.0, 0.0, 10.0, 10.0)), (1, 1, 1, (0.0, 0.0, 5.0, 15.0))], f"v long, gt long, t long, box {box}")
    dt = spark.createDataFrame([(1, 9, 0, (0.0, 0.0, 10.0, 10.0)), (1, 9, 1, (0.0, 0.0, 5.0, 15.0)), (1, 9, 2, (0.0, 0.0, 7.0, 25.0))], f"v long, dt long, t long, box {box}")
    assert evaluation.track_overlap(gt, dt, ["v"]).first().iou == pytest.approx(0.5)
    pairs = spark.createDataFrame([(1, 1), (2, 1)], "v long, c long")
    none = pairs.limit(0)
    rows = evaluation.phrase_rows(pairs, none, none, none.withColumn("iou", F.lit(1.0)), ["v", "c"]).collect()
    assert len(rows) == 2 * len(metrics.THRESHOLDS) and all(r.f1 == 1.0 and r.tp == 0 for r in rows)
    values = spark.createDataFrame([(0.123456,), (0.0,), (12.34567,)], "v double")
    assert [r.v for r in evaluation.formatted(values, ["v"]).collect()] == ["0.12346", "0.00000", "12.34600"]
