"""Run-list algebra, outlines, owners, maps and rotated boxes against pixel loops on ragged masks, and error shares by hand."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.functions import masks, points, rotated, runs
from framelake.operators import evaluation, shapes

RUNS = pa.list_(pa.int32())


@pytest.fixture(scope="module")
def batches(spark):
    """Batches of masks of many sizes: (h, w, a, b) a row, with empty and full ones."""
    rng = np.random.default_rng(0)
    out = []
    for _ in range(120):
        n = rng.integers(1, 7)
        h, w = rng.integers(1, 10, n), rng.integers(1, 10, n)
        a, b = ([rng.random((y, x)) < rng.choice([0, 0.3, 0.6, 1]) for y, x in zip(h, w)] for _ in range(2))
        out.append((h, w, a, b))
    return out


def arrow(some):
    return pa.array([masks.encode(m) for m in some], RUNS)


def test_and_or_difference(batches):
    for _, _, a, b in batches:
        sides, base = runs._sides(arrow(a), arrow(b))
        for rule in (lambda x, y: x & y, lambda x, y: x | y, lambda x, y: x & ~y):
            assert runs._lists(runs._where(sides, base, rule), base).to_pylist() == [masks.encode(rule(x, y)) for x, y in zip(a, b)]
        assert runs.shared_pixels.func(arrow(a), arrow(b)).to_pylist() == [int((x & y).sum()) for x, y in zip(a, b)]


def test_components(batches):
    for h, _, a, _ in batches:
        for m, found in zip(a, runs.components.func(arrow(a), pa.array(h)).to_pylist()):
            labels = masks.components(m)
            assert [p["counts"][0] for p in found] == sorted(p["counts"][0] for p in found)
            parts = [masks.decode(p["counts"], *m.shape) for p in found]
            assert sorted(map(int, (p.sum() for p in parts))) == sorted(int((labels == k).sum()) for k in range(1, labels.max() + 1))
            assert all(p["size"] == x.sum() and len(np.unique(labels[x])) == 1 for p, x in zip(found, parts))


def test_components_of_a_comb_and_a_spiral():
    """Branches that meet only at the far end, in many columns; the union must go through."""
    comb = np.zeros((41, 60), bool)
    comb[::2, :-1] = True
    comb[:, -1] = True
    ring = np.zeros((30, 30), bool)
    for k in range(0, 15, 4):
        ring[k, k : 30 - k] = ring[29 - k, k : 30 - k] = ring[k : 30 - k, k] = ring[k : 30 - k, 29 - k] = True
    got = runs.components.func(arrow([comb, ring]), pa.array([41, 30])).to_pylist()
    assert [len(p) for p in got] == [1, 4] and got[0][0]["size"] == comb.sum()


def test_outlines(batches):
    for h, w, a, _ in batches:
        h, w = pa.array(h), pa.array(w)
        assert runs.boundary.func(arrow(a), h, w).to_pylist() == [masks.encode(masks.boundary(m)) for m in a]
        for reach in (0, 1, 3):
            assert runs.dilated.func(arrow(a), h, w, pa.array([reach] * len(a))).to_pylist() == [masks.encode(masks.dilated(m, 2 * reach + 1)) for m in a]


def test_maps(batches):
    rng = np.random.default_rng(1)
    for h, w, a, _ in batches:
        m = rng.integers(-8, 9, (len(a), 6)) / 4
        m[np.abs(m[:, 0] * m[:, 4] - m[:, 1] * m[:, 3]) < 0.1] = [1, 0, 1, 0, 1, -1]
        want = []
        for mask, q in zip(a, m):
            y, x = np.mgrid[: mask.shape[0], : mask.shape[1]] + 0.5
            u, v = np.floor(q[0] * x + q[1] * y + q[2]).astype(int), np.floor(q[3] * x + q[4] * y + q[5]).astype(int)
            inside = (u >= 0) & (u < mask.shape[1]) & (v >= 0) & (v < mask.shape[0])
            want.append(masks.encode(inside & mask[np.where(inside, v, 0), np.where(inside, u, 0)]))
        assert runs.mapped.func(arrow(a), pa.array(h), pa.array(w), pa.array(m.tolist())).to_pylist() == want


def test_resizing():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 12, (80, 4))
    grids = [rng.integers(-5, 6, (gh, gw)).astype(float) for gh, gw, _, _ in sizes]
    got = runs.resized.func(pa.array([g.ravel().tolist() for g in grids]), *(pa.array(sizes[:, k]) for k in range(4)), pa.array([0.1] * 80)).to_pylist()
    for g, (gh, gw, h, w), counts in zip(grids, sizes.tolist(), got):
        want = np.zeros((h, w), bool)
        for y in range(h):
            for x in range(w):
                sy, sx = max((y + 0.5) * gh / h - 0.5, 0), max((x + 0.5) * gw / w - 0.5, 0)
                i, j, i2, j2 = int(sy), int(sx), min(int(sy) + 1, gh - 1), min(int(sx) + 1, gw - 1)
                fy, fx = sy - i, sx - j
                want[y, x] = (g[i, j] * (1 - fy) + g[i2, j] * fy) * (1 - fx) + (g[i, j2] * (1 - fy) + g[i2, j2] * fy) * fx > 0.1
        assert counts == masks.encode(want)


def test_columns_with_nulls_and_wrong_sizes(spark):
    df = spark.createDataFrame([([2, 2], [0, 3, 1], 2), (None, [0, 4], 2), ([4], None, 2), ([0, 4], [4], 2)], "a array<int>, b array<int>, h int")
    got = df.select(runs.both("a", "b").alias("i"), runs.either("a", "b").alias("u"), runs.without("a", "b").alias("d"), runs.outside(F.col("a")).alias("o"), runs.components("a", "h").alias("c")).collect()
    assert [tuple(r)[:4] for r in got] == [([2, 1, 1], [0, 4], [3, 1], [0, 2, 2]), (None, None, None, None), (None, None, None, [0, 4]), ([4], [0, 4], [0, 4], [4])]
    assert got[1].c is None and got[2].c == [] and got[3].c[0].size == 4
    with pytest.raises(Exception, match="different sizes"):
        spark.createDataFrame([([4], [5])], "a array<int>, b array<int>").select(runs.both("a", "b")).collect()


def test_error_points(spark):
    """Every error pixel can be drawn, with its label; agreement draws the background; a full and perfect mask gives (0, 0)."""
    truth, found = np.zeros((4, 5), bool), np.zeros((4, 5), bool)
    truth[1:3, 1:4], found[2:4, 2:5] = True, True
    rows = [(masks.encode(t), None if f is None else masks.encode(f), k / 40) for t, f in ((truth, found), (truth, truth), (np.ones((4, 5), bool), np.ones((4, 5), bool)), (truth, None)) for k in range(40)]
    df = spark.createDataFrame(rows, "t array<int>, f array<int>, u double")
    got = [r.p for r in df.select(runs.error_point(F.col("t"), F.col("f"), F.lit(4), F.col("u")).alias("p")).collect()]
    wrong = {(int(x), int(y), int(truth[y, x])) for y, x in zip(*np.nonzero(truth != found))}
    assert {tuple(p) for p in got[:40]} == wrong
    assert {tuple(p) for p in got[40:80]} == {(int(x), int(y), 0) for y, x in zip(*np.nonzero(~truth))}
    assert {tuple(p) for p in got[80:120]} == {(0, 0, 0)} and {tuple(p) for p in got[120:]} == {(int(x), int(y), 1) for y, x in zip(*np.nonzero(truth))}


def test_unions_and_cleaning(spark, batches):
    """Unions of any number of masks; holes and specks as in dense masks."""
    for _, _, a, b in batches[:40]:
        lists = pa.array([[masks.encode(x), masks.encode(y), masks.encode(x)] if k % 3 else [] for k, (x, y) in enumerate(zip(a, b))], pa.list_(RUNS))
        want = [masks.encode(x | y if k % 3 else np.zeros_like(x)) for k, (x, y) in enumerate(zip(a, b))]
        assert runs.union_of.func(lists, pa.array([x.size for x in a])).to_pylist() == want
    rng = np.random.default_rng(6)
    some = [rng.random((20, 22)) < p for p in (0, 0.2, 0.5, 0.7, 0.9, 1) for _ in range(6)]
    df = spark.createDataFrame([(k, masks.encode(m), most) for k, m in enumerate(some) for most in (0, 1, 4, 30)], "k int, counts array<int>, most int")
    for r in df.select("k", "most", runs.cleaned("counts", F.lit(20), "most").alias("c")).collect():
        assert r.c == masks.encode(points.without_specks(some[r.k], r.most))


def test_owners(spark):
    """Pixels of overlapping ragged masks go to the best, ties to the least name, as in a loop over pixels; an empty and a null mask."""
    rng = np.random.default_rng(3)
    rows = [(g, k, float(rng.integers(0, 4)), rng.random((9, 11)) < rng.choice([0, 0.4, 0.8])) for g in range(5) for k in range(7)]
    df = spark.createDataFrame([(g, k, s, masks.encode(m), "x") for g, k, s, m in rows] + [(0, 99, 9.0, None, "x")], "g int, name int, score double, counts array<int>, owned_by string")
    got = {(r.g, r.name): r.owned for r in shapes.owned_masks(df, ["g"], "counts", "score", "name").collect()}
    for g in range(5):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[2], x[1]))
        taken = np.zeros((9, 11), bool)
        for _, k, _, m in own:
            assert got[g, k] == masks.encode(m & ~taken)
            taken |= m
    assert len(got) == 35


def test_region_and_outline(spark):
    """Against dense masks; groups of one side alone are -1, masks that meet nothing count 0."""
    rng = np.random.default_rng(4)

    def blob(x, y):
        m = np.zeros((40, 50), bool)
        m[y : y + 12, x : x + 15] = rng.random((12, 15)) < 0.9
        return m

    truth = {(1, 1): blob(2, 2), (1, 2): blob(25, 20), (2, 1): blob(5, 5), (3, 1): blob(2, 2)}
    found = {(1, 7): blob(4, 3), (1, 8): blob(26, 22), (1, 9): blob(30, 2), (2, 7): blob(30, 25), (4, 7): blob(2, 2)}
    side = lambda some: spark.createDataFrame([(*k, masks.encode(m)) for k, m in some.items()], "g int, obj int, counts array<int>")
    got = {r.g: r for r in shapes.region_and_outline(side(truth), side(found), ["g"], F.lit(40), F.lit(50)).collect()}
    j = [(truth[1, a] & found[1, b]).sum() / (truth[1, a] | found[1, b]).sum() for a, b in ((1, 7), (2, 8))]
    f = [masks.boundary_f(found[1, b], truth[1, a], 1) for a, b in ((1, 7), (2, 8))]
    assert got[1].n == 2 and abs(got[1].j - np.mean(j)) < 1e-8 and abs(got[1].f - np.mean(f)) < 1e-8 and abs(got[1].jf - (np.mean(j) + np.mean(f)) / 2) < 1e-8
    assert (got[2].n, got[2].j, got[2].f) == (1, 0.0, 0.0) and [(got[g].n, got[g].jf) for g in (3, 4)] == [(0, -1.0)] * 2


def test_affine_attempts(spark):
    """The first attempt that leaves the first frame's masks in sight; without one nothing changes; later frames may lose a mask."""
    m = np.zeros((6, 8), bool)
    m[1:3, 1:4] = True
    low = np.zeros((6, 8), bool)
    low[5, 7] = True
    counts, away, move = masks.encode(m), [1.0, 0.0, 50.0, 0.0, 1.0, 0.0], [1.0, 0.0, -2.0, 0.0, 1.0, -1.0]
    objects = [(1, 0, "a", counts), (1, 1, "b", masks.encode(low)), (2, 0, "a", counts), (2, 3, "b", None), (3, 0, "n", None)]
    tries = [(1, 1, away), (1, 2, move), (2, 1, away), (2, 2, away), (3, 1, move)]
    df = spark.createDataFrame(objects, "g int, frame int, name string, counts array<int>")
    got = {(r.g, r.name): r for r in shapes.affine_masks(df, spark.createDataFrame(tries, "g int, attempt int, matrix array<double>"), ["g"], "frame", F.lit(6), F.lit(8)).collect()}
    moved = np.roll(np.roll(m, 2, axis=1), 1, axis=0)
    assert (got[1, "a"].attempt, got[1, "a"].counts, got[1, "a"].box) == (2, masks.encode(moved), [3, 2, 6, 4])
    assert (got[1, "b"].attempt, got[1, "b"].counts, got[1, "b"].box) == (2, [48], None)
    assert (got[2, "a"].attempt, got[2, "a"].counts, got[2, "a"].box) == (None, counts, [1, 1, 4, 3]) and got[2, "b"].counts is None and got[3, "n"].counts is None


def test_affine_matrix(spark):
    """A quarter turn, a scale and a move about the centre; the map goes from the result to the source."""
    one = lambda *v: spark.range(1).select(runs.affine_matrix(*map(F.lit, v)).alias("m")).first().m
    at = lambda m, x, y: (round(m[0] * x + m[1] * y + m[2], 9), round(m[3] * x + m[4] * y + m[5], 9))
    assert at(one(0.0, 3.0, -2.0, 1.0, 0.0, 0.0, 10, 8), 5, 4) == (2, 6)
    assert at(one(0.0, 0.0, 0.0, 2.0, 0.0, 0.0, 10, 8), 9, 4) == (7, 4)
    turned = one(90.0, 0.0, 0.0, 1.0, 0.0, 0.0, 10, 10)
    assert at(turned, 5, 5) == (5, 5) and at(turned, 9, 5) in ((5, 1), (5, 9))
    skew = one(0.0, 0.0, 0.0, 1.0, 45.0, 0.0, 10, 10)
    assert at(skew, 5, 5) == (5, 5) and at(skew, 5, 6)[1] == 6 and abs(at(skew, 5, 6)[0] - 5) == 1


def test_rotated_overlap(spark):
    """Against a fine raster; boxes inside one another, equal, apart, touching, and empty."""
    rng = random.Random(5)
    rows = [tuple(rng.uniform(-3, 3) for _ in range(2)) + (rng.uniform(1, 6), rng.uniform(1, 6), rng.uniform(-180, 360)) + tuple(rng.uniform(-3, 3) for _ in range(2)) + (rng.uniform(1, 6), rng.uniform(1, 6), rng.uniform(-180, 360)) for _ in range(40)]
    exact = [((0, 0, 4, 2, 0, 0, 0, 2, 1, 90), 0.25), ((0, 0, 4, 2, 33, 0, 0, 4, 2, 33), 1.0), ((0, 0, 4, 2, 0, 9, 9, 4, 2, 45), 0.0), ((0, 0, 4, 2, 0, 4, 0, 4, 2, 0), 0.0), ((0, 0, 4, 2, 0, 0, 0, 0, 2, 0), 0.0), ((0, 0, 2, 2, 45, 0, 0, 2, 2, 0), None)]
    names = [f"{s}{k}" for s in "ab" for k in ("x", "y", "w", "h", "t")]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows + [r for r, _ in exact]], ", ".join(f"{n} double" for n in names))
    box = lambda s: rotated.corners(*(F.col(f"{s}{k}") for k in ("x", "y", "w", "h", "t")))
    got = [r.v for r in df.select(rotated.iou(box("a"), box("b"), F.col("aw") * F.col("ah"), F.col("bw") * F.col("bh")).alias("v")).collect()]
    y, x = np.mgrid[-9:9:0.02, -9:9:0.02] + 0.01

    def inside(cx, cy, w, h, t):
        c, s = np.cos(np.radians(t)), np.sin(np.radians(t))
        dx, dy = c * (x - cx) - s * (y - cy), s * (x - cx) + c * (y - cy)
        return (np.abs(dx) <= w / 2) & (np.abs(dy) <= h / 2)

    for r, v in zip(rows, got):
        a, b = inside(*r[:5]), inside(*r[5:])
        assert abs(v - (a & b).sum() / (a | b).sum()) < 0.01
    assert all(want is None or abs(v - want) < 1e-9 for (_, want), v in zip(exact, got[40:]))
    octagon = 4 * 0.8284271247461902
    assert abs(got[-1] - octagon / (8 - octagon)) < 1e-9


def test_error_shares_by_hand(spark):
    """One image, classes a and b: a hit, its double, a box near another object, a class mistaken, a wrong class far off, background, and two objects that nothing finds."""
    gt = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "b"), (1, 5, "a")], "i int, gt long, c string")
    dt = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "a", 0.8), (1, 3, "a", 0.7), (1, 4, "a", 0.6), (1, 5, "a", 0.5), (1, 6, "a", 0.4), (1, 7, "a", 0.3)], "i int, dt long, c string, score double")
    pairs = [(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 3, 0.3), (1, 3, 4, 0.7), (1, 4, 5, 0.2), (1, 2, 7, 0.2)]
    hits = spark.createDataFrame([(1, 1, 1)], "i int, gt long, dt long")
    typed, found = evaluation.error_types(gt, dt, spark.createDataFrame(pairs, "i int, gt long, dt long, iou double"), hits, ["i"], "c")
    kinds = {r.dt: (r.error, r.mends) for r in typed.collect()}
    assert kinds == {1: (None, None), 2: ("double", None), 3: ("box", 2), 4: ("class", 3), 5: ("both", None), 6: ("background", None), 7: ("box", None)}
    assert {r.gt for r in found.collect() if r.missed} == {4, 5}
    got = {r.error: (r.n, r.lost) for r in evaluation.precision_lost(found, typed, ["i"], "c").collect()}
    ap = lambda steps: sum(max((p for r, p in steps if r >= k / 100), default=0.0) for k in range(101)) / 101
    plain = ap([(1 / 3, 1.0)]) / 2  # of class a, one of three is found first; class b finds nothing
    assert abs(got["none"][1] - plain) < 1e-6
    want = {
        "box": (2, ap([(1 / 3, 1.0), (2 / 3, 2 / 3)]) / 2), "class": (1, (ap([(1 / 3, 1.0)]) + ap([(1 / 2, 1.0)])) / 2), "both": (1, plain), "double": (1, plain), "background": (1, plain),
        "missed": (2, (ap([(1 / 2, 1.0)]) + 0) / 2), "false_positive": (6, plain), "false_negative": (4, 1.0),
    }
    assert {e: n for e, (n, _) in got.items() if e != "none"} == {e: n for e, (n, _) in want.items()}
    assert all(abs(got[e][1] - (v - plain)) < 2e-6 for e, (_, v) in want.items())
    nothing = evaluation.precision_lost(*reversed(evaluation.error_types(gt, dt.limit(0), spark.createDataFrame([], "i int, gt long, dt long, iou double"), hits.limit(0), ["i"], "c")), ["i"], "c")
    assert {r.error: r.n for r in nothing.collect()}["missed"] == 5
