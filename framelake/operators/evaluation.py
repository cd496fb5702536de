"""Evaluation of detections and of tracks: AP and AR by area, track overlap, per-phrase rows, and the averages of metrics over classes and sequences.

Matching is native: only pairs that reach the least threshold are folded, so a group (an image's category, a video's phrase) without one costs no fold. From there on
everything is a sum by distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.crossed import crossed, lengths

from . import assign, metrics

#: Bands of areas in pixels.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
TRACK_AREAS = {"all": (0.0, 1e10), "small": (0.0, 128.0**2), "medium": (128.0**2, 256.0**2), "large": (256.0**2, 1e10)}


def _in_band(area: Column) -> Column:
    return (area >= F.col("low")) & (area <= F.col("high"))


def _bands(areas: dict[str, tuple[float, float]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, (a, b) in areas.items()])).alias("_band")


def _greedy(rows: Column) -> Column:
    """The rows (neg, dt, ignored, neg_iou, gt, crowd and more, in order) that are taken in turn.

    Best score first, each detection takes the free ground truth of highest IoU, one that is ignored only if no other is left; crowds are never used up.
    """
    start = F.struct(F.array().cast("array<bigint>").alias("gts"), F.lit(None).cast("bigint").alias("last"), F.slice(rows, 1, 0).alias("out"))

    def step(s: Column, r: Column) -> Column:
        free = ~r["dt"].eqNullSafe(s["last"]) & (r["crowd"] | ~F.array_contains(s["gts"], r["gt"]))
        return F.when(free, F.struct(F.concat(s["gts"], F.array(r["gt"])).alias("gts"), r["dt"].alias("last"), F.concat(s["out"], F.array(r)).alias("out"))).otherwise(s)

    return F.aggregate(rows, start, step, lambda s: s["out"])


def best_detections(dt: DataFrame, keys: Sequence[str], most: int = 100) -> DataFrame:
    """The `most` detections of highest score of each group, of equal ones the least numbers."""
    return dt.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "dt"))).where(F.col("_k") <= most).drop("_k")


def precision_recall(gt: DataFrame, dt: DataFrame, pairs: DataFrame, group: Sequence[str], category: str, areas: dict = AREAS) -> DataFrame:
    """ap and recall of each category, band and threshold: gt(category, area, crowd), dt(category, area, score) of best_detections(), and pairs(group, category, gt, gt_area,
    crowd, dt, dt_area, score, iou) of them.

    group and category together name what is matched at a time. Crowds and ground truth outside the band are ignored, and so are detections that match them, and
    unmatched ones outside the band. Detections of equal score count together. Categories without ground truth in a band have no row.

    Pairs are collected by group once, for all bands and thresholds. Where no ground truth and no detection has two, each pair is a hit as far as its overlap reaches, and
    counts by score, that reach and its bands; only the others are folded, for each band and threshold.
    """
    keys = [*group, category]
    names = list(areas)
    bands = [F.col("_band.band").alias("band"), F.col("_band.low").alias("low"), F.col("_band.high").alias("high")]
    thresholds = F.array(*map(F.lit, metrics.THRESHOLDS))
    levels = F.explode(thresholds).alias("thr")
    reach = F.size(F.filter(thresholds, lambda t: F.round(F.col("iou") * 100, 6) >= t))
    within = lambda area, band: (area >= F.lit(areas[band][0])) & (area <= F.lit(areas[band][1]))
    flags = lambda of: sum((F.when(of(n), 1 << k).otherwise(0) for k, n in enumerate(names)), F.lit(0))
    near = pairs.where(F.round(F.col("iou") * 100, 6) >= metrics.THRESHOLDS[0])
    row = F.struct(
        (-F.col("score")).alias("neg"), "dt", (-F.round("iou", 12)).alias("neg_iou"), "gt", "crowd", reach.alias("reach"),
        flags(lambda n: F.col("crowd") | ~within(F.col("gt_area"), n)).alias("ignored"), flags(lambda n: within(F.col("dt_area"), n)).alias("inside"),
    )
    grouped = near.groupBy(*keys).agg(F.collect_list(row).alias("rows"))
    rows = F.col("rows")
    plain = (F.size(F.array_distinct(rows["gt"])) == F.size(rows)) & (F.size(F.array_distinct(rows["dt"])) == F.size(rows))
    # Hits: those of plain groups at all bands (-1) and as many thresholds as they reach, those of folded ones at one band and threshold.
    bit = lambda flags, k: F.call_function("shiftright", flags, k).bitwiseAND(F.lit(1)) == 1
    hit = lambda r, band, thr: F.struct(band.alias("band"), thr.alias("thr"), (-r["neg"]).alias("score"), r["reach"].alias("reach"), r["ignored"].alias("ignored"), r["inside"].alias("inside"))

    def folded(case: Column) -> Column:
        band, thr = F.floor(case / len(metrics.THRESHOLDS)).cast("int"), case % len(metrics.THRESHOLDS)
        skipped = lambda r: F.struct(r["neg"], r["dt"], bit(r["ignored"], band).alias("skip"), r["neg_iou"], r["gt"], r["crowd"], r["reach"], r["ignored"], r["inside"])
        taken = _greedy(F.array_sort(F.transform(F.filter(rows, lambda r: r["reach"] > thr), skipped)))
        return F.transform(taken, lambda r: hit(r, band, thr))

    cases = F.sequence(F.lit(0), F.lit(len(names) * len(metrics.THRESHOLDS) - 1))
    hits = F.when(plain, F.transform(rows, lambda r: hit(r, F.lit(-1), F.lit(-1)))).otherwise(F.flatten(F.transform(cases, folded)))
    counted = grouped.select(category, F.explode(hits).alias("h")).groupBy(category, "h").agg(F.count("*").alias("c")).select(category, "h.*", "c")
    counted = counted.withColumnsRenamed({"band": "_k", "thr": "_i"})
    every = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(k).alias("k"), bit(F.col("ignored"), F.lit(k)).alias("ignored"), bit(F.col("inside"), F.lit(k)).cast("int").alias("inside")) for k, n in enumerate(names)])
    spread = counted.select("*", F.explode(F.filter(every, lambda b: (F.col("_k") == -1) | (F.col("_k") == b["k"]))).alias("b"))
    spread = spread.select(category, "score", "c", "_i", "reach", "b", F.posexplode(thresholds).alias("i", "thr")).where((F.col("_i") == F.col("i")) | ((F.col("_i") == -1) & (F.col("i") < F.col("reach"))))
    inside = F.col("b.inside")
    hit = spread.groupBy(category, F.col("b.band").alias("band"), "thr", "score").agg(
        F.sum(F.when(F.col("b.ignored"), 0).otherwise(F.col("c"))).alias("tp"), F.sum(F.when(F.col("b.ignored"), -inside).otherwise(1 - inside) * F.col("c")).alias("more")
    )
    own = dt.select(category, "score", "area", _bands(areas)).select("*", *bands).where(_in_band(F.col("area"))).groupBy(category, "band", "score").agg(F.count("*").alias("n")).select("*", levels)
    by_score = own.join(hit, [category, "band", "thr", "score"], "full").na.fill(0, ["n", "tp", "more"]).withColumn("n", F.col("n") + F.col("more")).where("n > 0")
    n_gt = gt.where(~F.col("crowd")).select(category, "area", _bands(areas)).select("*", *bands).where(_in_band(F.col("area"))).groupBy(category, "band").agg(F.count("*").alias("n_gt")).select("*", levels)
    at = [category, "band", "thr"]
    ap = metrics.interpolated_precision(by_score, n_gt, at)
    tp = by_score.groupBy(*at).agg(F.sum("tp").alias("tp"))
    out = n_gt.join(ap, at, "left").join(tp, at, "left")
    return out.select(*at, F.coalesce("ap", F.lit(0.0)).alias("ap"), (F.coalesce("tp", F.lit(0)) / F.col("n_gt")).alias("recall"))


def summary(by_level: DataFrame) -> DataFrame:
    """Means over categories (and thresholds) of precision_recall(): ap, ap50, ap75 and ar of each band."""
    at = lambda t: F.avg(F.when(F.col("thr") == t, F.col("ap")))
    return by_level.groupBy("band").agg(F.avg("ap").alias("ap"), at(50).alias("ap50"), at(75).alias("ap75"), F.avg("recall").alias("ar"))


def track_overlap(gt: DataFrame, dt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of tracks with their overlap over all frames: what both cover, over what either covers, frames with one of the two included.

    gt(keys, gt, t, box), dt(keys, dt, t, box), with one box a track and frame.
    """
    from framelake.functions import boxes

    both = gt.select(*keys, "gt", "t", F.col("box").alias("_a")).join(dt.select(*keys, "dt", "t", F.col("box").alias("_b")), [*keys, "t"])
    inter = both.groupBy(*keys, "gt", "dt").agg(F.sum(boxes.intersection(F.col("_a"), F.col("_b"))).alias("_i")).where("_i > 0")
    size = lambda df, name: df.groupBy(*keys, name).agg(F.sum(boxes.area(F.col("box"))).alias(f"_{name}"))
    found = inter.join(size(gt, "gt"), [*keys, "gt"]).join(size(dt, "dt"), [*keys, "dt"])
    return found.select(*keys, "gt", "dt", (F.col("_i") / (F.col("_gt") + F.col("_dt") - F.col("_i"))).alias("iou"))


def track_pairs(rows: DataFrame, keys: Sequence[str], gt: dict[str, Column] | None = None, dt: dict[str, Column] | None = None) -> DataFrame:
    """As track_overlap(), from one table rows(keys, track, t, g, d) of boxes of either side, null where it has none: keys, gt, dt, iou, and gt and dt as columns of each pair's tracks.

    All is windows and groups inside of keys, so rows that lie together by them are not sent again. gt, dt: columns that are one value a track.
    """
    from framelake.functions import boxes

    gt, dt = gt or {}, dt or {}
    size = lambda c: F.sum(boxes.area(F.col(c))).over(Window.partitionBy(*keys, "track"))
    sized = rows.withColumns({"_gt": size("g"), "_dt": size("d")})
    side = lambda box, n, more: {n: F.col("track"), f"_{n}_box": F.col(box), f"_{n}": F.col(f"_{n}"), **more}
    both = assign.met(sized, [*keys, "t"], F.col("g").isNotNull(), F.col("d").isNotNull(), side("g", "gt", gt), side("d", "dt", dt))
    inter = F.sum(boxes.intersection(F.col("_gt_box"), F.col("_dt_box"))).alias("_i")
    found = both.groupBy(*keys, "gt", "dt").agg(inter, *[F.max(c).alias(c) for c in ("_gt", "_dt", *gt, *dt)]).where("_i > 0")
    return found.select(*keys, "gt", "dt", (F.col("_i") / (F.col("_gt") + F.col("_dt") - F.col("_i"))).alias("iou"), *gt, *dt)


def phrase_rows(pairs: DataFrame, gt: DataFrame, dt: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TP, FP, FN and F1 of each (video, phrase) and threshold; 1 where there is nothing to find and nothing found: pairs(keys), gt and dt (keys, one row a track),
    matched(keys, iou) from one assignment of tracks."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    every = pairs.select(*keys).distinct().join(n(gt, "num_gt"), list(keys), "left").join(n(dt, "num_dt"), list(keys), "left").na.fill(0, ["num_gt", "num_dt"])
    counts = metrics.image_counts(every, matched, keys)
    below = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.withColumn("f1", F.when(below == 0, 1.0).otherwise(2 * F.col("tp") / F.greatest(below, F.lit(1))))


# ---- averages of metrics


def class_averaged(by_class: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str | None = None) -> DataFrame:
    """The mean of each value over classes; weight: classes where it is 0 are empty and left out."""
    own = by_class if weight is None else by_class.where(F.col(weight) > 0)
    return own.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def detection_averaged_teta(counts: DataFrame) -> DataFrame:
    """Localisation and classification from counts added over classes, association weighted by true positives: counts(alpha, loc_tp, loc_fn, loc_fp, cls_tp, cls_fn, cls_fp, assoc)."""
    s = counts.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in ("loc_tp", "loc_fn", "loc_fp", "cls_tp", "cls_fn", "cls_fp")], F.sum(F.col("assoc") * F.col("loc_tp")).alias("_a"))
    one = lambda x: F.greatest(x, F.lit(1))
    loc, cls = F.col("loc_tp") / one(F.col("loc_tp") + F.col("loc_fn") + F.col("loc_fp")), F.col("cls_tp") / one(F.col("cls_tp") + F.col("cls_fn") + F.col("cls_fp"))
    return s.select("alpha", loc.alias("loc_a"), (F.col("_a") / one(F.col("loc_tp"))).alias("assoc_a"), cls.alias("cls_a"))


def combined_counts(counts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Counts added over sequences, with a row for all."""
    return counts.rollup(*keys).agg(*[F.sum(v).alias(v) for v in values])


def rolled_up(counts: DataFrame, category: str, super_category: str) -> DataFrame:
    """det_a by category, by super-category and over all, each from counts(category, super_category, tp, fp, fn) added below it, and the mean over its categories."""
    by = counts.groupBy(category, super_category).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    own = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp") + F.col("fn"))
    out = by.withColumn("_own", own).groupingSets([[super_category, category], [super_category], []], super_category, category).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg("_own").alias("class_averaged"))
    return out.withColumn("det_averaged", own)


def formatted(values: DataFrame, names: Sequence[str], digits: int = 5) -> DataFrame:
    """Numbers as published: so many significant digits, trailing zeros kept."""
    size = lambda c: F.floor(F.log10(F.abs(F.col(c)))).cast("int")
    text = lambda c: F.when(F.col(c) == 0, F.format_string(f"%.{digits}f", F.lit(0.0))).otherwise(F.format_number(F.round(F.col(c) * F.pow(F.lit(10.0), digits - 1 - size(c))) / F.pow(F.lit(10.0), digits - 1 - size(c)), digits))
    return values.withColumns({n: text(n) for n in names})


def suffix_means(values: DataFrame, key: str, value: str, suffixes: Sequence[str]) -> DataFrame:
    """The mean of the values whose key ends in each suffix."""
    each = values.select(F.explode(F.array(*map(F.lit, suffixes))).alias("suffix"), key, value).where(F.endswith(F.col(key), F.col("suffix")))
    return each.groupBy("suffix").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def last_metrics(logs: DataFrame, categories: DataFrame, run: str, order: str, value: str) -> DataFrame:
    """The last logged value of each run, for the runs of each category: categories(category, run)."""
    last = logs.groupBy(run).agg(F.max_by(value, order).alias(value))
    return categories.join(last, run, "left")


def counted_above(scores: DataFrame, keys: Sequence[str], logit: str, presence: Column, threshold: float) -> DataFrame:
    """How many of a group's detections have a probability, times the presence, above the threshold."""
    p = presence / (1 + F.exp(-F.col(logit)))
    return scores.groupBy(*keys).agg(F.sum(F.when(p > threshold, 1).otherwise(0)).alias("n_counted"))


# ---- what costs average precision

#: Error types, and what mending one does to a wrong detection: it becomes the hit that it missed (if no hit has its object yet), or goes.
MENDED_TO_HIT = ("class", "box")
ERRORS = (*MENDED_TO_HIT, "both", "double", "background", "missed")


def error_types(gt: DataFrame, dt: DataFrame, pairs: DataFrame, hits: DataFrame, keys: Sequence[str], cls: str, near: float = 0.1, hit: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """dt with `error` and `mends` (the object a mended detection would hit, null for none), and gt with `missed`.

    gt(keys, gt, cls), dt(keys, dt, cls, score), pairs(keys, gt, dt, iou) of overlapping ones of any class, hits(keys, gt, dt). A detection that is no hit has a `box`
    error if it lies near an object of its class (from `near` to below `hit`, its nearest), else a `class` error if it reaches an object of another class, else is a
    `double` of an object of its class that a hit has, else `background` if it is not even near any object, else wrong in `both`. An object is missed if no hit has
    it and no box or class error lies on it.
    """
    own = lambda df, name: df.select(*keys, name, F.col(cls).alias(f"_{name}_cls"))
    full = pairs.select(*keys, "gt", "dt", F.round("iou", 12).alias("iou")).join(own(gt, "gt"), [*keys, "gt"]).join(own(dt, "dt"), [*keys, "dt"])
    full = full.join(hits.select(*keys, "gt", F.lit(True).alias("_used")), [*keys, "gt"], "left").withColumn("_same", F.col("_gt_cls") == F.col("_dt_cls"))
    best = lambda cond: F.max(F.when(cond, F.struct("iou", (-F.col("gt")).alias("neg"))))
    seen = full.groupBy(*keys, "dt").agg(best(F.col("_same")).alias("same"), best(~F.col("_same")).alias("other"), best(F.col("_same") & F.col("_used")).alias("used"), F.max("iou").alias("most"))
    wrong = dt.join(hits.select(*keys, "dt"), [*keys, "dt"], "left_anti").join(seen, [*keys, "dt"], "left")
    reach = lambda c: F.coalesce(F.col(f"{c}.iou") >= hit, F.lit(False))
    kind = (
        F.when((F.col("same.iou") >= near) & (F.col("same.iou") < hit), "box")
        .when(reach("other"), "class")
        .when(reach("used"), "double")
        .when(F.coalesce(F.col("most"), F.lit(0.0)) < near, "background")
        .otherwise("both")
    )
    on = F.when(F.col("error") == "box", -F.col("same.neg")).when(F.col("error") == "class", -F.col("other.neg"))
    wrong = wrong.withColumn("error", kind).withColumn("_on", on)
    taken = hits.select(*keys, F.col("gt").alias("_on"), F.lit(True).alias("_taken"))
    free = wrong.join(taken, [*keys, "_on"], "left")
    first = F.row_number().over(Window.partitionBy(*keys, "error", "_on").orderBy(F.desc("score"), "dt"))
    mends = F.when(F.col("_on").isNotNull() & F.col("_taken").isNull() & (first == 1), F.col("_on"))
    marked = free.withColumn("mends", mends).select(*dt.columns, "error", "mends", "_on")
    all_dt = marked.unionByName(dt.join(hits.select(*keys, "dt"), [*keys, "dt"], "left_semi"), allowMissingColumns=True)
    covered = hits.select(*keys, "gt").unionByName(marked.where("_on IS NOT NULL").select(*keys, F.col("_on").alias("gt"))).distinct().withColumn("_c", F.lit(True))
    return all_dt.drop("_on"), gt.join(covered, [*keys, "gt"], "left").withColumn("missed", F.col("_c").isNull()).drop("_c")


_JUDGED = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in (("is_gt", T.BooleanType()), ("cls", T.LongType()), ("score", T.DoubleType()), ("error", T.StringType()), ("to", T.LongType()), ("missed", T.BooleanType()))]))


@F.arrow_udf(_JUDGED)
def judged(gts: pa.Array, dts: pa.Array) -> pa.Array:
    """The objects and detections of a group as rows for tally(), with the errors of error_types() at its usual bounds after the greedy matches of each class at 0.5.

    gts: structs of number, cls, x0, y0, x1, y1; dts: the same and score; numbers and classes are whole. `to` is the class of the object that a detection mends.
    """
    n_g, n_d = lengths(gts), lengths(dts)
    field = lambda lists, name, kind: lists.flatten().field(name).to_numpy(zero_copy_only=False).astype(kind)
    (g, d), (gn, dn), (gc, dc) = ([field(v, c, np.float64) for c in ("x0", "y0", "x1", "y1")] for v in (gts, dts)), (field(v, "number", np.int64) for v in (gts, dts)), (field(v, "cls", np.int64) for v in (gts, dts))
    given = dts.flatten().field("score")
    score = given.fill_null(np.inf).to_numpy(zero_copy_only=False).astype(np.float64)
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    area_g, area_d = area(g), area(d)
    kept = []
    for i, j in crossed(n_g, n_d):
        inter = np.maximum(np.minimum(g[2][i], d[2][j]) - np.maximum(g[0][i], d[0][j]), 0) * np.maximum(np.minimum(g[3][i], d[3][j]) - np.maximum(g[1][i], d[1][j]), 0)
        meet = inter > 0
        i, j, inter = i[meet], j[meet], inter[meet]
        kept.append((i, j, inter / (area_g[i] + area_d[j] - inter)))
    i, j, raw = (np.concatenate(v) for v in zip(*kept, strict=True)) if kept else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    iou, same = np.round(raw, 12), gc[i] == dc[j]

    row_g, row_d = np.repeat(np.arange(len(gts)), n_g), np.repeat(np.arange(len(dts)), n_d)
    used, hit = np.zeros(len(gn), bool), np.zeros(len(dn), bool)
    able = np.flatnonzero(same & (np.round(raw * 100, 6) >= 50))
    for k in able[np.lexsort((gn[i[able]], -iou[able], dn[j[able]], -score[j[able]], row_d[j[able]]))].tolist():
        if not used[i[k]] and not hit[j[k]]:
            used[i[k]] = hit[j[k]] = True

    order = np.lexsort((-gn[i], iou, j))

    def best(which):
        """Of each detection: the highest overlap, 0 for none, and its object, the least of equal ones."""
        k = order[which[order]]
        last = k[np.append(j[k][1:] != j[k][:-1], True)] if len(k) else k
        value, on = np.zeros(len(dn)), np.full(len(dn), -1)
        value[j[last]], on[j[last]] = iou[last], i[last]
        return value, on

    (own, own_on), (other, other_on), (double, _) = best(same), best(~same), best(same & used[i])
    most = np.maximum(own, other)
    kind = np.select([hit, (own >= 0.1) & (own < 0.5), other >= 0.5, double >= 0.5, most < 0.1], [-1, 1, 0, 3, 4], 2)  # places in ERRORS
    on = np.select([kind == 1, kind == 0], [own_on, other_on], -1)
    lies = np.flatnonzero(on >= 0)
    lies = lies[np.lexsort((dn[lies], np.where(np.isnan(score[lies]), -np.inf, -np.where(given.is_null().to_numpy(zero_copy_only=False)[lies], -np.inf, score[lies])), on[lies], kind[lies]))]
    first = np.ones(len(lies), bool)
    first[1:] = (on[lies][1:] != on[lies][:-1]) | (kind[lies][1:] != kind[lies][:-1])
    mends = lies[first & ~used[on[lies]]]
    to, is_to = np.zeros(len(dn), np.int64), np.zeros(len(dn), bool)
    to[mends], is_to[mends] = gc[on[mends]], True
    missed = ~used
    missed[on[lies]] = False

    place = np.argsort(np.concatenate([row_g, row_d]), kind="stable")
    n, n_dt = len(gn), len(dn)
    columns = [
        pa.array(np.arange(n + n_dt) < n),
        pa.array(np.concatenate([gc, dc])),
        pa.concat_arrays([pa.nulls(n, pa.float64()), given.cast(pa.float64())]),
        pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(ERRORS[:-1]).take(pa.array(kind, mask=kind < 0))]),
        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(to, mask=~is_to)]),
        pa.concat_arrays([pa.array(missed), pa.nulls(n_dt, pa.bool_())]),
    ]
    rows = pa.StructArray.from_arrays(columns, names=[f.name for f in _JUDGED.elementType]).take(pa.array(place))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_g + n_d)]).astype(np.int32)), rows)


def tally(rows: DataFrame) -> DataFrame:
    """How many objects and detections are alike: rows(is_gt, cls, score, error, to, missed), as judged() makes them. Whoever asks for it twice shares its one shuffle."""
    return rows.groupBy("is_gt", "cls", "score", "error", "to", "missed").agg(F.count("*").alias("n"))


def precision_lost(gt: DataFrame, dt: DataFrame, keys: Sequence[str], cls: str) -> DataFrame:
    """error, n and lost for each error type, `false_positive` and `false_negative`: how many there are, and how much the mean average precision gains if they are mended
    and the ranking is evaluated again; and `none`, with the average precision itself.

    gt and dt are those of error_types(). Mending a box or class error makes the best such detection of a free object its hit, in the object's class, and removes the
    others; all other wrong detections go; missed objects are no longer asked for. Without wrong detections, or with all objects found, the last two.
    """
    to = gt.select(*keys, F.col("gt").alias("mends"), F.col(cls).alias("to"))
    none = lambda kind: F.lit(None).cast(kind)
    own = gt.select(F.lit(True).alias("is_gt"), F.col(cls).alias("cls"), none("double").alias("score"), none("string").alias("error"), F.when(F.lit(False), F.col(cls)).alias("to"), "missed")
    found = dt.join(to, [*keys, "mends"], "left").select(F.lit(False).alias("is_gt"), F.col(cls).alias("cls"), F.col("score").cast("double").alias("score"), "error", "to", none("boolean").alias("missed"))
    return precision_lost_of(tally(own.unionByName(found)))


def precision_lost_of(tallied: DataFrame) -> DataFrame:
    """As precision_lost(), from tally(). Rows are told apart by conditions in sums: a filter would be pushed below the shuffle of the tally, and each use then make its own."""
    is_gt, hit, wrong, n, zero = F.col("is_gt"), ~F.col("is_gt") & F.col("error").isNull(), F.col("error"), F.col("n"), F.lit(0).cast("long")
    every = ("none", *ERRORS, "false_positive", "false_negative")

    def case(name):
        """What a row is in a case: found, or asked for."""
        mended = ~is_gt & F.coalesce(wrong == name, F.lit(False))
        takes_part = {"missed": ~is_gt, "none": ~is_gt, "false_negative": ~is_gt, "false_positive": hit}.get(name, ~is_gt & (~mended | F.col("to").isNotNull()))
        asked = {"missed": is_gt & ~F.col("missed"), "false_negative": hit}.get(name, is_gt)
        some = lambda c: F.when(c, n).otherwise(zero)
        return F.struct(F.lit(name).alias("case"), F.when(mended & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("cls")).alias("cls"), some(takes_part & (hit | mended)).alias("tp"), some(takes_part).alias("n"), some(asked).alias("asked"))

    each = tallied.select("score", F.explode_outer(F.array(*map(case, every))).alias("c")).select("score", "c.*")
    by_score = each.groupBy("case", "cls", "score").agg(*[F.sum(c).alias(c) for c in ("tp", "n", "asked")])
    asked = by_score.groupBy("case", "cls").agg(F.sum("asked").alias("n_gt")).where("n_gt > 0")
    ap = metrics.interpolated_precision(by_score.where("n > 0"), asked, ["case", "cls"])
    mean = asked.join(ap, ["case", "cls"], "left").groupBy("case").agg(F.round(F.avg(F.coalesce("ap", F.lit(0.0))), 9).alias("ap"))
    count = lambda c: F.coalesce(F.sum(F.when(c, n).otherwise(zero)), zero)
    of = {"none": zero, "missed": count(is_gt & F.col("missed")), "false_positive": count(wrong.isNotNull()), "false_negative": count(is_gt) - count(hit)} | {e: count(wrong == e) for e in ERRORS[:-1]}
    counts = tallied.agg(*[of[c].alias(c) for c in every])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("case"), F.col(c).alias("n")) for c in every])).alias("e")
    base = mean.where("case = 'none'").select(F.col("ap").alias("_base"))
    out = counts.select(pairs).select("e.*").join(mean, "case", "left").join(F.broadcast(base), how="left")  # one row each
    gain = F.when(F.col("case") == "none", F.col("ap")).otherwise(F.coalesce("ap", F.lit(0.0)) - F.col("_base"))
    return out.select(F.col("case").alias("error"), "n", F.round(gain, 6).alias("lost"))
