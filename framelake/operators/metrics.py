"""Detection and tracking metrics as partial counts, their merge, and final formulas."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .assign import optimal, picked

#: IoU thresholds in hundredths; comparisons stay exact.
THRESHOLDS = list(range(50, 100, 5))
#: Added to denominators of precision and recall, and of image-level measures.
EPS, IL_EPS = 1e-4, 1e-6


def image_counts(images: DataFrame, matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """TP, FP and FN of each image and threshold: images(keys, num_gt, num_dt), matched(keys, iou) from one global assignment, thresholded afterwards."""
    levels = F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("thr")
    hits = matched.select(*keys, "iou", levels).where(F.round(F.col("iou") * 100, 6) >= F.col("thr")).groupBy(*keys, "thr").agg(F.count("*").alias("tp"))
    every = images.select(*keys, "num_gt", "num_dt", levels).join(hits, [*keys, "thr"], "left")
    tp = F.coalesce("tp", F.lit(0)).cast("long")
    return every.select(*keys, "thr", "num_gt", "num_dt", tp.alias("tp"), (F.col("num_dt") - tp).alias("fp"), (F.col("num_gt") - tp).alias("fn"))


def _f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + EPS)


def classification_gated_f1(counts: DataFrame) -> DataFrame:
    """One row of means over thresholds: micro and macro F1 of positive images, image-level MCC, and their products, from image_counts()."""
    p, r = F.col("tp") / (F.col("tp") + F.col("fp") + EPS), F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    positive = F.col("num_gt") > 0
    cell = lambda gt, dt: F.sum(F.when((F.col("num_gt") > 0 if gt else F.col("num_gt") == 0) & (F.col("num_dt") > 0 if dt else F.col("num_dt") == 0), 1).otherwise(0)).cast("double")
    sums = counts.groupBy("thr").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        F.sum(F.when(positive, F.col("fp")).otherwise(0)).alias("pm_fp"),
        F.sum(F.when(positive, F.round(_f1(p, r), 12)).otherwise(0.0)).alias("f1_sum"),
        F.sum(F.when(positive & (F.col("num_dt") > 0), 1).otherwise(0)).alias("n_macro"),
        F.sum(F.when(positive, 1).otherwise(0)).alias("n_positive"),
        cell(True, True).alias("il_tp"), cell(False, True).alias("il_fp"), cell(True, False).alias("il_fn"), cell(False, False).alias("il_tn"),
    )
    recall = F.col("tp") / (F.col("tp") + F.col("fn") + EPS)
    il = {c: F.col(f"il_{c}") for c in ("tp", "fp", "fn", "tn")}
    mcc = (il["tp"] * il["tn"] - il["fp"] * il["fn"]) / (F.sqrt((il["tp"] + il["fp"]) * (il["tp"] + il["fn"]) * (il["tn"] + il["fp"]) * (il["tn"] + il["fn"])) + IL_EPS)
    by_level = sums.select(
        "thr",
        (F.col("tp") / (F.col("tp") + F.col("fp") + EPS)).alias("precision"),
        recall.alias("recall"),
        _f1(F.col("tp") / (F.col("tp") + F.col("pm_fp") + EPS), recall).alias("pm_f1"),
        F.try_divide("f1_sum", "n_macro").alias("macro_f1"),
        F.try_divide("f1_sum", "n_positive").alias("macro_f1_w0dt"),
        mcc.alias("il_mcc"),
    )
    mean = lambda c: F.round(F.avg(c), 6)
    return by_level.agg(
        mean("precision").alias("precision"),
        mean("recall").alias("recall"),
        mean("pm_f1").alias("positive_micro_f1"),
        mean("macro_f1").alias("positive_macro_f1"),
        mean("macro_f1_w0dt").alias("positive_w0dt_macro_f1"),
        mean("il_mcc").alias("il_mcc"),
        mean(F.col("pm_f1") * F.col("il_mcc")).alias("cgf1"),
        mean(F.col("macro_f1") * F.col("il_mcc")).alias("cgf1_macro"),
    )


ALPHAS = [k / 20 for k in range(1, 20)]
_CLOSE = 2.220446049250313e-16


def _beside(gt: DataFrame, trk: DataFrame, sim: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """gt(seq, t, gt), trk(seq, t, dt) and sim(seq, t, gt, dt, iou) as one table with a `kind`, shuffled once, by seq: what follows are windows and groups inside sequences.

    more: columns of gt and trk that come along.
    """
    kind = lambda df, name: df.withColumn("kind", F.lit(name))
    rows = kind(gt.select("seq", "t", "gt", *more), "g").unionByName(kind(trk.select("seq", "t", "dt", *more), "d"), allowMissingColumns=True)
    return rows.unionByName(kind(sim.select("seq", "t", "gt", "dt", "iou"), "s"), allowMissingColumns=True).repartition("seq")


def aligned_matches(sim: DataFrame, group: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """group, t, gt, dt, iou and carry of each frame's assignment of the largest alignment * overlap: sim(group, t, gt, dt, iou, n_gt, n_dt) of overlapping pairs.

    The alignment of two tracks adds up, over all frames of the group, their overlap over what both share with others, divided by the frames of both (n_gt, n_dt).
    """
    frame = [*group, "t"]
    rows = F.sum("iou").over(Window.partitionBy(*frame, "gt"))
    columns = F.sum("iou").over(Window.partitionBy(*frame, "dt"))
    either = rows + columns - F.col("iou")
    shared = F.when(either > 1e-12, F.col("iou") / either).otherwise(0.0)
    p = F.sum("p").over(Window.partitionBy(*group, "gt", "dt"))
    scored = sim.withColumn("p", shared).withColumn("p", p).withColumn("value", F.col("p") / (F.col("n_gt") + F.col("n_dt") - F.col("p")) * F.col("iou"))
    return optimal(scored, frame, "value", carry=["iou", *carry]).select(*frame, "gt", "dt", "iou", *carry)


def _reach(alphas: Sequence[float]) -> Column:
    """How many of the alphas, from the least on, an overlap reaches."""
    return F.size(F.filter(F.array(*map(F.lit, alphas)), lambda a: F.col("iou") >= a - _CLOSE))


def hota(gt: DataFrame, trk: DataFrame, sim: DataFrame) -> DataFrame:
    """HOTA and its parts for each sequence and alpha: gt(seq, t, gt), trk(seq, t, dt), sim(seq, t, gt, dt, iou) of overlapping pairs.

    Matches are those of aligned_matches(); one counts at an alpha if its overlap reaches it. Matches of two tracks are counted by how far they reach, and spread over alphas only after that.
    """
    n = lambda kind, track: F.count_if(F.col("kind") == kind).over(Window.partitionBy("seq", track))
    all_rows = _beside(gt, trk, sim)
    known = all_rows.withColumn("n_gt", n("g", "gt")).withColumn("n_dt", n("d", "dt")).where("kind = 's' AND n_gt > 0 AND n_dt > 0")
    rows = gt.select("seq", F.lit(1).alias("gt"), F.lit(0).alias("dt")).unionByName(trk.select("seq", F.lit(0).alias("gt"), F.lit(1).alias("dt")))
    return hota_of_pairs(known, rows.groupBy("seq").agg(F.sum("gt").alias("gt"), F.sum("dt").alias("dt")))


def hota_of_pairs(known: DataFrame, totals: DataFrame, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """As hota(), from known(seq, t, gt, dt, iou, n_gt, n_dt) of overlapping pairs with the frames of both tracks, and totals(seq, gt, dt) of objects. keys: columns that name a sequence."""
    matched = aligned_matches(known, keys, ["n_gt", "n_dt"])
    reached = matched.withColumn("reach", _reach(ALPHAS)).groupBy(*keys, "gt", "dt", "n_gt", "n_dt", "reach").agg(F.count("*").alias("c"), F.sum(F.round("iou", 12)).alias("loc"))
    far = Window.partitionBy(*keys, "gt", "dt").orderBy(F.desc("reach"))
    steps = reached.withColumn("c", F.sum("c").over(far)).withColumn("loc", F.sum("loc").over(far)).withColumn("next", F.coalesce(F.lead("reach").over(far), F.lit(0)))
    c = F.col("c")
    # One step holds for the alphas from the next shorter reach to its own.
    by_step = steps.where("reach > 0").groupBy(*keys, "reach", "next").agg(
        F.sum("c").alias("tp"),
        F.sum("loc").alias("loc"),
        F.sum(c * c / (F.col("n_gt") + F.col("n_dt") - c)).alias("ass_a"),
        F.sum(c * c / F.col("n_gt")).alias("ass_re"),
        F.sum(c * c / F.col("n_dt")).alias("ass_pr"),
    )
    levels = F.posexplode(F.array(*map(F.lit, ALPHAS))).alias("_k", "alpha")
    per = by_step.select("*", levels).where("_k >= next AND _k < reach").groupBy(*keys, "alpha").agg(*[F.sum(x).alias(x) for x in ("tp", "loc", "ass_a", "ass_re", "ass_pr")])
    every = totals.select(*keys, "gt", "dt", levels).drop("_k").join(per, [*keys, "alpha"], "left").na.fill(0)
    tp = F.col("tp")
    one = F.greatest(tp, F.lit(1))
    out = every.select(
        *keys, "alpha", tp, (F.col("gt") - tp).alias("fn"), (F.col("dt") - tp).alias("fp"),
        (tp / F.greatest(F.lit(1), F.col("gt") + F.col("dt") - tp)).alias("det_a"),
        (tp / F.greatest(F.lit(1), F.col("gt"))).alias("det_re"), (tp / F.greatest(F.lit(1), F.col("dt"))).alias("det_pr"),
        (F.col("ass_a") / one).alias("ass_a"), (F.col("ass_re") / one).alias("ass_re"), (F.col("ass_pr") / one).alias("ass_pr"),
        F.when((F.col("gt") == 0) | (F.col("dt") == 0) | (tp == 0), 1.0).otherwise(F.col("loc") / one).alias("loc_a"),
    )
    return out.withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a"))).withColumn("owta", F.sqrt(F.col("det_re") * F.col("ass_a")))


def teta(gt: DataFrame, trk: DataFrame, sim: DataFrame, near: float = 0.5) -> DataFrame:
    """TETA and its parts for each class: gt(seq, t, gt, cls), trk(seq, t, dt, cls), sim(seq, t, gt, dt, iou) of overlapping pairs.

    Each class's ground truth is matched within its sequence to tracks of any class. Localisation counts at alphas 0 to 0.95, where a track is a false positive if it
    lies near (IoU `near`) ground truth of the class and is not matched; classification counts matches at alphas from 0.5 on, a wrong class being a false positive of
    the class that was predicted. Association is that of HOTA, weighted by true positives over sequences. All is counted by how far matches reach before it is spread over alphas, in one pass.
    """
    of = lambda kind, *at: F.max(F.when(F.col("kind") == kind, F.col("cls"))).over(Window.partitionBy("seq", "t", *at))
    all_rows = _beside(gt, trk, sim, ["cls"])
    known = all_rows.withColumn("predicted", of("d", "dt")).withColumn("cls", F.when(F.col("kind") == "s", of("g", "gt")).otherwise(F.col("cls")))
    known = known.where("kind = 'g' OR kind = 's' AND cls IS NOT NULL")
    return teta_of_pairs(known.select("cls", "seq", "t", "gt", "dt", "iou", "predicted", (F.col("kind") == "g").cast("int").alias("objects")), near)


#: Alphas of TETA: localisation counts at all of them, classification from the one of _HIGH on.
_TETA_ALPHAS = np.arange(20) / 20
_HIGH = int(np.argmax(_TETA_ALPHAS >= 0.5 - _CLOSE))
_TALLIES = ("n", "loc_tp", "cls_tp", "a", "re", "pr", "loc_fp", "cls_fp")
#: Rows that are counted at once, as far as a class's sequence ends there.
_COUNTED = 1 << 17


def _places(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row, the same where all columns are the same, and the first row of each."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that tell a column's values apart; null is a value."""
    if not pa.types.is_integer(column.type) or column.null_count:
        column = column.combine_chunks().dictionary_encode("encode").indices
    return column.to_numpy().astype(np.int64)


def _units(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables that no group of the named columns is cut by."""
    held, n, least = [], 0, _COUNTED
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(n, bool)
        for name in names:
            last = t[name][-1]
            same &= (pc.equal(t[name], last).fill_null(False) if last.is_valid else t[name].is_null()).to_numpy()
        cut = n - int(same.sum())
        if cut:
            yield t.slice(0, cut)
        held, n = t.slice(cut).to_batches(), n - cut
        least = max(_COUNTED, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def _assigned(frame: np.ndarray, gt: np.ndarray, dt: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which pairs the assignments of all frames take. gt and dt: numbers of the frames' objects."""
    several = np.zeros(int(frame.max(initial=-1)) + 1, bool)
    for own in (gt, dt):
        several[frame[np.bincount(own)[own] > 1]] = True
    taken = ~several[frame] & (value > 0)
    rows = np.flatnonzero(several[frame])
    rows = rows[np.argsort(frame[rows], kind="stable")]
    cuts = np.flatnonzero(np.diff(frame[rows], prepend=-1, append=-1)) if len(rows) else rows
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        own = rows[begin:end]
        taken[own[picked(gt[own].tolist(), dt[own].tolist(), value[own].tolist())]] = True
    return taken


def _teta_tallies(t: pa.Table, near: float, classes: dict) -> dict[str, np.ndarray]:
    """Counts and sums by class and alpha of whole sequences of classes; classes: the number of each class, which grows."""
    both = pa.chunked_array([*t["cls"].chunks, *t["predicted"].chunks]).combine_chunks().dictionary_encode("encode")
    code = np.array([classes.setdefault(x, len(classes)) for x in both.dictionary.to_pylist()], np.int64)[both.indices.to_numpy()]
    cls, predicted = code[: len(t)], code[len(t) :]
    n_classes, n_levels = len(classes), len(_TETA_ALPHAS)
    named = t["cls"].is_valid().to_numpy()
    seq, frame, gt, dt = (_numbers(t[c]) for c in ("seq", "t", "gt", "dt"))
    objects = t["objects"].to_numpy().astype(np.int64)
    out = {c: np.zeros((n_classes, n_levels)) for c in _TALLIES}
    out["n"] += np.bincount(cls, weights=objects, minlength=n_classes)[:, None]
    track, _ = _places(cls, seq, gt)
    n_gt = np.bincount(track, weights=objects)[track]
    own = np.flatnonzero(t["dt"].is_valid().to_numpy() & named & (n_gt > 0))
    iou = t["iou"].to_numpy()[own]
    cls, predicted, seq, frame, gt, dt, n_gt = (v[own] for v in (cls, predicted, seq, frame, gt, dt, n_gt))
    known = t["predicted"].is_valid().to_numpy()[own]
    at_gt, _ = _places(cls, seq, frame, gt)
    at_dt, first = _places(cls, seq, frame, dt)
    found, _ = _places(cls, seq, dt)
    n_dt = np.bincount(found[first], minlength=len(own))[found]
    close = np.bincount(at_dt, weights=iou >= near, minlength=len(own))[at_dt] > 0
    either = np.bincount(at_gt, weights=iou)[at_gt] + np.bincount(at_dt, weights=iou)[at_dt] - iou
    pair, _ = _places(cls, seq, gt, dt)
    p = np.bincount(pair, weights=np.where(either > 1e-12, iou / np.where(either > 1e-12, either, 1.0), 0.0))[pair]
    taken = _assigned(_places(cls, seq, frame)[0], at_gt, at_dt, p / (n_gt + n_dt - p) * iou)
    out["loc_fp"] += np.bincount(cls[first], weights=close[first], minlength=n_classes)[:, None]  # less those that a match reaches, below
    hit = np.flatnonzero(taken & known)
    cls, predicted, pair, n_gt, n_dt, close = (v[hit] for v in (cls, predicted, pair, n_gt, n_dt, close))
    reach = np.searchsorted(_TETA_ALPHAS - _CLOSE, iou[hit], "right")
    reached = np.arange(n_levels + 1)[:, None] > np.arange(n_levels)  # by reach and alpha
    by_reach = lambda of, some: np.bincount((of * (n_levels + 1) + reach)[some], minlength=n_classes * (n_levels + 1)).reshape(n_classes, -1) @ reached
    out["loc_fp"] -= by_reach(cls, close)
    out["cls_fp"] += by_reach(predicted, cls != predicted)
    out["cls_fp"][:, :_HIGH] = 0
    # Matches of two tracks, farthest first: each step of their reach holds for the alphas down to the next one's.
    order = np.lexsort((-reach, pair))
    cls, predicted, pair, n_gt, n_dt, reach = (v[order] for v in (cls, predicted, pair, n_gt, n_dt, reach))
    begin = np.flatnonzero(np.diff(pair, prepend=-1))
    size = np.diff(np.concatenate([begin, [len(pair)]]))
    right = np.concatenate([[0], np.cumsum(cls == predicted)])
    step = np.flatnonzero((np.diff(pair, append=-1) != 0) | (np.diff(reach, append=-1) != 0))
    c = (np.arange(len(pair)) - np.repeat(begin, size) + 1)[step].astype(float)
    right = right[step + 1] - right[np.repeat(begin, size)[step]]
    cls, pair, n_gt, n_dt, reach = (v[step] for v in (cls, pair, n_gt, n_dt, reach))
    after = np.where(np.diff(pair, append=-1) == 0, np.concatenate([reach[1:], [0]])[: len(reach)], 0)
    cell = (cls * (n_levels + 1) + reach) * (n_levels + 1) + after
    between = (reached[:, None] & ~reached[None]).reshape(-1, n_levels)  # by reach, the next reach, and alpha
    for name, value in (("loc_tp", c), ("cls_tp", right), ("a", c * c / (n_gt + n_dt - c)), ("re", c * c / n_gt), ("pr", c * c / n_dt)):
        out[name] += np.bincount(cell, weights=value, minlength=n_classes * (n_levels + 1) ** 2).reshape(n_classes, -1) @ between
    return out


def teta_of_pairs(rows: DataFrame, near: float = 0.5) -> DataFrame:
    """As teta(), from rows(cls, seq, t, gt, dt, iou, predicted, objects): overlapping pairs with the class of either side, and ground truth without any (null dt).

    cls is that of the ground truth; predicted is null where dt is no track of its frame; objects says how many objects of the ground truth the row stands for: of the rows of one object
    in a frame, one has 1. Rows of a sequence's class lie in one partition. There they are sorted once, and counted in tables of some sequences each; a task holds one sequence's class.
    """
    kind = f"cls {rows.schema['cls'].dataType.simpleString()}, level int, {', '.join(f'{c} double' for c in _TALLIES)}"

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict = {}
        sums = {c: np.zeros((0, len(_TETA_ALPHAS))) for c in _TALLIES}
        for table in _units(batches, ["cls", "seq"]):
            for c, v in _teta_tallies(table, near, classes).items():
                v[: len(sums[c])] += sums[c]
                sums[c] = v
        names = list(classes)
        level = np.tile(np.arange(len(_TETA_ALPHAS), dtype=np.int32), len(names))
        keys = pa.array([x for x in names for _ in _TETA_ALPHAS], kind_of_class)
        yield pa.RecordBatch.from_arrays([keys, pa.array(level), *(pa.array(sums[c].ravel()) for c in _TALLIES)], ["cls", "level", *_TALLIES])

    kind_of_class = to_arrow_type(rows.schema["cls"].dataType)
    tallies = rows.select("cls", "seq", "t", "gt", "dt", F.col("iou").cast("double").alias("iou"), "predicted", "objects").sortWithinPartitions("cls", "seq").mapInArrow(counted, kind)
    every = tallies.groupBy("cls", "level").agg(*[F.sum(c).alias(c) for c in _TALLIES]).where("n > 0")
    tp, fn, fp = F.col("loc_tp"), F.col("n") - F.col("loc_tp"), F.col("loc_fp")
    one = lambda x: F.greatest(F.lit(1), x)
    cls_fn = tp - F.col("cls_tp")
    high = F.col("level") >= _HIGH
    mean = lambda x: F.avg(x)
    out = every.groupBy("cls").agg(
        mean(tp / one(tp + fn + fp)).alias("loc_a"), mean(tp / one(tp + fn)).alias("loc_re"), mean(tp / one(tp + fp)).alias("loc_pr"),
        mean(F.col("a") / one(tp)).alias("assoc_a"), mean(F.col("re") / one(tp)).alias("assoc_re"), mean(F.col("pr") / one(tp)).alias("assoc_pr"),
        mean(F.when(high, F.col("cls_tp") / one(F.col("cls_tp") + cls_fn + F.col("cls_fp")))).alias("cls_a"),
        mean(F.when(high, F.col("cls_tp") / one(F.col("cls_tp") + cls_fn))).alias("cls_re"), mean(F.when(high, F.col("cls_tp") / one(F.col("cls_tp") + F.col("cls_fp")))).alias("cls_pr"),
    )
    return out.withColumn("teta", (F.col("loc_a") + F.col("assoc_a") + F.col("cls_a")) / 3)


def combine_hota(parts: DataFrame) -> DataFrame:
    """Sequences into one row per alpha: counts are added, association is weighted by true positives, localisation too."""
    tp = F.sum("tp")
    weighted = lambda c: F.sum(F.col(c) * F.col("tp")) / F.greatest(F.lit(1), tp)
    total = parts.groupBy("alpha").agg(tp.alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"), *[weighted(c).alias(c) for c in ("ass_a", "ass_re", "ass_pr", "loc_a")])
    det = F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn") + F.col("fp"))
    return total.withColumn("det_a", det).withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a")))


def average_precision(ranked: DataFrame, n_gt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """101-point interpolated AP for each of keys: ranked(keys, score, tp) detections, n_gt(keys, n_gt).

    Detections of equal score count together, so the order of equal ones has no say; what is sorted are the distinct scores.
    """
    return interpolated_precision(ranked.groupBy(*keys, "score").agg(F.sum("tp").alias("tp"), F.count("*").alias("n")), n_gt, keys)


def interpolated_precision(by_score: DataFrame, n_gt: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As average_precision(), from by_score(keys, score, tp, n): hits and detections at each score."""
    down = Window.partitionBy(*keys).orderBy(F.desc("score"))
    run = by_score.select(*keys, "score", F.sum("tp").over(down).alias("tp"), F.sum("n").over(down).alias("n")).join(n_gt, list(keys))
    curve = run.withColumn("recall", F.col("tp") / F.col("n_gt")).withColumn("precision", F.col("tp") / F.col("n"))
    after = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    curve = curve.withColumn("precision", F.max("precision").over(after))
    points = curve.withColumn("before", F.coalesce(F.lag("recall").over(Window.partitionBy(*keys).orderBy(F.desc("score"))), F.lit(-1.0)))
    inside = F.floor(F.col("recall") * 100 + 1e-9) - F.floor(F.col("before") * 100 + 1e-9)
    inside = F.when(F.col("before") < 0, F.floor(F.col("recall") * 100 + 1e-9) + 1).otherwise(inside)
    return points.groupBy(*keys).agg((F.sum(F.col("precision") * inside) / 101).alias("ap"))


def greedy_matches(pairs: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """Detections that match: best score first, each takes the free ground truth of highest IoU at or above the threshold (hundredths); native fold."""
    row = F.struct((-F.col("score")).alias("neg"), F.col("dt"), (-F.round("iou", 12)).alias("neg_iou"), F.col("gt"))
    ordered = pairs.where(F.round(F.col("iou") * 100, 6) >= threshold).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    start = F.struct(F.array().cast("array<bigint>").alias("gts"), F.array().cast("array<bigint>").alias("dts"))
    free = lambda s, r: ~F.array_contains(s["gts"], r["gt"]) & ~F.array_contains(s["dts"], r["dt"])
    taken = F.aggregate("rows", start, lambda s, r: F.when(free(s, r), F.struct(F.concat(s["gts"], F.array(r["gt"])).alias("gts"), F.concat(s["dts"], F.array(r["dt"])).alias("dts"))).otherwise(s), lambda s: F.arrays_zip(s["gts"].alias("gt"), s["dts"].alias("dt")))
    return ordered.select(*keys, F.explode(taken).alias("p")).select(*keys, F.col("p.gt").alias("gt"), F.col("p.dt").alias("dt"))


def mean_of_means(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of group means, and the mean over all rows."""
    by_group = df.groupBy(group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    return by_group.agg(F.avg("m").alias("mean_of_means"), (F.sum("s") / F.sum("n")).alias("overall_mean"), F.count("*").alias("n_groups"))
