"""SQL of the queries that rest on a one-to-one assignment: HOTA, TETA, and phrases in videos.

The assignment walks a group's ground truth one by one, and keeps for each set of taken detections (bits) the best total and its pairs.
"""

from __future__ import annotations

from . import evaluation
from .evaluation import _TRACKS_SQL
from .views import GT_SQL, INTER, UNION

_CLOSE = 2.220446049250313e-16


def _assigned(pairs: str, name: str) -> str:
    """{name}(kk, gt, dt): the assignment of the largest total value in each group kk of pairs(kk, gt, dt, value), as far as values are positive."""
    return f"""{name}_g AS (SELECT kk, gt, row_number() OVER (PARTITION BY kk ORDER BY gt) AS k FROM (SELECT DISTINCT kk, gt FROM {pairs})), {name}_d AS (SELECT kk, dt, row_number() OVER (PARTITION BY kk ORDER BY dt) - 1 AS j FROM (SELECT DISTINCT kk, dt FROM {pairs})),
    {name}_e AS (SELECT p.kk, k, CAST(1 AS BIGINT) << CAST(j AS INT) AS bit, value, p.gt, p.dt FROM {pairs} p JOIN {name}_g g ON g.kk = p.kk AND g.gt = p.gt JOIN {name}_d d ON d.kk = p.kk AND d.dt = p.dt UNION ALL SELECT kk, k, 0, 0.0, gt, NULL FROM {name}_g),
    {name}_w AS (SELECT DISTINCT kk, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS mask, CAST(0.0 AS DOUBLE) AS total, CAST([] AS STRUCT(gt BIGINT, dt BIGINT)[]) AS taken FROM {name}_g
        UNION ALL
        SELECT kk, k, mask, total, taken FROM (SELECT w.kk, e.k, w.mask | e.bit AS mask, w.total + e.value AS total, CASE WHEN e.value > 0 THEN list_append(w.taken, {{'gt': CAST(e.gt AS BIGINT), 'dt': CAST(e.dt AS BIGINT)}}) ELSE w.taken END AS taken
            FROM {name}_w w JOIN {name}_e e ON e.kk = w.kk AND e.k = w.k + 1 AND w.mask & e.bit = 0 QUALIFY row_number() OVER (PARTITION BY w.kk, e.k, w.mask | e.bit ORDER BY w.total + e.value DESC) = 1)),
    {name} AS (SELECT kk, unnest(taken, recursive := true) FROM (SELECT kk, taken FROM {name}_w QUALIFY row_number() OVER (PARTITION BY kk ORDER BY k DESC, total DESC) = 1))"""


def _tracked(name: str, of: str, more: str = "") -> str:
    return f"{name} AS (SELECT video_id AS seq, image_id AS t, part * 8 + row_number() OVER (PARTITION BY video_id, image_id, part ORDER BY obj) - 1 AS {name}, x0, y0, x1, y1, w, h{more} FROM {of})"


_SIM = f"sim AS (SELECT * FROM (SELECT a.seq, a.t, a.g AS gt, b.d AS dt, {INTER} / {UNION} AS iou FROM g a JOIN d b ON a.seq = b.seq AND a.t = b.t) WHERE iou > 0)"


def _aligned(sim: str, group: str, name: str) -> str:
    """{name}_m({group}, t, gt, dt, iou): each frame's assignment by alignment times overlap. {name}_ng, {name}_nd: frames of the tracks of a group."""
    on = lambda a, b, *keys: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    keys = group.split(", ")
    kk = f"({', '.join(f's.{k}' for k in keys)}, s.t)"
    return f"""{name}_r AS (SELECT *, sum(iou) OVER (PARTITION BY {group}, t, gt) + sum(iou) OVER (PARTITION BY {group}, t, dt) - iou AS un FROM {sim}),
    {name}_p AS (SELECT {group}, gt, dt, sum(CASE WHEN un > 1e-12 THEN iou / un ELSE 0.0 END) AS p FROM {name}_r GROUP BY ALL),
    {name}_a AS (SELECT p.*, p / (g.n_gt + d.n_dt - p) AS align FROM {name}_p p JOIN {name}_ng g ON {on("g", "p", *keys, "gt")} JOIN {name}_nd d ON {on("d", "p", *keys, "dt")}),
    {name}_v AS (SELECT {kk} AS kk, s.gt, s.dt, align * iou AS value FROM {sim} s JOIN {name}_a a ON {on("s", "a", *keys, "gt", "dt")}), {_assigned(f"{name}_v", f"{name}_x")},
    {name}_m AS (SELECT s.* FROM {sim} s JOIN {name}_x x ON x.kk = {kk} AND x.gt = s.gt AND x.dt = s.dt)"""


def _hota(sides: str) -> str:
    """h(seq, alpha, ...), from g(seq, t, g, box) and d(seq, t, d, box)."""
    return f"""WITH RECURSIVE {GT_SQL}, {sides}, {_SIM}, z_ng AS (SELECT seq, g AS gt, count(*) AS n_gt FROM g GROUP BY ALL), z_nd AS (SELECT seq, d AS dt, count(*) AS n_dt FROM d GROUP BY ALL), {_aligned("sim", "seq", "z")},
    al AS (SELECT unnest(range(1, 20)) / 20 AS alpha), pr AS (SELECT seq, alpha, gt, dt, count(*) AS c, sum(round(iou, 12)) AS loc FROM z_m JOIN al ON iou >= alpha - {_CLOSE} GROUP BY ALL),
    per AS (SELECT p.seq, alpha, sum(c) AS tp, sum(loc) AS loc, sum(c * c / (n_gt + n_dt - c)) AS ass_a, sum(c * c / n_gt) AS ass_re, sum(c * c / n_dt) AS ass_pr FROM pr p JOIN z_ng g ON g.seq = p.seq AND g.gt = p.gt JOIN z_nd d ON d.seq = p.seq AND d.dt = p.dt GROUP BY ALL),
    tot AS (SELECT seq, alpha, coalesce(a.n, 0) AS gt, coalesce(b.n, 0) AS dt FROM (SELECT seq, sum(n_gt) AS n FROM z_ng GROUP BY 1) a FULL JOIN (SELECT seq, sum(n_dt) AS n FROM z_nd GROUP BY 1) b USING (seq), al),
    o AS (SELECT tot.seq, tot.alpha, gt, dt, coalesce(tp, 0) AS tp, coalesce(loc, 0) AS loc, coalesce(ass_a, 0) AS a, coalesce(ass_re, 0) AS re, coalesce(ass_pr, 0) AS pr FROM tot LEFT JOIN per ON per.seq = tot.seq AND per.alpha = tot.alpha),
    h0 AS (SELECT seq, alpha, CAST(tp AS BIGINT) AS tp, CAST(gt - tp AS BIGINT) AS fn, CAST(dt - tp AS BIGINT) AS fp, tp / greatest(1, gt + dt - tp) AS det_a, tp / greatest(1, gt) AS det_re, tp / greatest(1, dt) AS det_pr, a / greatest(tp, 1) AS ass_a, re / greatest(tp, 1) AS ass_re, pr / greatest(tp, 1) AS ass_pr,
        CASE WHEN gt = 0 OR dt = 0 OR tp = 0 THEN 1.0 ELSE loc / tp END AS loc_a FROM o), h AS (SELECT *, sqrt(det_a * ass_a) AS hota, sqrt(det_re * ass_a) AS owta FROM h0)"""


_COMBINED = """SELECT {0}, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(fp) AS BIGINT) AS fp, sum(tp) / greatest(1, sum(tp) + sum(fn) + sum(fp)) AS det_a, sum(ass_a * tp) / greatest(1, sum(tp)) AS ass_a, sum(loc_a * tp) / greatest(1, sum(tp)) AS loc_a FROM h GROUP BY ALL"""
_PLAIN = f"{_tracked('g', 'gt')}, {_tracked('d', 'dt')}"
_r = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
# Shares of whole numbers may lie just between two numbers of six digits; of twelve they don't.
_exact = lambda *names: ", ".join(f"round({n}, {12 if n.startswith('det') else 9}) AS {n}" for n in names)
ORACLE_SQL = {
    "hota_by_sequence": f"{_hota(_PLAIN)} SELECT seq, {_r('alpha')}, tp, fn, fp, {_exact('det_a', 'ass_a', 'ass_re', 'ass_pr', 'loc_a', 'hota', 'owta')} FROM h",
    "hota_combined": f"{_hota(_PLAIN)}, c AS ({_COMBINED.format('alpha')}) SELECT {_r('alpha')}, tp, fn, fp, {_exact('det_a', 'ass_a')}, round(sqrt(det_a * ass_a), 9) AS hota, {_exact('loc_a')} FROM c",
}

_HULLS = lambda name, side: f"{name} AS (SELECT video_id * 10 + category_id AS seq, t, track AS {name}, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h FROM hull WHERE side = '{side}')"
_HULL_SQL = _TRACKS_SQL[len(GT_SQL) + 2 :]
ORACLE_SQL["phrase_hota"] = f"""{_hota(f"{_HULL_SQL}, {_HULLS('g', 'g')}, {_HULLS('d', 'd')}")}, c AS ({_COMBINED.format("seq % 10 AS cls, alpha")})
    SELECT seq, round(avg(hota), 6) AS hota, round(avg(det_a), 6) AS det_a, round(avg(ass_a), 6) AS ass_a FROM h GROUP BY 1
    UNION ALL SELECT CAST(-1 AS BIGINT), round(avg(sqrt(det_a * ass_a)), 6), round(avg(det_a), 6), round(avg(ass_a), 6) FROM c WHERE tp + fn > 0"""


def _teta(detections: str) -> str:
    """c(cls, ...), with the status as class; detections: what dt is taken from."""
    status = ", rf AS cls"
    one = lambda x: f"greatest(1, {x})"
    high = f"alpha >= 0.5 - {_CLOSE}"
    return f"""{detections}, {_tracked("g", "gt", status)}, {_tracked("d", "kept", status)}, {_SIM}, own AS (SELECT s.*, g.cls FROM sim s JOIN g ON g.seq = s.seq AND g.t = s.t AND g.g = s.gt),
    y_ng AS (SELECT cls, seq, g AS gt, count(*) AS n_gt FROM g GROUP BY ALL), y_nd AS (SELECT cls, seq, dt, count(*) AS n_dt FROM (SELECT DISTINCT cls, seq, t, dt FROM own) GROUP BY ALL), {_aligned("own", "cls, seq", "y")},
    al AS (SELECT unnest(range(20)) / 20 AS alpha), hit AS (SELECT m.*, alpha, d.cls AS predicted FROM y_m m JOIN d ON d.seq = m.seq AND d.t = m.t AND d.d = m.dt JOIN al ON iou >= alpha - {_CLOSE}),
    fls AS (SELECT n.cls, al.alpha, count(*) AS loc_fp FROM (SELECT DISTINCT cls, seq, t, dt FROM own WHERE iou >= 0.5) n CROSS JOIN al ANTI JOIN hit ON hit.cls = n.cls AND hit.seq = n.seq AND hit.t = n.t AND hit.dt = n.dt AND hit.alpha = al.alpha GROUP BY ALL),
    pr AS (SELECT cls, seq, alpha, gt, dt, count(*) AS c, count(*) FILTER (cls = predicted) AS right_ FROM hit GROUP BY ALL),
    per AS (SELECT p.cls, alpha, sum(c) AS tp, sum(right_) AS cls_tp, sum(c * c / (n_gt + n_dt - c)) AS a, sum(c * c / n_gt) AS re, sum(c * c / n_dt) AS pr FROM pr p JOIN y_ng g ON g.cls = p.cls AND g.seq = p.seq AND g.gt = p.gt JOIN y_nd d ON d.cls = p.cls AND d.seq = p.seq AND d.dt = p.dt GROUP BY ALL),
    wr AS (SELECT predicted AS cls, alpha, count(*) AS cls_fp FROM hit WHERE cls <> predicted AND {high} GROUP BY ALL),
    ev AS (SELECT n.cls, al.alpha, n.n, coalesce(tp, 0) AS tp, coalesce(cls_tp, 0) AS ct, coalesce(a, 0) AS a, coalesce(re, 0) AS re, coalesce(pr, 0) AS pr, coalesce(loc_fp, 0) AS fp, coalesce(cls_fp, 0) AS cf FROM (SELECT cls, count(*) AS n FROM g GROUP BY 1) n CROSS JOIN al
        LEFT JOIN per ON per.cls = n.cls AND per.alpha = al.alpha LEFT JOIN fls ON fls.cls = n.cls AND fls.alpha = al.alpha LEFT JOIN wr ON wr.cls = n.cls AND wr.alpha = al.alpha),
    c AS (SELECT cls, avg(tp / {one("n + fp")}) AS loc_a, avg(tp / {one("n")}) AS loc_re, avg(tp / {one("tp + fp")}) AS loc_pr, avg(a / {one("tp")}) AS assoc_a, avg(re / {one("tp")}) AS assoc_re, avg(pr / {one("tp")}) AS assoc_pr,
        avg(ct / {one("tp + cf")}) FILTER ({high}) AS cls_a, avg(ct / {one("tp")}) FILTER ({high}) AS cls_re, avg(ct / {one("ct + cf")}) FILTER ({high}) AS cls_pr FROM ev GROUP BY 1)"""


_ALL = f"WITH RECURSIVE {GT_SQL}, kept AS (SELECT * FROM dt)"
# Greedy suppression, best score first: a walk over an image's detections with the list of those that stay.
_SUPPRESSED = f"""WITH RECURSIVE {GT_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, obj) AS k FROM dt WHERE score >= 0.2),
    adj AS (SELECT b.image_id, b.k, list(a.k) FILTER (a.k IS NOT NULL) AS beaten FROM rk b LEFT JOIN rk a ON a.image_id = b.image_id AND a.k < b.k AND {INTER} / {UNION} >= 0.5 GROUP BY ALL),
    sw AS (SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS stay FROM rk UNION ALL SELECT w.image_id, a.k, CASE WHEN a.beaten IS NULL OR len(list_intersect(w.stay, a.beaten)) = 0 THEN list_append(w.stay, a.k) ELSE w.stay END FROM sw w JOIN adj a ON a.image_id = w.image_id AND a.k = w.k + 1),
    sl AS (SELECT image_id, max_by(stay, k) AS stay FROM sw GROUP BY 1), kept AS (SELECT rk.* FROM rk JOIN sl ON sl.image_id = rk.image_id AND list_contains(stay, rk.k))"""
_TETA = "round((loc_a + assoc_a + cls_a) / 3, 6) AS teta"
ORACLE_SQL |= {
    "teta_by_class": f"{_teta(_ALL)} SELECT cls, {_r('loc_a', 'loc_re', 'loc_pr', 'assoc_a', 'assoc_re', 'assoc_pr', 'cls_a', 'cls_re', 'cls_pr')}, {_TETA} FROM c",
    "teta_of_predictions": f"{_teta(_SUPPRESSED)} SELECT cls, {_r('loc_a', 'assoc_a', 'cls_a')}, {_TETA} FROM c",
}

_LEVELS = evaluation._levels_sql(100)
_LEVELS = _LEVELS[_LEVELS.index("c AS (SELECT image_id, category_id, band") :].replace("FROM gt, bands", "FROM tg, bands")
_BANDS = evaluation.evaluation.TRACK_AREAS
ORACLE_SQL["phrase_average_precision"] = f"""WITH RECURSIVE {_TRACKS_SQL}, bands(band, low, high) AS (VALUES {", ".join(f"('{n}', {a}, {b})" for n, (a, b) in _BANDS.items())}), levels AS (SELECT unnest(range(50, 100, 5)) AS thr),
    size AS (SELECT side, video_id, category_id, track, avg((x1 - x0) * (y1 - y0)) AS w FROM hull GROUP BY ALL), tg AS (SELECT *, 1 AS h, false AS iscrowd FROM size WHERE side = 'g'),
    sco AS (SELECT video_id, category_id, part % 12 AS track, round(sum(CAST(round(score * 100) AS BIGINT)) / count(*) / 1000, 4) AS score FROM dt GROUP BY ALL),
    best AS (SELECT z.video_id AS image_id, z.category_id, z.track AS obj, z.w, 1 AS h, score FROM size z JOIN sco USING (video_id, category_id, track) WHERE side = 'd' QUALIFY row_number() OVER (PARTITION BY z.video_id, z.category_id ORDER BY score DESC, z.track) <= 100),
    p AS (SELECT b.image_id, b.category_id, b.obj AS d, ov.gt AS g, b.score, b.w AS area, false AS crowd, a.w AS ga, round(iou * 100, 6) AS v FROM ov JOIN best b ON b.image_id = ov.video_id AND b.category_id = ov.category_id AND b.obj = ov.dt JOIN tg a ON a.video_id = ov.video_id AND a.category_id = ov.category_id AND a.track = ov.gt),
    {_LEVELS} SELECT category_id, band, CAST(thr AS INTEGER) AS thr, round(ap, 6) AS ap, round(recall, 6) AS recall FROM lv"""
