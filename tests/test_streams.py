"""Streams with state of several kinds against the batch operators over the same frames, and against cases by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import boxes
from framelake.operators import lifecycle, sequences
from framelake.plans import lifecycle as plans
from framelake.streaming import outputs as held
from framelake.streaming import tracker

SF = "/root/testdata/sf0.001"


def streamed(df, operator, folder, order, batches=3):
    """All rows that the operator makes of df, arriving in micro-batches by `order`; the query is started anew for each, from its checkpoint."""
    spark = df.sparkSession
    df.write.parquet(str(folder / "all"))
    df = spark.read.parquet(str(folder / "all"))
    low, high = df.agg(F.min(order), F.max(order)).first()
    out = []
    for k in range(batches):
        at = lambda k: low + (high + 1 - low) * k // batches
        df.where((F.col(order) >= at(k)) & (F.col(order) < at(k + 1))).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = operator(spark.readStream.schema(df.schema).parquet(str(folder / "in")))
        query = stream.writeStream.outputMode("append").option("checkpointLocation", str(folder / "state")).foreachBatch(lambda rows, _: out.extend(rows.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


RULES = tracker.Rules(near=0.3, strict=0.3, margin=0.12, budget=6, delay=12, misses=3, repeats=2, start=4, most=6, recondition_every=4)


@pytest.fixture(scope="module")
def planned(spark, tmp_path_factory):
    """Events of the planning stream over the videos of the test table."""
    rows = streamed(plans.frames_to_plan(spark, SF), lambda df: tracker.plan_sessions(df, RULES), tmp_path_factory.mktemp("plan"), "frame", 4)
    assert {r.kind for r in rows} >= {"matched", "candidate", "new", "lost", "removed_lost", "removed_double", "reconditioned", "object", "confirmed"}
    return rows


def test_stream_equals_batch_run(spark, planned):
    """Micro-batches change nothing: the same operator over the table gives the same events."""
    whole = tracker.plan_sessions(plans.frames_to_plan(spark, SF), RULES).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, planned))


def log(spark, planned, birth):
    """session, object, frame, matched of the living objects; with their first frame as a match, if asked."""
    seen = {(r.session, r.object, r.frame): r.kind == "matched" for r in planned if r.kind in ("lost", "matched")}
    seen |= {(r.session, r.object, r.frame): True for r in planned if birth and r.kind == "new"}
    return spark.createDataFrame([(*k, m) for k, m in seen.items()], "session long, object long, frame long, matched boolean")


def test_removals_equal_batch(spark, planned):
    births = spark.createDataFrame([(r.session, r.object, r.frame) for r in planned if r.kind == "new"], "session long, object long, born long")
    matches = spark.createDataFrame([(r.session, r.frame, r.det, r.object) for r in planned if r.kind == "matched"], "session long, frame long, det long, object long")
    due = {(r.session, r.object): r.removed_at for r in lifecycle.duplicate_removals(matches, births, ["session"], RULES.delay, RULES.repeats).collect()}
    lost = {(r.session, r.object): r.frame for r in planned if r.kind == "removed_lost"}
    double = {(r.session, r.object): r.frame for r in planned if r.kind == "removed_double"}
    assert double and double == {k: at for k, at in due.items() if lost.get(k) != at}
    born = {(r.session, r.object): r.born for r in births.collect()}
    misses: dict = {}
    want = {}
    for r in sorted((r for r in planned if r.kind == "lost"), key=lambda r: r.frame):
        key = r.session, r.object
        misses[key] = misses.get(key, 0) + 1
        if misses[key] >= RULES.misses and r.frame - born[key] < RULES.delay:
            want[key] = r.frame
    assert lost and lost == want


def test_counters_equal_batch(spark, planned):
    alive = {(r.session, r.object, r.frame): r.value for r in planned if r.kind == "object"}
    kept = sequences.kept_alive(log(spark, planned, False), ["session", "object"], "matched", RULES.start, RULES.most, RULES.least).collect()
    assert kept and all(alive.get((r.session, r.object, r.frame), r.alive) == r.alive for r in kept)
    confirmed = {(r.session, r.object, r.frame) for r in planned if r.kind == "confirmed"}
    batch = sequences.confirmed(log(spark, planned, True), ["session", "object"], "matched", RULES.needed).collect()
    assert confirmed and confirmed == {(r.session, r.object, r.frame) for r in batch if r.confirmed and (r.session, r.object, r.frame) in alive}


def test_numbers_equal_batch(spark, planned):
    """Border, budget and numbers of the new objects."""
    every = plans.frames_to_plan(spark, SF).select("session", "frame", F.explode("detections").alias("e")).select("session", "frame", "e.*")
    candidates = spark.createDataFrame([(r.session, r.frame, r.det) for r in planned if r.kind == "candidate"], "session long, frame long, det long").join(every, ["session", "frame", "det"])
    frames = sorted({(r.session, r.frame) for r in planned})
    held_by, largest, known, rows = {}, {}, {}, {}
    for r in planned:
        rows.setdefault((r.session, r.frame), []).append(r)
    for session, frame in frames:
        known[session, frame] = (held_by.get(session, 0), largest.get(session, -1))
        held_by[session] = sum(r.kind == "object" for r in rows[session, frame])
        largest[session] = max([largest.get(session, -1), *(r.object for r in rows[session, frame] if r.kind == "new")])
    known = spark.createDataFrame([(*k, *v) for k, v in known.items()], "session long, frame long, n_objects long, largest long")
    outside = boxes.near_boundary(boxes.box("x0", "y0", "x1", "y1"), 1.0, 1.0, RULES.margin)
    batch = lifecycle.planned_objects(candidates, known, ["session", "frame"], RULES.budget, "score", "det", outside)
    new = {(r.session, r.frame, r.det, r.object) for r in planned if r.kind == "new"}
    assert new and new == {(r.session, r.frame, r.det, r.object) for r in batch.collect()}
    assert len(new) < candidates.count()


def run_frames(rules, frames):
    """Events by frame of [(detections, predicted)], without streams."""
    objects, pairs, largest, out = {}, {}, -1, []
    for k, (found, predicted) in enumerate(frames):
        events, largest = tracker.plan_frame(rules, k, found, predicted, objects, pairs, largest)
        out.append({kind: [e[1:] for e in events if e[0] == kind] for kind in {e[0] for e in events}})
    return out, objects, pairs


A, B, C = (0.1, 0.1, 0.3, 0.3), (0.5, 0.5, 0.7, 0.7), (0.11, 0.1, 0.31, 0.3)


def test_duplicates_are_removed_while_young_and_suppressed_later():
    """Two objects on one detection: the younger goes after two common frames; too old for that, lost objects are suppressed instead, and come back when matched."""
    rules = tracker.Rules(delay=4, misses=2, repeats=2, start=1, most=3, recondition_every=0, hide_overlap=0)
    one, two = [(0, 0.9, A)], [(0, 0.9, A), (1, 0.9, B)]
    out, objects, pairs = run_frames(rules, [(one, {}), (two, {}), (one, {1: A}), (one, {1: A})])
    assert out[2]["matched"] == [(0, 0, 1.0), (1, 0, 1.0)] and [e[0] for e in out[3]["removed_double"]] == [1]
    assert list(objects) == [0] and pairs == {}
    out, objects, _ = run_frames(rules, [(one, {})] * 5 + [([], {})] * 4 + [(one, {})] * 2)
    assert all("removed_lost" not in e for e in out) and [("suppressed" in e) for e in out] == [False] * 7 + [True] * 3 + [False]
    assert list(objects) == [0] and objects[0].confirmed
    out, objects, _ = run_frames(rules, [(one, {}), ([], {}), ([], {})])
    assert out[2]["removed_lost"] == [(0, None, None)] and objects == {}


def test_the_object_occluded_last_is_hidden():
    rules = tracker.Rules(near=0.99, strict=0.0, recondition_every=0, hide_overlap=0.7)
    empty = (0.0, 0.0, 0.0, 0.0)
    frames = [([(0, 0.9, A), (1, 0.9, B)], {}), ([], {0: empty, 1: B}), ([], {0: A, 1: empty}), ([], {0: A, 1: C}), ([], {0: A, 1: B})]
    out, objects, _ = run_frames(rules, frames)
    assert [e.get("empty", []) for e in out] == [[], [(0, None, None)], [(1, None, None)], [], []]
    assert [e.get("hidden", []) for e in out] == [[], [], [], [(1, None, None)], []] and objects[1].occluded == 3
    never, _, _ = run_frames(rules, [frames[0], ([], {0: A, 1: C})])
    assert all("hidden" not in e for e in never)


def test_reconditioned_borders_and_budget():
    rules = tracker.Rules(recondition_every=2, budget=2, margin=0.025, hide_overlap=0)
    edge = (0.0, 0.4, 0.04, 0.6)
    out, objects, _ = run_frames(rules, [([(0, 0.75, A), (1, 0.9, edge), (2, 0.8, B), (3, 0.9, (0.7, 0.1, 0.9, 0.3))], {}), ([(0, 0.9, C)], {}), ([(0, 0.9, C)], {}), ([(0, 0.7, A)], {})])
    assert [e[1] for e in out[0]["candidate"]] == [0, 1, 2, 3] and out[0]["new"] == [(0, 2, 0.8), (1, 3, 0.9)]
    rules = tracker.Rules(recondition_every=2, hide_overlap=0)
    out, objects, _ = run_frames(rules, [([(0, 0.75, A)], {}), ([(0, 0.9, C)], {}), ([(5, 0.9, C)], {}), ([(0, 0.7, A)], {})])
    assert "reconditioned" not in out[1] and out[2]["reconditioned"][0][:2] == (0, 5) and objects[0].box == C


def test_reversed_and_late_frames(spark):
    kind = "session long, frame long, detections array<struct<det: long, score: double, x0: double, y0: double, x1: double, y1: double>>, tracks array<struct<object: long, x0: double, y0: double, x1: double, y1: double>>"
    rows = [(1, f, [(0, 0.9, *A)] if f > 2 else None, None) for f in range(6)] + [(1, 3, [], []), (2, 0, None, None)]
    rules = tracker.Rules(misses=2, delay=9, recondition_every=0, reverse=True)
    got = tracker.plan_sessions(spark.createDataFrame(rows, kind), rules).collect()
    assert [(r.frame, r.object) for r in got if r.kind == "removed_lost"] == [(1, 0)] and [r.frame for r in got if r.kind == "late"] == [3]
    assert tracker.plan_sessions(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("delay,look", [(5, 2), (1, 0), (3, 4), (1000, 1)])
def test_held_back_stream_equals_batch(spark, tmp_path, delay, look):
    frames = plans.outputs_of_sessions(spark, SF)
    got = {(r.session, r.frame): (r.released_at, r.objects) for r in streamed(frames, lambda df: held.hold_back(df, delay, look), tmp_path, "frame")}
    want = {(r.session, r.frame): (r.released_at, r.objects) for r in lifecycle.held_back_outputs(frames, ["session"], delay, look).collect()}
    assert got == want and want and any(o != r.objects for r in frames.collect() for _, o in [want[r.session, r.frame]])


def test_held_back_by_hand(spark):
    """Three frames held; object 2 is removed in frame 3, object 3 unconfirmed until frame 4; an unfinished session keeps its last frames, reversed runs look back."""
    kind = "session long, frame long, n_frames long, last boolean, objects array<long>, removed array<long>, suppressed array<long>, unconfirmed array<long>"
    rows = [(s, f, 8, f == 7 and s == 1, [1, 2, 3], [2] if f == 3 else None, [1] if f == 2 else [], [3] if f < 5 else None) for s in (1, 2) for f in range(8)]
    got = {(r.session, r.frame): (r.released_at, r.objects) for r in held.hold_back(spark.createDataFrame(rows, kind), 3, 2).collect()}
    assert [got[1, f] for f in range(8)] == [(2, [2] if f == -1 else [1, 2]) if f == 0 else (min(f + 2, 7), [x for x in ([] if f == 2 else [1]) + ([3] if f > 2 else [])]) for f in range(8)]
    assert sorted(f for s, f in got if s == 2) == list(range(6))
    back = [(1, f, 4, f == 0, [1, 2], [], [], [2] if f > 1 else []) for f in (3, 2, 1, 0)]
    got = held.hold_back(spark.createDataFrame(back, kind), 2, 1, reverse=True).collect()
    assert {r.frame: (r.released_at, r.objects) for r in got} == {3: (2, [1]), 2: (1, [1, 2]), 1: (0, [1, 2]), 0: (0, [1, 2])}


def test_action_log_equals_batch(spark, tmp_path):
    """Every session asks after each of its actions, across micro-batches; the last answer is what the batch operator says of the whole log."""
    rng = random.Random(7)
    types = ["add", "refine", "remove", "propagation_full", "propagation_partial", "propagation_fetch"]
    rows, logs = [], {}
    for k in range(400):
        session = rng.randrange(12)
        action = (rng.choice(types), rng.randrange(4), [rng.randrange(5) for _ in range(rng.randrange(3))])
        logs.setdefault(session, []).append(action)
        rows += [(session, 2 * k, *action, 4), (session, 2 * k + 1, "ask", None, None, 4)]
    rows.append((99, 900, "ask", None, None, 4))
    df = spark.createDataFrame(rows, "session long, seq long, type string, frame long, objects array<long>, n_frames long")
    got = {(r.session, r.seq): (r.propagation, r.objects) for r in streamed(df, held.answer_asks, tmp_path, "seq")}
    for at in (150, 301, 800):
        actions = df.where((F.col("type") != "ask") & (F.col("seq") < at)).drop("n_frames")
        sessions = df.where(F.col("seq") < at).select("session", "n_frames").distinct()
        want = {r.session: (r.propagation, r.objects) for r in lifecycle.next_propagation(sessions, actions, "session").collect()}
        last = {s: max(q for t, q in got if t == s and q < at) for s in want}
        assert {s: (got[s, q][0], sorted(set(got[s, q][1] or [])) if got[s, q][0] != "propagation_partial" else got[s, q][1]) for s, q in last.items()} == {
            s: (p, sorted(set(o or [])) if p != "propagation_partial" else o) for s, (p, o) in want.items()
        }
    assert got[99, 900] == ("propagation_full", None)


def test_the_frames_of_a_table_go_to_the_planner_as_one_row_a_session(spark):
    frames = plans.frames_to_plan(spark, SF)
    packed = tracker._packed(frames).collect()
    assert len(packed) == frames.select("session").distinct().count() < frames.count()
    got = {(r.session, f): (sorted(d), o) for r in packed for f, d, o in tracker._unpacked(type("Row", (), {c: np.array(r[c]) for c in packed[0].asDict()}))}
    box = lambda x: (x.x0, x.y0, x.x1, x.y1)
    assert got == {(r.session, r.frame): (sorted((d.det, d.score, box(d)) for d in r.detections), [(t.object, box(t)) for t in r.tracks or []]) for r in frames.collect()}
