"""Reject reasons and typed evidence of the whole flow."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitchflow import config
from pitchflow.operators import duels, evidence, events, flow, goals, possession, stats
from test_flow import BALL, BOX, TRACK, ball, box


def test_touches_against_the_rule_itself(spark):
    """Only a touch that counts keeps later ones away; what it keeps away is told from what fails by itself."""
    rng = random.Random(3)
    balls, boxes = [], []
    for k in range(400):
        t, x = k / 25, rng.choice([100.0, 100.0, 130.0, 155.0, 900.0, 400.0])
        balls.append((1, 0, k, t, x - 5, 145.0, x + 5, 155.0, rng.choice([0.2, 0.31, 0.6, 0.9])))
        boxes += [(1, 0, tr, k, t, tx - 20.0, 100.0, tx + 20.0, 200.0, 0.8) for tr, tx in ((1, 100.0), (2, 400.0)) if k % 7]
    way = [rng.choice([0.0, 3.0]) for _ in range(80)]
    states = [(1, 0, k / 25, way[k // 5], 0.0, k % 50 > 0) for k in range(400)]
    state = spark.createDataFrame(states, "video_id long, take_id long, t double, vx double, vy double, known boolean")
    got = possession.touch_candidates(spark.createDataFrame(balls, BALL), spark.createDataFrame(boxes, BOX), state)
    rows = {round(r.t_start * 25): r for r in got.collect()}
    assert len(rows) == 400
    kicked = {round(r.t * 25) for r in possession.contact_evidence(got.select("video_id", "take_id", F.col("t_start").alias("t")).distinct(), state).where("kicked").collect()}
    last, reasons = {}, {}
    for _, _, k, t, x1, _, x2, _, conf in balls:
        x, why = (x1 + x2) / 2, None
        track, dist = min(((tr, max(abs(x - tx) - 20, 0.0)) for tr, tx in ((1, 100.0), (2, 400.0))), key=lambda p: p[1])
        c = min(max(0.1 + (1 - dist / 40) * conf * 0.35, 0.1), 0.45)
        if conf < 0.3:
            why = "touch_ball_conf_too_low"
        elif dist > 40:
            why = "touch_ball_too_far_from_any_player"
        elif track in last and round(t - last[track], 9) < 0.3:
            why = "touch_debounced"
        elif k not in kicked:
            why = "touch_no_contact_evidence"
        elif c < config.MIN_EMIT:
            why = "touch_below_min_emit_confidence"
        else:
            last[track] = t
        reasons[k] = why
    assert {k: r.reject for k, r in rows.items()} == reasons
    assert len(Counter(reasons.values())) == 6


def test_rejects_of_odd_takes(spark):
    short = spark.createDataFrame([box(1, t / 10, 100.0 + 90 * t) for t in range(4)], BOX)
    assert [r.reject for r in events.sprint_candidates(short, 10.0).collect()] == ["sprint_track_too_short"]
    balls = spark.createDataFrame([ball(t / 10, 100.0) for t in range(20)], BALL)
    tracks = [(1, 0, 1, 0.0, 2.0, 0, 0.9, "player", None)]
    none = duels.save_candidates(balls, short, spark.createDataFrame(tracks, TRACK), 1280.0).collect()
    assert [r.reject for r in none] == ["save_no_goalkeeper_track_in_take"]
    calm = duels.save_candidates(balls, short, spark.createDataFrame([(*tracks[0][:7], "goalkeeper", None)], TRACK), 1280.0).collect()
    assert [r.reject for r in calm] == ["save_no_fast_ball_approach"]


@pytest.fixture(scope="module")
def match(spark):
    """Two players of a team and one of the other; the ball goes round."""
    boxes = spark.createDataFrame([box(tr, t / 10, x + (8 * t if tr == 3 else 0)) for t in range(60) for tr, x in ((1, 100.0), (2, 400.0), (3, 300.0))], BOX)
    places = [100.0] * 12 + [250.0] * 4 + [400.0] * 12 + [420.0 + 90 * k for k in range(6)] + [300.0 + 8 * k for k in range(34, 60)]
    balls = spark.createDataFrame([ball(t / 10, x) for t, x in enumerate(places)], BALL)
    tracks = spark.createDataFrame([(1, 0, k, 0.0, 6.0, int(k == 3), 0.9, "player", None) for k in (1, 2, 3)], TRACK)
    return balls, boxes, tracks


def test_the_one_table_serves_what_follows(spark, match):
    balls, boxes, tracks = match
    every = flow.candidates(balls, boxes, tracks, None, 1280.0, 10.0).cache()
    found = flow.events_of(every)
    runs = possession.possession_runs(possession.possession_series(balls, boxes, tracks=tracks))
    held = possession.detect_possession(runs, 10.0)
    same = lambda a, b, *c: sorted(map(tuple, a.select(*c).collect())) == sorted(map(tuple, b.select(*c).collect()))
    assert same(evidence.possession_of(found), held, "player_track_id", "t_start", "raw_track_ids", "confidence")
    shots = events.detect_shots(balls, 1280.0)
    read = evidence.typed(found, "shot")
    assert same(read, shots, "t_start", "t_end", "peak_speed") and shots.count()
    wanted = spark.createDataFrame([(1, 0, 2), (1, 0, 1)], "video_id long, take_id long, track_id long")
    near = [stats.attribute_shots(s, boxes, balls, wanted) for s in (shots, read)]
    assert same(*near, "t_start", "player_track_id")
    goal = spark.createDataFrame([(1, 0, 5.5, 0.75)], "video_id long, take_id long, t_after double, confidence double")
    scored = [goals.attribute_goals(goal, p, tracks) for p in (held, evidence.possession_of(found))]
    assert same(*scored, "t_after", "team", "scorer", "confidence") and scored[0].first().scorer is not None
    given = possession.detect_passes(runs, tracks, fps=10.0).where("type = 'pass'")
    own = evidence.passes_of(found)
    assert same(own, given, "passer", "receiver", "t_start", "t_end") and own.count()
    assert {r.type for r in stats.attribute(found, wanted).collect()} >= {"possession", "pass"}
    told = evidence.described(found).where("type = 'pass'").first()
    assert (told.unit, told.calibrated) == ("pixels_at_detect_stage_resolution", False)
    counts = {(r.stage, r.reason): r.n for r in flow.rejects_of(every).collect()}
    assert sum(counts.values()) + found.count() == every.count() and len(counts) > 5


def test_turnovers_that_a_tackle_covers(spark):
    kind = "video_id long, take_id long, type string, player_track_id long, t_start double, t_end double, confidence double"
    lost = {"losing_identity": 1, "receiving_identity": 2, "losing_raw_track_id": 1, "receiving_raw_track_id": 2, "losing_team": 0, "receiving_team": 1, "ball_travel_px": 9.0, "gap_s": 0.1}
    won = {"tackler_identity": 2, "tackled_identity": 1, "tackler_raw_track_id": 2, "tackled_raw_track_id": 1, "closing_speed": 2.0, "gap_s": 0.1}
    rows = [((1, 0, "turnover", 1, 0.0, t, 0.3), "turnover", lost) for t in (1.0, 1.5, 1.6)]
    rows += [((1, 0, "tackle", 2, 0.0, 1.0, 0.3), "tackle", won), ((1, 1, "turnover", 1, 0.0, 1.0, 0.3), "turnover", lost), ((1, 0, "turnover", 1, 0.0, 1.0, 0.3), "turnover", lost | {"receiving_raw_track_id": 3})]
    table = None
    for row, type_, fields in rows:
        one = spark.createDataFrame([row], kind).withColumn("evidence", evidence.pack(type_, **{k: F.lit(v) for k, v in fields.items()}))
        table = one if table is None else table.unionByName(one)
    out = evidence.turnovers_without_tackles(table, 0.5)
    assert out.count() == 6 and sorted(r.t_end for r in out.where("covered").collect()) == [1.0, 1.5]
    with pytest.raises(ValueError):
        evidence.pack("pass", gap_s="gap")
