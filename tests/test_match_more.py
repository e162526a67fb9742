import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.functions import text
from pitchflow.operators import duels, events, filters, goals, identity, possession, series, stats, target
from tests.test_domain import BALL, BOX, ball, box

TRACK = "video_id long, take_id long, track_id long, team int, team_confidence double, dominant_class string"


def sides(r):
    return None if r is None else tuple(round(v, 6) for v in r)


def test_dribbles(spark):
    runner = [box(0, k, 1, i / 10, 100.0 + 20 * i) for k in range(3) for i in range(20)]
    rival = [box(0, k, 2, i / 10, 300.0, 200.0) for k in range(3) for i in range(20)]
    still = [box(0, 3, 1, i / 10, 100.0) for i in range(20)] + [box(0, 3, 2, i / 10, 120.0) for i in range(20)]
    tracks = [(0, k, 1, 0, 0.9, "player") for k in range(4)] + [(0, 0, 2, 1, 0.9, "player"), (0, 1, 2, 0, 0.9, "player"), (0, 2, 2, 1, 0.9, "referee"), (0, 3, 2, 1, 0.9, "player")]
    balls = [ball(k, i / 10, 100.0 + 20 * i) for k in range(3) for i in range(20)] + [ball(3, i / 10, 80.0) for i in range(20)]
    boxes = spark.createDataFrame(runner + rival + still, BOX)
    samples = possession.run_samples(possession.possession_series(spark.createDataFrame(balls, BALL), boxes))
    got = duels.detect_dribbles(samples, boxes, spark.createDataFrame(tracks, TRACK), 10.0).collect()
    assert [(r.take_id, r.player_track_id, round(r.travel, 6)) for r in got] == [(0, 1, 3.8)]  # not by a teammate, a referee or when standing


def test_saves(spark):
    def way(take, back):
        there = [ball(take, i / 25, 100.0 + 20 * i) for i in range(15)]
        return there + [ball(take, (15 + i) / 25, 380.0 + (-20 * (i + 1) if back else 20 * (i + 1))) for i in range(10)]

    halted = [ball(2, i / 25, 100.0 + 20 * i) for i in range(15)] + [ball(2, (15 + i) / 25, 380.0 + i / 10) for i in range(10)]
    balls = spark.createDataFrame(way(0, False) + halted + [ball(3, r[3], 0.0) for r in halted], BALL)
    boxes = spark.createDataFrame([box(0, k, 9, i / 25, 450.0) for k in range(4) for i in range(25)], BOX)
    tracks = spark.createDataFrame([(0, k, 9, None, 0.0, "goalkeeper") for k in range(4)], TRACK)
    got = duels.detect_saves(balls, boxes, tracks, 1280.0).collect()
    assert [(r.take_id, r.player_track_id, r.decelerated, r.reversed) for r in got] == [(2, 9, True, False)]
    assert duels.detect_saves(balls, boxes, tracks.where("dominant_class = 'player'"), 1280.0).count() == 0


def test_goal_sources(spark):
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((100, 0), (200, 0), (200, 200), (100, 200))])
    regions = spark.range(1).select(F.col("id").alias("video_id"), points.alias("polygon"))
    balls = spark.createDataFrame([ball(0, t, x) for t, x in ((1.0, 50.0), (1.5, 150.0), (2.0, 150.0), (4.5, 150.0), (4.6, 150.0), (9.0, 150.0))], BALL)
    fast = spark.createDataFrame([(0, 0, 0.5, 1.0), (0, 0, 3.0, 4.0)], "video_id long, take_id long, t_start double, t_end double")
    assert sorted((r.t_start, r.t_end) for r in goals.region_goals(balls, regions, fast).collect()) == [(1.0, 1.5), (4.0, 4.6)]
    posts = "array(named_struct('x1', 290D, 'y1', 0D, 'x2', 310D, 'y2', 200D), named_struct('x1', 90D, 'y1', 0D, 'x2', 110D, 'y2', 50D))"
    line = spark.range(1).selectExpr("id as video_id", "id as take_id", "1D as t", f"{posts} as posts").select("video_id", "take_id", "t", g.goal_line(F.col("posts")).alias("l"), g.goal_line(F.slice("posts", 1, 1)).alias("none"))
    assert line.first().none is None and line.first().l.left.x == 100.0 and line.first().l.right.y == 200.0
    shots = [ball(0, 1.0, 150.0, 0.0), ball(0, 1.1, 150.0, 190.0), ball(0, 2.0, 150.0, 0.0), ball(0, 2.1, 150.0, 190.0, 0.4)]
    lines = line.select("video_id", "take_id", "t", "l.*")
    crossed = goals.line_goals(spark.createDataFrame(shots, BALL), lines)
    assert [(r.t_start, r.t_end) for r in crossed.collect()] == [(1.0, 1.1)]
    reads = [(0, 0, 0, float(t), t % 3, 0) for t in range(10)] + [(0, 0, 1, float(t), 1, int(t > 7)) for t in range(10)] + [(0, 1, 1, float(t), None, None) for t in range(10)]
    board = goals.scoreboard_goals(spark.createDataFrame(reads, "video_id long, take_id long, region int, t double, home int, away int"))
    assert [(r.take_id, r.t_start, r.t_end) for r in board.collect()] == [(0, 0.0, 8.0)]
    inside = goals.region_goals(balls, regions, fast)
    assert sorted(r.source for r in goals.goal_occurrences(board, crossed, inside, lines).collect()) == ["goal_line_crossing", "scoreboard"]
    assert sorted(r.source for r in goals.goal_occurrences(board, crossed, inside, lines.limit(0)).collect()).count("goal_region") == 2


def test_key_moments(spark):
    boxes = spark.createDataFrame([box(0, 0, 1, i / 25, 100.0 + 6 * i) for i in range(60)] + [box(0, 0, 2, i / 25, 100.0 + 6 * i) for i in range(60)], BOX)
    taken = spark.createDataFrame([(0, 0, 2, 0.5, 1.0)], "video_id long, take_id long, player_track_id long, t_start double, t_end double")
    found = events.candidate_windows(boxes, taken)
    (row,) = found.collect()
    assert (row.track_id, row["rank"]) == (1, 1)
    for said, n in (("VERDICT=YES; a fist pump", 1), ("verdict = no", 0), ("perhaps", 0)):
        assert events.key_moments(found, found.select("video_id", "take_id", "track_id", "t_start", F.lit(said).alias("text"))).count() == n


def brute_plausible(rows, width, most, reseed):
    def speed(a, b):
        dt, d = b[0] - a[0], np.hypot(b[1] - a[1], b[2] - a[2])
        return (0.0 if d == 0 else np.inf) if dt <= 0 else d / dt / width

    good, doubt, firm = [rows[0]], [], False
    for r in rows[1:]:
        if speed(good[-1], r) <= most:
            good, doubt, firm = [*good, r], [], True
        else:
            doubt = [*doubt, r] if doubt and speed(doubt[-1], r) <= most else [r]
            if len(doubt) == reseed:
                good = doubt if len(good) == 1 and not firm else good + doubt
                doubt, firm = [], True
    return good


def test_plausible_balls(spark):
    random.seed(5)
    rows = {v: [(i / 25, float(random.choice([100, 100, 100, 900]) + i), 100.0) for i in range(60)] for v in range(6)}
    rows[6] = [(0.0, 5000.0, 100.0)] + [(i / 25, 100.0 + i, 100.0) for i in range(1, 8)]
    df = spark.createDataFrame([(v, 0, round(25 * t), t, x - 5, y - 5, x + 5, y + 5, 0.9) for v, r in rows.items() for t, x, y in r], BALL)
    got = {}
    for r in series.plausible_balls(df, 1280.0).collect():
        got.setdefault(r.video_id, set()).add(r.frame_index)
    assert got == {v: {round(25 * t) for t, _, _ in brute_plausible(r, 1280.0, 10.0, 5)} for v, r in rows.items()}
    assert 0 not in got[6] and series.plausible_balls(df, 0.0).count() == df.count() and series.plausible_balls(df.limit(0), 1280.0).count() == 0


def test_motion(spark):
    rng = np.random.default_rng(1)
    steps = [(0, k, i / 10, *(None,) * 6) if i in (0, 4) else (0, k, i / 10, *(float(x) for x in np.array([1, 0, 0, 0, 1, 0]) + rng.normal(0, 0.1, 6))) for k in range(2) for i in range(8)]
    df = spark.createDataFrame(steps, "video_id long, take_id long, t double, a double, b double, tx double, c double, d double, ty double")
    motion = series.cumulative_motion(df).cache()
    for k in range(2):
        now, want = np.eye(3), []
        for r in steps[8 * k : 8 * k + 8]:
            now = now if r[3] is None else np.array([[r[3], r[4], r[5]], [r[6], r[7], r[8]], [0, 0, 1.0]]) @ now
            want.append(now[:2].ravel())
        got = [[r.a, r.b, r.tx, r.c, r.d, r.ty] for r in motion.where(f"take_id = {k}").orderBy("t").collect()]
        assert np.allclose(got, want)
    at = motion.selectExpr("video_id", "take_id", "t", "a * 30 + b * 40 + tx as x", "c * 30 + d * 40 + ty as y")
    assert all(r.ref_x == pytest.approx(30) and r.ref_y == pytest.approx(40) for r in series.to_reference(at, motion).collect())
    assert series.to_reference(at.withColumn("t", F.col("t") + 5), motion).where("ref_x is not null").count() == 0


def test_resampled_boxes(spark):
    boxes = spark.createDataFrame([box(0, 0, 1, t, x) for t, x in ((0.0, 100.0), (0.4, 140.0), (2.0, 300.0))], BOX)
    grid = spark.createDataFrame([(0, 0, t) for t in (0.0, 0.1, 0.4, 0.6, 1.2, 2.2, 3.0)], "video_id long, take_id long, t double")
    got = {r.t: (round(r.x1 + 20, 6), r.interpolated) for r in series.resample_boxes(grid, boxes, 0.5, 0.25).collect()}
    assert got == {0.0: (100.0, False), 0.1: (110.0, True), 0.4: (140.0, False), 0.6: (140.0, False), 2.2: (300.0, False)}


def test_even_samples(spark):
    rows = spark.createDataFrame([(0, 0, k, float(i)) for k, n in enumerate((3, 5, 8, 23)) for i in range(n)], "video_id long, take_id long, track_id long, t double")
    got = {}
    for r in series.evenly_sampled(rows, 5).collect():
        got.setdefault(r.track_id, set()).add(int(r.t))
    assert got == {k: set(range(n)) if n <= 5 else {i * n // 5 for i in range(5)} for k, n in enumerate((3, 5, 8, 23))}


def brute_timeline(boxes, own, p):
    def cover(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(w, 0.0) * max(h, 0.0)
        return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)

    mine = sorted((b[4], b[5:9]) for b in boxes if b[2] in own)
    last = since = None
    searched, out = False, {}
    for t in sorted({b[4] for b in boxes}):
        exact = [b for u, b in mine if u == t]
        pre, post = [m for m in mine if m[0] < t], [m for m in mine if m[0] > t]
        here = exact[0] if exact else None
        if here is None and pre and post and post[0][0] - pre[-1][0] <= p["age"] + 1e-12:
            f = (t - pre[-1][0]) / (post[0][0] - pre[-1][0])
            here = tuple(a + f * (b - a) for a, b in zip(pre[-1][1], post[0][1], strict=True))
        ref = here or (last and last[1])
        over = max([cover(b[5:9], ref) for b in boxes if b[4] == t and b[2] not in own] or [0.0]) if ref else 0.0
        if here:
            if searched:
                since, searched = t, False
            out[t] = "reconnected" if since is not None and round(t - since, 9) <= p["hold"] else "partially_occluded" if over >= p["partial"] else "visible"
            last = (t, here)
        elif over >= p["occlusion"]:
            out[t] = "occluded"
        elif last is None or round(t - last[0], 9) >= p["grace"]:
            out[t], searched = "searching", True
        else:
            out[t] = "lost"
    return out


def test_target_timeline(spark):
    random.seed(2)
    boxes = [box(0, k, 1, i / 25, 100.0 + i) for k in range(2) for i in range(10, 200) if not (40 <= i < 60 or 80 <= i < 140)]
    boxes += [box(0, k, j, i / 25, random.choice([120.0, 160.0, 700.0]) + i) for k in range(2) for j in (2, 3) for i in range(0, 200, j)]
    own = spark.createDataFrame([(0, 0, 1)], "video_id long, take_id long, track_id long")
    p = {"age": 0.08, "occlusion": 0.3, "partial": 0.3, "grace": 1.0, "hold": 0.5}
    got = target.target_timeline(spark.createDataFrame(boxes, BOX), own, p).collect()
    want = {k: brute_timeline([b for b in boxes if b[1] == k], ids, p) for k, ids in ((0, {1}), (1, set()))}
    assert {(r.take_id, r.t): r.state for r in got} == {(k, t): s for k, rows in want.items() for t, s in rows.items()}
    assert {s for s in want[0].values()} == {"visible", "partially_occluded", "occluded", "searching", "lost", "reconnected"}
    assert all((r.x1 is None) == (r.state in ("occluded", "searching", "lost")) for r in got)


LAB = "struct<l:double,a:double,b:double>"
KIT = f"struct<torso:{LAB},shorts:{LAB},socks:{LAB}>"
AT = "struct<x:double,y:double,h:double>"


def test_candidates(spark):
    red, near, far = (50.0, 60.0, 40.0), (52.0, 60.0, 40.0), (90.0, 0.0, 0.0)
    own = spark.createDataFrame([(0, (red, red, None), "7", 100.0, (0.0, 0.0, 100.0))], f"video_id long, kit {KIT}, jersey string, height double, last {AT}")
    here, away = (0.0, 0.0, 100.0), (540.0, 0.0, 100.0)
    cases = [
        ((near, far, None), None, 100.0, here, "accept", 1.0),
        ((far, red, None), "7", 100.0, here, "reject", 0.0),
        ((None, near, None), "9", 100.0, here, "reject", 0.0),
        ((near, None, None), "7", 50.0, here, "reject", 0.0),
        ((None, None, None), None, None, None, "reject", 0.0),
        ((near, None, None), None, 100.0, away, "uncertain", (0.4 + 0.15 + 0.15 * 0.1) / 0.7),
        (None, "7", None, None, "accept", 1.0),
    ]
    rows = spark.createDataFrame([(0, i, *c[:4]) for i, c in enumerate(cases)], f"video_id long, track_id long, kit {KIT}, jersey string, height double, first {AT}")
    got = {r.track_id: (r.decision, r.score) for r in target.verify_candidates(rows, own).collect()}
    assert got == {i: (c[4], pytest.approx(c[5])) for i, c in enumerate(cases)}
    assert sorted(r.track_id for r in target.without_contradicted(rows, own).collect()) == [0, 3, 4, 5, 6]


def test_seeds(spark):
    boxes = spark.createDataFrame([box(0, 0, 1, i / 10, 100.0) for i in range(10)] + [box(0, 0, 2, i / 10, 640.0, 360.0) for i in range(10)] + [box(0, 1, 3, 0.0, 100.0)], BOX)
    hints = spark.createDataFrame([(0, 0, 0, 0.0, 110.0, 100.0), (0, 0, 1, 0.1, 250.0, 100.0), (0, 0, 2, 0.2, 640.0, 100.0)], "video_id long, take_id long, frame_index long, t double, x double, y double")
    votes = target.vote_seed_tracks(hints, boxes)
    assert [(r.track_id, r.n_votes) for r in votes.collect()] == [(1, 2)]
    tracks = spark.createDataFrame([(0, 0, 1, 0, 0.9, "player"), (0, 0, 2, 0, 0.9, None), (0, 1, 3, 0, 0.9, "player")], TRACK)
    seeds = target.fallback_seeds(boxes, tracks, 1280.0, 720.0)
    assert [(r.take_id, r.track_id, r.score) for r in seeds.collect()] == [(0, 2, pytest.approx(1.0))]
    takes = spark.createDataFrame([(0, k) for k in range(4)], "video_id long, take_id long")
    pick = target.select_targets(takes, spark.createDataFrame([(0, 2, 8)], "video_id long, take_id long, track_id long"), votes, seeds.withColumn("take_id", F.lit(1).cast("long")))
    assert {r.take_id: (r.method, r.track_id, r.confidence) for r in pick.collect()} == {0: ("arrow_vote", 1, 1.0), 1: ("fallback", 2, 0.35), 2: ("manual", 8, 1.0), 3: ("none", None, 0.0)}
    clicks = hints.limit(1).selectExpr("video_id", "take_id", "t", "0.5D as x", "0.5D as y")
    assert target.match_clicks(clicks, boxes, 1280.0, 720.0).first().track_id == 2


def test_teams(spark):
    rows = [(0, 0, i, 40.0 + i % 3 if i % 2 else 90.0 + i % 3, 0.0, 0.0) for i in range(8)] + [(0, 0, 9, None, 0.0, 0.0), (0, 1, 1, 40.0, 0.0, 0.0)]
    got = {(r.take_id, r.track_id): (r.team, r.team_confidence) for r in identity.assign_teams(spark.createDataFrame(rows, "video_id long, take_id long, track_id long, l double, a double, b double")).collect()}
    assert all(got[0, i][0] == 1 - i % 2 and got[0, i][1] > 0.9 for i in range(8))
    assert got[0, 9] == (None, 0.0) and got[1, 1] == (None, 0.0)


def test_reads_and_chains(spark):
    reads = spark.createDataFrame([(0, "7", 0.9), (0, "8", 0.3), (1, "7", 0.9), (1, "8", 0.5), (2, "abc", 0.9), (3, "7", 0.2)], "crop long, digits string, confidence double")
    assert {r.crop: (r.digits, r.confident) for r in identity.confident_reads(reads, ["crop"]).collect()} == {0: ("7", True), 1: ("7", False), 3: ("7", False)}
    chain = spark.createDataFrame([(0, 0, 1, i) for i in (1, 2, 3, 4)] + [(0, 1, 5, 6)], "video_id long, take_id long, seed long, track_id long")
    numbers = spark.createDataFrame([(0, 0, 1, "7"), (0, 0, 2, "7"), (0, 0, 3, "9"), (0, 1, 6, "9")], "video_id long, take_id long, track_id long, digits string")
    assert sorted(r.track_id for r in identity.prune_chain(chain, numbers).collect()) == [1, 2, 4, 6]
    crops = spark.createDataFrame([(0, 0, 1, 0, 1), (0, 0, 1, 1, 0), (0, 0, 2, 0, 0), (0, 0, 2, 1, 0), (0, 0, 2, 2, 1)], "video_id long, take_id long, track_id long, crop long, label int")
    assert {r.track_id: (r.team, round(r.team_confidence, 3)) for r in identity.majority_teams(crops).collect()} == {1: (1, 0.5), 2: (0, 0.667)}
    votes = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.7), (1, 1, 0.9), (1, 2, 0.8), (2, 3, 0.1)], "k long, track_id long, agreement double")
    assert {r.k: r.track_id for r in identity.claimed_track(votes, ["k"]).collect()} == {0: 1, 2: 3}
    frame = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0), (0, 0, 1.0, 0.0, 11.0, 10.0), (0, 0, 90.0, 0.0, 99.0, 10.0), (0, 1, 0.0, 0.0, 1.0, 1.0)], "video_id long, take_id long, x1 double, y1 double, x2 double, y2 double")
    assert [(r.take_id, r.x1, r.n_inliers) for r in identity.structure_votes(frame).collect()] == [(0, 0.5, 2)]


def test_cards_and_timelines(spark):
    card = "**Identity Status:** Verified\n**Touches:** 12 in all\n**Goals:** not available (no scoreboard)\n**Possession Time:** 3.5s\n| Time | Event | Confidence |\n|---|---|---|\n| 0:05.0 | Pass | 0.5 |\n| 0:07.0 | Shot | high |"
    df = spark.createDataFrame([(1, card), (2, None), (3, "")], "k int, c string").select("k", text.stat_card(F.col("c")).alias("s"))
    one, two, three = (r.s for r in df.orderBy("k").collect())
    assert (one.identity_status, one.touches, one.goals, one.possession_time, one.distance_covered) == ("Verified", 12, 0, "3.5s", "uncertain")
    assert [(e.time, e.event, e.confidence) for e in one.events] == [("0:05.0", "Pass", 0.5), ("0:07.0", "Shot", 0.9)]
    assert two == three and (two.identity_status, two.touches, two.events) == ("Unknown", 0, [])
    rows = spark.createDataFrame([("pass", ""), ("possession", ""), ("key_moment", "They Celebrate"), ("key_moment", None)], "type string, said string")
    assert sorted(r.label for r in stats.timeline(rows, "said").collect()) == ["Celebration", "Other Key Moment", "Pass"]
    answers = spark.createDataFrame([("NUMBER=12",), ("number = unknown",), (None,)], "a string").select(text.number_answer(F.col("a")).alias("n"))
    assert [tuple(r.n) for r in answers.collect()] == [("12", 0.75), (None, 0.15), (None, 0.0)]
    boxes = spark.createDataFrame([("GOAL=10,20,500,900",), ("GOAL=500,20,10,900",), ("none",)], "a string").select(text.goal_box_answer(F.col("a")).alias("b"))
    assert [sides(r.b) for r in boxes.collect()] == [(0.01, 0.02, 0.5, 0.9), None, None]


def test_shots_near_the_target(spark):
    shots = spark.createDataFrame([(0, 0, "shot", 1.0, 2.0), (0, 0, "shot", 9.0, 10.0)], "video_id long, take_id long, type string, t_start double, t_end double")
    boxes = spark.createDataFrame([box(0, 0, 1, 0.9, 100.0), box(0, 0, 2, 1.0, 5000.0)], BOX)
    balls = spark.createDataFrame([ball(0, 1.1, 400.0)], BALL)
    ids = lambda *i: spark.createDataFrame([(0, 0, k) for k in i], "video_id long, take_id long, track_id long")
    assert [r.player_track_id for r in stats.attribute_shots(shots, boxes, balls, ids(1)).collect()] == [1]
    assert stats.attribute_shots(shots, boxes, balls, ids(1, 2)).count() == 0


def test_colours(spark):
    colours = spark.createDataFrame([(0, 0, 1, 50.0, 0.0, 0.0), (0, 0, 2, 90.0, 0.0, 0.0), (0, 0, 3, None, 0.0, 0.0)], "video_id long, take_id long, track_id long, l double, a double, b double")
    asked = spark.createDataFrame([(0, 0, (95.0, 0.0, 0.0)), (0, 0, (70.0, 0.0, 0.0))], f"video_id long, take_id long, ref {LAB}")
    assert {r.ref.l: (r.track_id, r.dist) for r in target.nearest_colour(colours, asked).collect()} == {95.0: (2, 5.0), 70.0: (None, 20.0)}
    rows = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, None, 2), (None, 2, 2), (None, None, 2), (1, 1, 0)], "a int, b int, n int")
    got = [tuple(r.c) for r in rows.select(target.combined(F.col("a"), F.col("b"), F.col("n")).alias("c")).collect()]
    assert got == [(1, "corroborated"), (1, "disagreement"), (1, "colour_only"), (2, "arrow_fallback"), (None, "no_confident_signal"), (None, "no_candidates")]


def test_overrides(spark):
    rows = spark.createDataFrame([("0:30,1:10, 7 ,0:30,x",)], "s string").select(filters.overrides(F.col("s")).alias("o"))
    assert [tuple(p) for p in rows.first().o] == [(0, 30), (1, 10), (0, 7)]


def test_extended_chains(spark):
    random.seed(7)
    rows, chains = [], []
    for k in range(6):
        for i in range(14):
            start = random.randrange(60) / 2
            rows.append((0, k, i, start, start + random.randrange(1, 8) / 2, random.choice([0, 1, None]), random.choice([100.0, 90.0, 50.0, None]), random.choice(["7", "9", None, None])))
        chains.append((0, k, 0, 0))
    tracks = spark.createDataFrame(rows, "video_id long, take_id long, track_id long, t_start double, t_end double, team int, height double, digits string")
    got = identity.extend_chains(spark.createDataFrame(chains, "video_id long, take_id long, seed long, track_id long"), tracks).collect()
    want = set()
    for k in range(6):
        own = sorted((r for r in rows if r[1] == k), key=lambda r: (r[3], r[2]))
        (seed,) = (r for r in own if r[2] == 0)
        taken = [seed]
        for c in own:
            unlike = any(a is not None and b is not None and a != b for a, b in ((c[5], seed[5]), (c[7], seed[7])))
            unlike = unlike or c[6] is not None and seed[6] is not None and min(c[6], seed[6]) / max(c[6], seed[6]) < 0.6
            if c is not seed and not unlike and not any(c[3] < t[4] and t[3] < c[4] for t in taken):
                taken.append(c)
        want |= {(k, c[2], c is not seed) for c in taken}
    assert {(r.take_id, r.track_id, r.added) for r in got} == want and any(added for _, _, added in want)
