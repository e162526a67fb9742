import math
import random

import pytest
from pyspark.sql import functions as F

from pitchflow.functions import geometry as g
from pitchflow.functions import text
from pitchflow.operators import events, filters, goals, identity, possession, series, stats, timejoin
from pitchflow.sources import records


def box(video, take, track, t, x, y=100.0, conf=0.8):
    return (video, take, track, round(30 * t), t, x - 20.0, y - 50.0, x + 20.0, y + 50.0, conf)


BOX = "video_id long, take_id long, track_id long, frame_index long, t double, x1 double, y1 double, x2 double, y2 double, conf double"
BALL = "video_id long, take_id long, frame_index long, t double, x1 double, y1 double, x2 double, y2 double, conf double"


def ball(take, t, x, y=100.0, conf=0.9):
    return (0, take, round(30 * t), t, x - 5.0, y - 5.0, x + 5.0, y + 5.0, conf)


def test_threshold_segments_boundaries(spark):
    rows = [(0, 0.0, 1.0), (0, 0.5, 1.0), (0, 1.0, 0.0), (0, 1.0 + 1e-3, 1.0), (1, 0.0, 1.0), (1, 1.0, 1.0), (1, 1.5, 0.0), (1, 1.6, 1.0), (1, 2.6, 1.0)]
    df = spark.createDataFrame(rows, "k long, t double, v double")
    got = {(r.k, r.t_start, r.t_end) for r in series.threshold_segments(df, "v", 1.0, 1.0, 0.6, ["k"]).collect()}
    assert got == {(0, 0.0, 1.001), (1, 0.0, 1.0), (1, 1.6, 2.6)}  # a gap of the merge limit does not merge


def test_nearest_in_time_ties_and_brute_force(spark):
    random.seed(3)
    left = [(0, random.randrange(2), i, random.randrange(40) / 10) for i in range(60)]
    right = [(0, random.randrange(2), j, random.randrange(40) / 10) for j in range(40)]
    a = spark.createDataFrame(left, "video_id long, take_id long, i long, t double")
    b = spark.createDataFrame(right, "video_id long, take_id long, j long, t double")
    for tie, sign in (("later", -1), ("earlier", 1)):
        want = {}
        for v, k, i, t in left:
            hits = [(round(abs(u - t), 9), sign * u) for v2, k2, j, u in right if (v, k) == (v2, k2) and abs(u - t) <= 0.3 + 1e-12]
            if hits:
                want[i] = sign * min(hits)[1]
        got = {r.i: r.near.t for r in timejoin.nearest_in_time(a, b, 0.3 + 1e-12, tie=tie).collect()}
        assert got == pytest.approx(want)


def test_runs_do_not_cross_takes(spark):
    boxes = spark.createDataFrame([box(0, k, 1, i / 10, 100.0) for k in (0, 1) for i in range(10)], BOX)
    balls = spark.createDataFrame([ball(k, i / 10, 110.0) for k in (0, 1) for i in range(10)], BALL)
    runs = possession.possession_runs(possession.possession_series(balls, boxes)).collect()
    assert sorted((r.take_id, r.n, r.identity) for r in runs) == [(0, 10, 1), (1, 10, 1)]


def test_pass_and_turnover(spark):
    boxes = [box(0, 0, 1, i / 10, 100.0) for i in range(30)] + [box(0, 0, 2, i / 10, 400.0) for i in range(30)]
    balls = [ball(0, i / 10, 100.0) for i in range(6)] + [ball(0, i / 10, 400.0) for i in range(9, 20)]
    for teams, kind in (((0, 0), "pass"), ((0, 1), "turnover"), ((0, None), None)):
        kit = "struct<l:double,a:double,b:double>"
        tracks = spark.createDataFrame([(0, 0, i, t, 0.9 if t is not None else 0.0, None, 0.0) for i, t in zip((1, 2), teams, strict=True)], f"video_id long, take_id long, track_id long, team int, team_confidence double, kit {kit}, t_start double")
        runs = possession.possession_runs(possession.possession_series(spark.createDataFrame(balls, BALL), spark.createDataFrame(boxes, BOX)))
        (r,) = possession.detect_passes(runs, tracks, fps=10.0).collect()
        assert (r.type, r.passer, r.receiver) == (kind, 1, 2)
        assert r.reject == (None if kind else "team_unknown")


def test_score_increments(spark):
    cases = {
        0: ([0, 0, 1, 1, 1], [(0, 2)]),
        1: ([0, 1, 0, 0], []),
        2: ([0, 2, 2, 3, 3], [(1, 3)]),
        3: ([1, 0, 0, 1, 1], [(1, 3)]),
    }
    rows = [(0, k, float(t), s) for k, (values, _) in cases.items() for t, s in enumerate(values)]
    got = events.score_increments(spark.createDataFrame(rows, "video_id long, take_id long, t double, score int")).collect()
    assert sorted((r.take_id, r.t_before, r.t_after) for r in got) == [(k, float(a), float(b)) for k, (_, hits) in cases.items() for a, b in hits]


def test_votes(spark):
    rows = [(0, "7", 0.8), (0, "7", 0.9), (1, "7", 0.9), (1, "7", 0.9), (1, "9", 0.9), (1, "9", 0.9), (2, "7", 0.9), (2, "7", 0.9), (2, "7", 0.9), (2, "3", 0.9), (3, "5", 0.9), (4, None, 0.1)]
    got = {r.k: (r.jersey_number, r.status) for r in identity.digit_votes(spark.createDataFrame(rows, "k long, digits string, confidence double"), ["k"]).collect()}
    assert got == {0: ("7", "verified"), 1: (None, "unverified"), 2: ("7", "verified"), 3: (None, "unverified")}


def test_stitching(spark):
    at = "struct<x:double,y:double,h:double>"
    kind = f"video_id long, take_id long, track_id long, t_start double, t_end double, mean_conf double, first {at}, last {at}"
    rows = [(0, 0, 1, 0.0, 0.5, 0.8, (100.0, 0.0, 100.0), (105.0, 0.0, 100.0)), (0, 0, 2, 1.0, 2.0, 0.8, (110.0, 0.0, 100.0), (120.0, 0.0, 100.0)), (0, 1, 2, 1.0, 2.0, 0.8, (110.0, 0.0, 100.0), (120.0, 0.0, 100.0))]
    got = {(r.take_id, r.track_id): (r.identity, r.confidence) for r in identity.stitch_identities(spark.createDataFrame(rows, kind)).collect()}
    assert got[0, 1] == got[0, 2] == (1, pytest.approx(0.92 * 0.8))
    assert got[1, 2] == (2, pytest.approx(0.8))


def test_annotation_lines(spark):
    lines = ["# note", "https://x.example", "Min 26:56 player #2 in white takes a touch", "Min 26:58 player #2 in white makes a pass", "Min 27:28 player #2 in white kicks the ball out of bounds", "no time", "", "1:02:03 #4  runs"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").where(~text.skipped(F.col("line"))).select("line", text.annotation(F.col("line")).alias("a"))
    rows = df.collect()
    got = [(r.a.event_type, r.a.t, r.a.jersey_number, r.a.team_colour) for r in rows if r.a]
    assert got == [("touch", 1616.0, 2, "white"), ("pass", 1618.0, 2, "white"), ("out_of_bounds", 1648.0, 2, "white"), ("sprint", 3723.0, 4, "unspecified")]
    assert [r.line for r in rows if not r.a] == ["no time"]


def test_names(spark):
    names = ["clip2 77", "clip1_43", "clip 1 43", "CLIP1 43", "clip1 43x", "clip1"]
    got = {r.path: (r.clip_index, r.target_jersey) for r in records.discover_videos(spark.createDataFrame([(f"/v/{n}.MP4",) for n in [*names, "x.txt"]], "path string")).collect()}
    assert got == {f"/v/{n}.MP4": ((2, 77) if n == "clip2 77" else (None, None)) for n in [*names, "x.txt"]}
    assert [r[0] for r in spark.createDataFrame([("Hello, World!",), ("--",)], "n string").select(text.slug(F.col("n"))).collect()] == ["hello_world", "video"]


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 20.0)], "x1 double, y1 double, x2 double, y2 double")
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    lit = lambda *v: [F.lit(float(x)) for x in v]
    r = df.select(g.area().alias("a"), g.cx().alias("cx"), g.point_to_box(*lit(13, 24)).alias("d"), g.in_polygon(*lit(2, 2), square).alias("i"), g.in_polygon(*lit(5, 2), square).alias("o"), g.crossing(*lit(0, 0, 2, 2, 0, 2, 2, 0)).alias("x"), g.crossing(*lit(0, 0, 2, 0, 0, 1, 2, 1)).alias("p")).first()
    assert (r.a, r.cx, r.d, r.i, r.o, tuple(r.x), r.p) == (200.0, 5.0, 5.0, True, False, (1.0, 1.0), None)


def test_clips(spark):
    rows = [(0, 1, k + 1, s, e) for k, (s, e) in enumerate([(0.0, 10.0), (1.0, 10.0), (9.0, 19.0)])]
    df = spark.createDataFrame(rows, "video_id long, player_track_id long, rank int, clip_start double, clip_end double")
    kept = stats.dedupe_clips(df)
    assert sorted(r["rank"] for r in kept.collect()) == [1, 3]
    assert [r["rank"] for r in stats.select_export(kept, budget=15.0).collect()] == [1]


def test_profile(spark):
    df = spark.createDataFrame([(5, 4.0, 9.0), (0, 0.0, 1.0), (0, 0.0, 7.0), (1, 1.0, 3.75)], "n_cuts int, cuts_per_min double, motion_score double").withColumns({"width": F.lit(600), "height": F.lit(700)})
    profile, quality, notes = filters.source_profile()
    got = df.select(profile.alias("p"), quality.alias("q"), F.size(notes).alias("n")).collect()
    assert [(r.p, r.n) for r in got] == [("broadcast", 0), ("single-static", 0), ("single-panning", 0), ("single-static", 2)]
    assert {r.q for r in got} == {"low_res"}


def test_sprint_maths(spark):
    fast = [box(0, 0, 1, i / 25, 100.0 + 6 * i) for i in range(60)]
    slow = [box(0, 0, 2, i / 25, 100.0 + 2 * i) for i in range(60)]
    got = events.detect_sprints(spark.createDataFrame(fast + slow, BOX), 25.0).collect()
    assert [r.player_track_id for r in got] == [1]
    assert math.isclose(got[0].peak_speed, 1.5, abs_tol=1e-6)


def test_empty_tables(spark):
    boxes, balls = spark.createDataFrame([], BOX), spark.createDataFrame([], BALL)
    assert events.detect_sprints(boxes, 25.0).count() == 0
    assert possession.possession_runs(possession.possession_series(balls, boxes)).count() == 0
    assert events.detect_shots(balls, 1280.0).count() == 0


def test_goals_and_assists(spark):
    goals_df = spark.createDataFrame([(0, 0, 20.0, 0.75), (0, 1, 20.0, 0.75)], "video_id long, take_id long, t_after double, confidence double")
    runs = spark.createDataFrame([(0, 0, 1, 13.0, 15.0, [1]), (0, 0, 2, 16.0, 17.0, [2]), (0, 0, 3, 17.5, 19.0, [3, 4]), (0, 0, 5, 1.0, 11.0, [5])], "video_id long, take_id long, player_track_id long, t_start double, t_end double, raw_track_ids array<long>")
    tracks = spark.createDataFrame([(0, 0, i, i % 2, 0.9) for i in range(1, 6)], "video_id long, take_id long, track_id long, team int, team_confidence double")
    got = {r.take_id: r for r in goals.attribute_goals(goals_df, runs, tracks).collect()}
    assert (got[0].team, got[0].scorer, got[0].confidence) == (0, 3, pytest.approx(0.6))  # run 3 counts for track 4's team
    assert (got[1].team, got[1].scorer, got[1].confidence) == (None, None, pytest.approx(0.375))
    passes = spark.createDataFrame([(0, 0, "pass", 5, 3, 16.0, 17.0, 0.35), (0, 0, "pass", 1, 3, 3.0, 4.0, 0.35)], "video_id long, take_id long, type string, passer long, receiver long, t_start double, t_end double, confidence double")
    (a,) = goals.detect_assists(goals.attribute_goals(goals_df, runs, tracks), passes, tracks).collect()
    assert (a.player_track_id, a.scorer, a.confidence) == (5, 3, pytest.approx(0.21))


def test_suppressed_boxes(spark):
    rows = [(0, 0, "player", 0.9, 0.0, 0.0, 10.0, 10.0), (0, 0, "player", 0.8, 1.0, 0.0, 11.0, 10.0), (0, 0, "ball", 0.1, 0.0, 0.0, 10.0, 10.0), (0, 0, "player", 0.5, 9.0, 0.0, 19.0, 10.0)]
    df = spark.createDataFrame(rows, "video_id long, frame_index long, cls string, conf double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.conf for r in filters.suppress_overlaps(df).collect()) == [0.1, 0.5, 0.9]
    assert sorted(r.conf for r in filters.suppress_overlaps(df, by_class=False).collect()) == [0.5, 0.9]
