"""Tables dealt by take move no box again, and joins of settled tables send none to every task."""

import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchflow.functions import geometry
from pitchflow.operators import events, flow, manual, possession, series, timejoin
from pitchflow.plans import adapters

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark):
    boxes = spark.range(400).selectExpr("id % 2 as video_id", "0L as take_id", "id % 3 as track_id", "cast(id as bigint) as frame_index", "id / 25D as t", "id * 3D as x1", "0D as y1", "id * 3D + 40 as x2", "100D as y2")
    balls = spark.range(0, 400, 2).selectExpr("id % 4 div 2 as video_id", "0L as take_id", "id as frame_index", "id / 25D as t", "id * 3D + 50 as x", "50D as y")
    return timejoin.dealt(balls), timejoin.dealt(boxes)


def test_nearest_player_moves_no_box_of_dealt_tables(spark):
    balls, boxes = _tables(spark)
    assert len(re.findall(r"Exchange hashpartitioning", _plan(timejoin.nearest_player(balls, boxes, 0.15)))) == 2


def test_nearest_player_is_the_brute_force_one(spark):
    balls, boxes = _tables(spark)
    got = {(r.video_id, r.frame_index): (r.track_id, None if r.dist is None else round(r.dist, 6)) for r in timejoin.nearest_player(balls, boxes, 0.15).collect()}
    people = boxes.collect()
    for b in balls.collect():
        near = {}
        for p in people:
            off = round(abs(p.t - b.t), 9)
            if p.video_id == b.video_id and off <= 0.15 and (p.track_id not in near or (off, -p.t) < near[p.track_id][:2]):
                near[p.track_id] = (off, -p.t, (max(p.x1 - b.x, b.x - p.x2, 0) ** 2 + max(p.y1 - b.y, b.y - p.y2, 0) ** 2) ** 0.5)
        best = min(((d, i) for i, (_, _, d) in near.items()), default=(None, None))
        assert got[b.video_id, b.frame_index] == (best[1], None if best[0] is None else round(best[0], 6))


def test_motion_is_sent_to_no_task_whole(spark):
    balls, _ = _tables(spark)
    steps = balls.select("video_id", "take_id", "t", *[F.lit(v).alias(c) for c, v in zip(("a", "b", "tx", "c", "d", "ty"), (1.0, 0.0, 1.0, 0.0, 1.0, 1.0), strict=True)])
    assert "BroadcastHashJoin" not in _plan(series.to_reference(balls, series.cumulative_motion(steps)))


def test_tasks_grow_with_the_frames(spark, monkeypatch):
    monkeypatch.setattr(timejoin, "FRAMES", 50, raising=False)
    frames = adapters.frames(spark, SMALL)
    assert frames.rdd.getNumPartitions() == 20
    assert timejoin.dealt(frames.limit(10)).rdd.getNumPartitions() == 20  # as a settled table is, to meet the frames
    monkeypatch.undo()
    assert adapters.frames(spark, SMALL).rdd.getNumPartitions() == 8


def test_tracks_meet_dealt_boxes_in_place(spark):
    balls, boxes, tracks = (make(spark, SMALL) for make in (adapters.balls, adapters.boxes, adapters.tracks))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        for df in (
            possession.possession_series(balls, boxes, tracks=tracks),
            timejoin.nearest_in_time(balls, boxes, 0.15, by=("track_id",)),
            events.sprint_candidates(boxes, 25.0),
        ):
            assert "REPARTITION_BY_NUM" in _plan(df) and "ENSURE_REQUIREMENTS" not in _plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_boxes_of_tracks_are_those_of_a_join(spark):
    boxes = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 1, 3), (None, 0, 1, 4), (0, 0, None, 5), (0, 0, 1, 6)], "video_id long, take_id long, track_id long, n int")
    tracks = spark.createDataFrame([(0, 0, 1, 7), (0, 1, 2, 8), (None, 0, 1, 9), (0, 0, None, 1)], "video_id long, take_id long, track_id long, team int")
    assert sorted(r.n for r in timejoin.of_tracks(boxes, tracks).collect()) == [1, 6]
    assert sorted((r.n, r.team) for r in timejoin.of_tracks(boxes, tracks, "team").collect()) == [(1, 7), (6, 7)]


def test_players_of_balls_are_looked_up_in_place(spark):
    balls, boxes, tracks, known = (make(spark, SMALL) for make in (adapters.balls, adapters.boxes, adapters.tracks, adapters.identities))
    states = series.ball_states(balls, boxes)
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        samples = possession.run_samples(possession.possession_series(balls, boxes, tracks=tracks), known)
        for df in (possession.touch_candidates(balls, boxes, states, tracks=tracks, identities=known), samples, possession.pass_candidates(possession.runs_of(samples), tracks, states)):
            assert "REPARTITION_BY_NUM" in _plan(df) and "ENSURE_REQUIREMENTS" not in _plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_rows_of_unknown_tracks_stay_as_in_a_left_join(spark):
    rows = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 2, 2), (0, 1, 1, 3), (None, 0, 1, 4), (0, 0, None, 5)], "video_id long, take_id long, raw long, n int")
    tracks = spark.createDataFrame([(0, 0, 1, 7), (0, 0, 1, 8), (None, 0, 1, 9), (0, 0, None, 1)], "video_id long, take_id long, track_id long, identity int")
    got = timejoin.of_tracks(rows, tracks, "identity", key="raw", keep=True)
    want = rows.join(tracks.withColumnRenamed("track_id", "raw"), ["video_id", "take_id", "raw"], "left")
    assert sorted(map(str, got.select("n", "identity").collect())) == sorted(map(str, want.select("n", "identity").collect()))


def test_rows_of_one_instant_share_its_contact(spark):
    states = spark.createDataFrame([(0, 0, 0.9, 0.0, 0.0, True), (0, 0, 1.1, 9.0, 0.0, True), (None, 0, 0.9, 0.0, 0.0, True), (None, 0, 1.1, 9.0, 0.0, True)], "video_id long, take_id long, t double, vx double, vy double, known boolean")
    times = spark.createDataFrame([(0, 0, 1.0, "a"), (0, 0, 1.0, "a"), (0, 0, 1.0, None), (0, 0, 3.0, "b"), (0, 1, 1.0, "c"), (None, 0, 1.0, "d"), (0, 0, None, "e")], "video_id long, take_id long, t double, who string")
    got = possession.contact_evidence(times, states, {"window": 0.1, "delta_v": 5.0})
    assert sorted(str((r.who, r.delta_v, r.kicked)) for r in got.collect()) == sorted(str((w, 9.0 if w in ("a", None) else None, w in ("a", None))) for w in ("a", "a", None, "b", "c", "d", "e"))


def test_detectors_share_no_task(spark, monkeypatch):
    balls, boxes = _tables(spark)
    ranked = [df.select("video_id", "take_id", "t", F.row_number().over(Window.partitionBy("video_id", "take_id").orderBy("t", "frame_index")).alias("n")) for df in (balls, boxes)]
    both = lambda of: of(ranked[0]).unionByName(of(ranked[1]))
    apart = both(timejoin.apart)
    assert _plan(apart).count("Coalesce") == 2
    assert sorted(apart.collect()) == sorted(both(lambda df: df).collect())
    seen = []
    monkeypatch.setattr(flow, "settled", lambda df: seen.append(df) or df)
    made = (make(spark, SMALL) for make in (adapters.balls, adapters.boxes, adapters.tracks, adapters.identities))
    flow.candidates(*made, 1280.0, 25.0)
    assert _plan(seen[-1]).count("Coalesce") == 9  # one for each detector's candidates


def test_nearest_boxes_of_odd_tables(spark):
    """Equal, near equal and missing instants, boxes a whole tolerance away, tracks that come and go."""
    rng, odd = random.Random(5), (0.0, 0.0, 1e-12, 0.1 + 0.2 - 0.3, 3e-9)
    rows = [(v, k, rng.randrange(4), round(rng.uniform(-3, 9), 2) + rng.choice(odd), float(rng.randrange(9))) for v in (0, 1) for k in (0, 1) for _ in range(250)]
    rows += rows[:40] + [(None, 0, 1, 1.0, 0.0), (0, None, 1, 1.0, 0.0), (0, 0, None, 1.0, 0.0), (0, 0, 1, None, 0.0)]
    asked = [(v, k, n, round(rng.uniform(-4, 10), 2)) for v in (0, 1, 2) for k in (0, 1) for n in range(90)] + [(None, 0, 1, 1.0), (0, 0, 99, None)]
    boxes = spark.createDataFrame(rows, "video_id long, take_id long, track_id long, t double, x double")
    points = spark.createDataFrame(asked + asked[:5], "video_id long, take_id long, n long, t double")
    want = []
    for v, k, n, t in asked + asked[:5]:
        near = {}
        for w, j, tr, s, x in rows:
            if None not in (v, k, t, w, j, tr, s) and (w, j) == (v, k) and round(abs(s - t) * 1e9) <= 150_000_000:
                near[tr] = min(near.get(tr, (9e9,)), (round(abs(s - t) * 1e9), -s, -x))
        want.append((str(v), k, n, str(t), sorted((tr, -s, -x) for tr, (_, s, x) in near.items())))
    got = [(str(r.video_id), r.take_id, r.n, str(r.t), sorted(map(tuple, r.near))) for r in timejoin.near_boxes(points, boxes, 0.15).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_a_flow_asks_for_the_players_of_balls_once(spark, monkeypatch):
    asked, find = [], possession.nearest_player
    monkeypatch.setattr(possession, "nearest_player", lambda *a: asked.append(a) or find(*a))
    made = [make(spark, SMALL) for make in (adapters.balls, adapters.boxes, adapters.tracks, adapters.identities)]
    flow.candidates(*made, 1280.0, 25.0)
    assert len(asked) == 1
    assert _plan(events.sprint_candidates(made[1], 25.0)).count("Generate explode") == 2  # segments and their samples in one go; tracks with few boxes


def test_nine_digits_are_those_of_round(spark):
    rng = random.Random(3)
    rows = [(x,) for x in [None, 0.0, -0.3, 0.1 + 0.2, 1e-9, 12.5] + [rng.uniform(-50, 50) for _ in range(3000)] + [k / 25 - (k - 3) / 25 for k in range(3000)]]
    df = spark.createDataFrame(rows, "x double")
    assert df.where(~geometry.ninth(F.col("x")).eqNullSafe(F.round("x", 9))).count() == 0


def test_parts_of_the_flow_are_those_of_the_whole(spark):
    made = [make(spark, SMALL) for make in (adapters.balls, adapters.boxes, adapters.tracks, adapters.identities)]
    every = flow.candidates(*made, 1280.0, 25.0).drop("evidence").cache()
    told = lambda df: sorted(map(str, df.drop("evidence", "acting_ids").collect()))
    assert told(flow.take_events(*made, 1280.0, 25.0, manual.TAKEN)) == told(every.where("reject is null").where(F.col("type").isin(*manual.TAKEN)).drop("reject"))
    assert told(flow.take_rejects(*made, 1280.0, 25.0)) == told(flow.rejects_of(every))
    every.unpersist()
