"""Time joins, eligibility, typed events, the whole flow and the readers, on small cases."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchflow import config
from pitchflow.functions import geometry as g
from pitchflow.functions import text
from pitchflow.operators import events, filters, flow, identity, manual, possession, series, stats, timejoin
from pitchflow.sources import records

BOX = "video_id long, take_id long, track_id long, frame_index long, t double, x1 double, y1 double, x2 double, y2 double, conf double"
BALL = "video_id long, take_id long, frame_index long, t double, x1 double, y1 double, x2 double, y2 double, conf double"
TRACK = "video_id long, take_id long, track_id long, t_start double, t_end double, team int, team_confidence double, dominant_class string, kit struct<l:double,a:double,b:double>"


def box(track, t, x, take=0):
    return (1, take, track, round(t * 10), t, x - 20.0, 100.0, x + 20.0, 200.0, 0.8)


def ball(t, x, y=190.0, take=0):
    return (1, take, round(t * 10), t, x - 5.0, y - 5.0, x + 5.0, y + 5.0, 0.9)


def test_nearest_in_time_by_track_against_brute_force(spark):
    rng = random.Random(2)
    left = [(v, rng.randrange(2), k, round(rng.uniform(-40, 40), 2)) for v in (1, 2) for k in range(60)]
    right = [(v, rng.randrange(2), rng.randrange(3), round(rng.uniform(-40, 40), 2)) for v in (1, 2) for _ in range(400)]
    a = spark.createDataFrame(left + left[:3], "video_id long, take_id long, i long, t double")
    b = spark.createDataFrame(right, "video_id long, take_id long, track_id long, t double")
    for tie in ("later", "earlier"):
        want = {}
        for v, k, i, t in left:
            for tr in range(3):
                near = [(round(abs(x - t), 9), -x if tie == "later" else x) for w, j, r, x in right if (w, j, r) == (v, k, tr) and round(abs(x - t), 9) <= 0.3]
                if near:
                    want[v, k, i, tr] = abs(min(near)[1])
        got = timejoin.nearest_in_time(a, b, 0.3, by=("track_id",), tie=tie).collect()
        assert {(r.video_id, r.take_id, r.i, r.near.track_id): abs(r.near.t) for r in got} == want
        assert len(got) == len(want) + sum((v, k, i, tr) in want for v, k, i, _ in left[:3] for tr in range(3))
    kept = timejoin.nearest_in_time(a, b.where("track_id = 9"), 0.3, by=("track_id",), keep=True)
    assert kept.count() == len(left) + 3 and kept.where("near is not null").count() == 0


def test_referee_cannot_have_the_ball(spark):
    boxes = spark.createDataFrame([box(tr, t / 10, x) for t in range(20) for tr, x in ((1, 100.0), (2, 140.0))], BOX)
    balls = spark.createDataFrame([ball(t / 10, 100.0) for t in range(20)], BALL)
    tracks = spark.createDataFrame([(1, 0, k, 0.0, 2.0, 0, 0.9, c, None) for k, c in ((1, "referee"), (2, "player"))], TRACK)
    assert {r.track_id for r in possession.possession_series(balls, boxes).collect()} == {1}
    assert {r.track_id for r in possession.possession_series(balls, boxes, tracks=tracks).collect()} == {2}
    assert {r.track_id for r in filters.eligible(tracks, "contest").collect()} == {2}


def test_identity_confidence_lowers_possession_and_passes(spark):
    boxes = spark.createDataFrame([box(tr, t / 10, x) for t in range(30) for tr, x in ((1, 100.0), (2, 400.0))], BOX)
    balls = spark.createDataFrame([ball(t / 10, 100.0 if t < 12 else 400.0) for t in range(30) if t < 12 or t > 16], BALL)
    tracks = spark.createDataFrame([(1, 0, k, 0.0, 3.0, 0, 0.9, "player", None) for k in (1, 2)], TRACK)
    series = possession.possession_series(balls, boxes, tracks=tracks)
    sure, unsure = (spark.createDataFrame([(1, 0, 1, 1, 1.0), (1, 0, 2, 2, c)], "video_id long, take_id long, track_id long, identity long, confidence double") for c in (1.0, 0.5))
    wide = config.POSSESSION | {"max": 1.0}
    runs = [possession.possession_runs(series, i) for i in (sure, unsure)]
    held = [{r.player_track_id: r.confidence for r in possession.detect_possession(x, 10.0, wide).collect()} for x in runs]
    assert held[0][1] == held[1][1] and abs(held[1][2] - held[0][2] / 2) < 1e-9
    wide = config.PASS | {"max": 1.0}
    given = [possession.detect_passes(x, tracks, fps=10.0, params=wide).first() for x in runs]
    assert all(r.type == "pass" and (r.passer_track, r.receiver_track) == (1, 2) for r in given)
    assert given[1].confidence < given[0].confidence
    foes = tracks.withColumn("team", F.col("track_id").cast("int"))
    kinds = [possession.detect_passes(runs[0], foes, fps=10.0, params=config.PASS | p).first() for p in ({}, {"turnovers": False}, {"same_colour_required": False})]
    assert [(r.type, r.reject) for r in kinds] == [("turnover", None), (None, "turnover_disabled"), ("pass", None)]


def test_kit_colour_decides_before_the_cluster(spark):
    kits = [((0.0, 5.0, 0.0), (0.0, 5.0, 1.0), True), ((0.0, 0.0, 0.0), (0.0, 30.0, 0.0), False), ((0.0, 0.0, 0.0), (0.0, 15.0, 0.0), None), (None, (0.0, 0.0, 0.0), None)]
    kind = "struct<kit:struct<l:double,a:double,b:double>,team:int,team_confidence:double>"
    rows = [((a, x, 0.9), (b, y, 0.9), want) for a, b, want in kits for x, y in ((0, 1), (1, 1))]
    out = spark.createDataFrame(rows, f"a {kind}, b {kind}, want boolean").select(possession.teammates("a", "b").alias("got"), "want", (F.col("a.team") == F.col("b.team")).alias("cluster")).collect()
    assert all(r.got == (r.cluster if r.want is None else r.want) for r in out)


def test_phrases(spark):
    cases = {
        "takes a touch and passes": "touch", "passes out of bounds": "out_of_bounds", "kicks it out of play": "out_of_bounds", "makes a pass": "pass", "shoots": "shot", "scores": "goal",
        "assists": "assist", "runs": "sprint", "celebrates": "key_moment", "waves": "key_moment", "wins a TACKLE": "tackle", "dribbles": "dribble", "saves": "save",
    }
    rows = spark.createDataFrame(list(cases.items()), "p string, want string").select(text.event_type(F.col("p")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_typed_touches(spark):
    times = spark.createDataFrame([(1, "0:12, 1:05\nsoon,,"), (2, None)], "video_id long, typed string").select("video_id", F.inline(text.touch_times(F.col("typed"))))
    assert [tuple(r) for r in times.collect()] == [(1, 12.0, None), (1, 65.0, None), (1, None, "soon")]
    typed = manual.manual_touches(times)
    assert [(r.type, r.t_start, r.t_end, r.confidence) for r in typed.collect()] == [("touch", 12.0, 13.0, 0.95), ("touch", 65.0, 66.0, 0.95)]
    auto = spark.createDataFrame([(1, "touch", t) for t in (11.0, 13.0, 13.1, 40.0)] + [(1, "pass", 12.0), (2, "touch", 12.0)], "video_id long, type string, t_start double")
    out = manual.merge_touches(auto, typed).collect()
    assert sorted((r.video_id, r.type, r.t_start) for r in out if r.suppressed) == [(1, "touch", 11.0), (1, "touch", 13.0)]
    assert len(out) == 8


def test_target_identity_and_chains(spark):
    kind = "video_id long, take_id long, track_id long"
    ids = spark.createDataFrame([(1, 0, 10, 100), (1, 0, 11, 100), (1, 0, 12, 200), (1, 1, 1, 5), (1, 1, 2, 6)], f"{kind}, identity long")
    targets = spark.createDataFrame([(1, 0, 10), (1, 0, 11), (1, 0, 12), (1, 0, 99), (1, 1, 2), (1, 1, 1), (1, 2, 7)], kind)
    assert {(r.take_id, r.identity) for r in manual.target_identity(ids, targets).collect()} == {(0, 100), (1, 5)}
    tracks = spark.createDataFrame([(1, 0, 3, 5.0), (1, 0, 4, 1.0)], f"{kind}, t_start double")
    chains = spark.createDataFrame([(1, 0, 3), (1, 0, 4), (1, 0, 3), (1, 0, 77)], kind)
    assert [r.track_id for r in manual.union_chains(chains, tracks).orderBy("place").collect()] == [4, 3, 77]


def test_crops_and_bands(spark):
    row = spark.createDataFrame([(10.0, 20.0, 50.0, 120.0)], "x1 double, y1 double, x2 double, y2 double")
    out = row.select(g.native_crop(2.0, 2.0, 0.5, 100, 200).alias("c"), g.band(0.2, 0.6, 0.25, 0.25).alias("torso"), g.band(0.5, 0.5, 0.6, 0.6).alias("none"), g.warped(F.lit(0.0), F.lit(-1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("turned")).first()
    assert tuple(out.c) == (0, 0, 100, 200) and tuple(out.torso) == (20.0, 40.0, 40.0, 80.0) and tuple(out.none) == (10.0, 20.0, 50.0, 120.0)
    assert tuple(out.turned) == (-120.0, 10.0, -20.0, 50.0)
    low = row.select(g.native_crop(1.0, 0.1, 0.0, 100, 1080).alias("c")).select(g.large_enough(F.col("c"), 1080).alias("ok"))
    assert not low.first().ok


def test_whole_flow_on_one_pass(spark):
    boxes = spark.createDataFrame([box(tr, t / 10, x) for t in range(30) for tr, x in ((1, 100.0), (2, 400.0))], BOX)
    balls = spark.createDataFrame([ball(t / 10, 100.0 if t < 12 else 400.0) for t in range(30) if t < 12 or t > 16], BALL)
    tracks = spark.createDataFrame([(1, 0, k, 0.0, 3.0, 0, 0.9, "player", None) for k in (1, 2)], TRACK)
    out = flow.take_events(balls, boxes, tracks, None, 1920.0, 10.0)
    found = {(r.type, r.player_track_id, tuple(r.acting_ids or ())) for r in out.collect()}
    assert {("possession", 1, (1,)), ("possession", 2, (2,)), ("pass", 1, (1,))} <= found
    wanted = spark.createDataFrame([(1, 0, 1)], "video_id long, take_id long, track_id long")
    assert {r.type for r in stats.attribute(out, wanted).collect()} >= {"possession", "pass"}
    assert events.basic_events(boxes, balls, 1920.0, 10.0).where("type not in ('sprint', 'shot')").count() == 0
    none = flow.take_events(balls.where("false"), boxes.where("false"), tracks, None, 1920.0)
    assert none.count() == 0


def test_reports(spark):
    rows = [(1, 0, True, True, True, "ocr"), (1, 0, True, False, True, "vlm"), (1, 0, False, True, True, "ocr")]
    got = stats.read_counters(spark.createDataFrame(rows, "video_id long, take_id long, usable boolean, legible boolean, confident boolean, source string")).first()
    assert (got.n_too_small, got.n_considered, got.n_legible, got.n_ocr, got.n_vlm, got.n_parseq) == (1, 2, 1, 1, 1, 0)
    ids = spark.createDataFrame([(1, 5, "pass", 0.5, "b"), (1, 5, "pass", 0.7, "a")], "video_id long, player_track_id long, type string, confidence double, event_id string")
    assert stats.player_stats(ids).first().event_ids == ["a", "b"]
    gone = spark.createDataFrame([("player",), ("dog",), ("dog",), (None,)], "cls string")
    assert {(r.cls, r.n) for r in filters.dropped_classes(gone).collect()} == {("dog", 2), (None, 1)}
    assert identity.tracks_per_take(spark.createDataFrame([(1, 0), (1, 0)], "video_id long, take_id long")).first().n_tracks == 2


def test_metadata_texts(spark):
    rows = [("30/1", "25/1", "10", None, "N/A"), ("", "25/1", None, "4", None), ("30/0", None, "N/A", "7", "12"), (None, None, None, None, None)]
    out = spark.createDataFrame(rows, "a string, d string, s string, f string, n string").select(text.probed(*[F.col(c) for c in "adsfn"]).alias("p")).collect()
    assert [tuple(r.p) for r in out] == [(30.0, 10.0, 300), (25.0, 4.0, 100), (0.0, 0.0, 12), (0.0, 0.0, None)]


def test_readers_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, (1.0, 2.0, 3.0, 4.0)), (1, float("nan"), (0.0, 0.0, 1.0, 1.0))], "video_id long, jersey double, bbox struct<x1:double,y1:double,x2:double,y2:double>")
    records.write_records(rows, f"{tmp_path}/r")
    schema = T.StructType([T.StructField("jersey", T.IntegerType())])
    back = records.read_records(spark, f"{tmp_path}/r", schema)
    assert sorted(((r.jersey, r.x2) for r in back.collect()), key=str) == [(2, 3.0), (None, 1.0)] and "bbox" not in back.columns
    records.write_json(rows.select("video_id"), f"{tmp_path}/j")
    assert records.read_json(spark, f"{tmp_path}/j", T.StructType([T.StructField("video_id", T.LongType())])).count() == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "clip2 77.txt").write_text("# note\r\n\n1:02 player #7 shoots\n")
    lines = records.read_sidecars(spark, f"{tmp_path}/s").orderBy("line_no").collect()
    assert [r.line for r in lines] == ["# note", "", "1:02 player #7 shoots"] and lines[0].line_no == 1 and lines[0].video_id == "clip2 77"


def test_long_sidecars_and_nested_records(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name, n in (("a", 30_000), ("b", 7)):
        (tmp_path / "s" / f"{name}.txt").write_text("\n".join(f"{name} {k}" for k in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a file larger than a task's share
    try:
        lines = records.read_sidecars(spark, f"{tmp_path}/s")
        assert spark.read.text(f"{tmp_path}/s").rdd.getNumPartitions() > 1 and lines.count() == 30_007
        assert lines.where("line <> concat(video_id, ' ', line_no)").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    kind = f"video_id long, take_id double, id long, team double, boxes array<struct<frame_index:double,t:double,bbox:{box},conf:double>>"
    nan = float("nan")
    rows = [(1, 0.0, 7, nan, [(3.0, 0.12, (1.0, 2.0, 3.0, 4.0), 0.5), (nan, 0.16, (1.0, 2.0, 3.0, 4.0), 0.5)]), (1, 0.0, 8, 1.0, [])]
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/t")
    wanted = spark.createDataFrame([], f"video_id long, take_id long, team int, boxes array<struct<frame_index:int,t:double,bbox:{box},conf:double,extra:string>>").schema
    back = records.read_records(spark, f"{tmp_path}/t", wanted)
    assert {r.id: (r.team, r.take_id) for r in back.collect()} == {7: (None, 0), 8: (1, 0)}
    assert dict(back.dtypes)["boxes"].startswith("array<struct<frame_index:int")
    assert [tuple(r) for r in records.track_boxes(back).orderBy("t").collect()] == [(1, 0, 7, 3, 0.12, 1.0, 2.0, 3.0, 4.0, 0.5), (1, 0, 7, None, 0.16, 1.0, 2.0, 3.0, 4.0, 0.5)]
    with pytest.raises(ValueError, match="no column other"):
        records.read_records(spark, f"{tmp_path}/t", T.StructType([T.StructField("other", T.LongType())]))


def test_compensated_jump(spark):
    place = "struct<x:double,y:double,h:double,ref_x:double,ref_y:double>"
    rows = [((0.0, 0.0, 100.0, 0.0, 0.0), (300.0, 400.0, 100.0, 30.0, 40.0)), ((0.0, 0.0, 100.0, None, None), (300.0, 400.0, 100.0, 30.0, 40.0)), ((0.0, 0.0, 0.0, 0.0, 0.0), (3.0, 4.0, 0.0, 1.0, 1.0))]
    out = spark.createDataFrame(rows, f"a {place}, b {place}").select(series.compensated_jump("a", "b").alias("j")).collect()
    assert [tuple(r.j) for r in out] == [(0.5, True), (5.0, False), (float("inf"), False)]


def test_ball_states_follow_the_camera(spark):
    balls = spark.createDataFrame([ball(t / 10, 100.0 + 50 * t) for t in range(20)], BALL)
    boxes = spark.createDataFrame([box(1, t / 10, 100.0) for t in range(20)], BOX)
    motion = spark.createDataFrame([(1, 0, t / 10, 1.0, 0.0, 50.0 * t, 0.0, 1.0, 0.0) for t in range(20)], "video_id long, take_id long, t double, a double, b double, tx double, c double, d double, ty double")
    still = series.ball_states(balls, boxes, motion=motion).collect()
    assert all(abs(r.vx) < 1e-9 for r in still)
    assert max(r.vx for r in series.ball_states(balls, boxes).collect()) > 1


def test_confirmed_numbers(spark):
    reads = spark.createDataFrame([(1, "7", 0.2), (1, "9", 0.9), (1, "9", 0.9), (2, "5", 0.9)], "take_id long, digits string, confidence double")
    said = spark.createDataFrame([(1, 7), (2, 8), (3, 4)], "take_id long, number long")
    out = {r.take_id: (r.jersey_number, r.status, r.confidence, r.note) for r in identity.confirmed_votes(identity.digit_votes(reads, ("take_id",)), reads, said, ("take_id",)).collect()}
    assert out == {1: ("7", "verified", 0.3, "contradicted"), 2: (None, "unverified", 0.0, "no_reads"), 3: (None, "unverified", 0.0, "no_reads")}
