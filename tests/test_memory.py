import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from pitchflow import config
from pitchflow.functions import text
from pitchflow.operators import identity, memory, series, stats
from pitchflow.sources import records

LAB = "struct<l:double,a:double,b:double>"
KIT = f"kit struct<torso:{LAB},shorts:{LAB},socks:{LAB}>"
AT = "struct<x:double,y:double,h:double>"
HEAD = f"video_id long, take_id long, track_id long, dominant_class string, team int, team_confidence double, t_start double, t_end double, first {AT}, last {AT}, {KIT}, jersey string, height double"
PROFILE = f"video_id long, take_id long, track_id long, {KIT}, jersey string, height double"


def colour(l):
    return None if l is None else (float(l), 0.0, 0.0)


def head(take, track, start, end, x=100.0, torso=50.0, jersey=None, height=100.0, cls="player", video=0, team=None):
    return (video, take, track, cls, team, 0.9, start, end, (x, 0.0, 100.0), (x, 0.0, 100.0), (colour(torso), None, None), jersey, height)


def brute(takes, tracks, own, seeds):
    """The same rules, one loop after another."""
    p, k, st = config.TARGET, config.KIT, config.STITCH
    bank, last, out = [own[3][0][0] if own[3][0] else None], None, {}

    def follower(a, pool):
        best = None
        for b in pool:
            gap = b[6] - a[7]
            if not 0 < round(gap, 9) < st["gap"]:
                continue
            jump = abs(b[8][0] - a[9][0]) / 100
            if jump < st["jump"] and jump / gap < st["speed"]:
                rank = (round(jump, 9), not (a[4] is not None and a[4] == b[4]), b[2])
                best = min(best or (rank, b), (rank, b), key=lambda r: r[0])
        return best and best[1]

    for take in takes:
        pool = sorted([t for t in tracks if t[1] == take], key=lambda t: (t[6], t[2]))
        known = [v for v in bank if v is not None]
        mine = median(known) if known else None

        def verdict(t, mine=mine, last=last):
            kit = None
            if mine is not None and t[10][0] is not None:
                d = abs(mine - t[10][0][0])
                kit = True if d <= k["same"] else False if d >= k["different"] else None
            number = None if own[4] is None or t[11] is None else own[4] == t[11]
            ratio = min(own[5], t[12]) / max(own[5], t[12])
            if kit is False or number is False:
                return 0.0, False, True
            parts = [(0.4, 1.0 if kit else None), (0.3, 1.0 if number else None), (0.15, ratio), (0.15, None if last is None else max(0, 1 - abs(last - t[8][0]) / 100 / 6))]
            parts = [(w, v) for w, v in parts if v is not None]
            score = round(sum(w * v for w, v in parts) / sum(w for w, _ in parts), 9)
            return (score, score >= p["strong"], False) if ratio >= p["height"] else (0.0, False, False)

        asked = [i for tk, i in seeds if tk == take]
        marks = {t[2]: ((1.0, True, False) if asked and (take, t[2]) == (own[1], own[2]) else verdict(t)) for t in pool}
        if asked:
            accepted = [i for i in asked if i in marks and marks[i][1]]
            heads, conf = accepted, sum(marks[i][0] for i in accepted) / len(accepted) if accepted else 0.0
        else:
            accepted = [t[2] for t in pool if marks[t[2]][1] and t[3] != "referee" and round(t[7] - t[6], 9) >= 0.5]
            top = max([round(marks[i][0], 4) for i in accepted], default=0.0)
            heads = [i for i in accepted if round(marks[i][0], 4) == top]
            heads, conf = (heads, top) if len(heads) == 1 else ([], 0.0)
        by_id, chain = {t[2]: t for t in pool}, set()
        for i in heads:
            at = by_id[i]
            while at is not None and at[2] not in chain:
                chain.add(at[2])
                at = follower(at, pool)
        ids = [t[2] for t in pool if t[2] in chain]
        sure = [t[2] for t in pool if heads and (t[2] in accepted or (t[2] in chain and not verdict(t)[2]))]
        out[take] = (("manual_override" if asked else "target_reidentified") if heads else "target_lost", heads[0] if heads else None, ids, sure, round(conf, 6))
        last = max((by_id[i] for i in ids), key=lambda t: t[7])[9][0] if heads else None
        if heads and conf >= p["learn"] and by_id[heads[0]][10][0] is not None:
            bank = [*bank, by_id[heads[0]][10][0][0]][-p["bank"] :]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_target_over_takes_matches_brute_force(spark, seed):
    draw, tracks, wants, own, seeds = random.Random(seed), [], {}, [], []
    for video in range(12):
        rows = []
        for take in range(6):
            for track in range(draw.randint(0, 7)):
                start = round(draw.uniform(0, 4), 2)
                rows.append(head(take, track, start, round(start + draw.uniform(0.2, 2), 2), float(draw.randint(0, 500)), draw.choice([None, 50.0, 54.0, 58.0, 62.0, 90.0]), draw.choice([None, "7", "7", "9"]), float(draw.choice([50, 95, 100])), draw.choice(["player"] * 5 + ["referee"]), video, draw.choice([0, 1, None])))
        profile = (video, 0, 1, (colour(draw.choice([50, 52, None])), None, None), draw.choice(["7", None]), 100.0)
        asked = [(0, 1), (0, 3)] + ([(3, 0), (3, 99)] if video % 2 else [])
        wants[video] = brute(range(6), rows, profile, asked)
        tracks += rows
        own.append(profile)
        seeds += [(video, k, i, n) for n, (k, i) in enumerate(asked)]
    takes = spark.createDataFrame([(v, k) for v in range(12) for k in range(6)], "video_id long, take_id long")
    got = memory.resolve_target(takes, spark.createDataFrame(tracks, HEAD), spark.createDataFrame(own, PROFILE), spark.createDataFrame(seeds, "video_id long, take_id long, track_id long, place long")).collect()
    have = {(r.video_id, r.take_id): (r.method, r.seed_track_id, r.track_ids, r.verified_ids, round(r.confidence, 6)) for r in got}
    assert have == {(v, k): want for v, by in wants.items() for k, want in by.items()}
    assert {r.method for r in got} == {"manual_override", "target_reidentified", "target_lost"}


def test_target_without_rows(spark):
    none = spark.createDataFrame([], HEAD)
    own = spark.createDataFrame([(0, 0, 1, (colour(50), None, None), "7", 100.0)], PROFILE)
    seeds = spark.createDataFrame([], "video_id long, take_id long, track_id long, place long")
    takes = spark.createDataFrame([(0, 0), (1, 0)], "video_id long, take_id long")
    got = memory.resolve_target(takes, none, own, seeds).collect()
    assert [(r.video_id, r.method, r.track_ids) for r in got] == [(0, "target_lost", [])]  # a video without a profile has no row
    assert memory.resolve_target(takes.limit(0), none, own, seeds).count() == 0


ASKED = "video_id long, take_id long, jersey_number long, t double"
CAND = ASKED + ", track_id long, identity long, colour_dist double, arrow_dist double, agreement double, source string"


def test_locks(spark):
    asked = [(0, 0, 10, t) for t in (1.0, 2.0, 3.0, 4.0)] + [(0, 0, 4, 1.5), (0, 0, 4, 1.5), (0, 1, 10, 9.0)]
    cand = [
        (0, 0, 10, 1.0, 1, 1, 3.0, None, None, None), (0, 0, 10, 1.0, 2, 2, 5.0, None, None, None),
        (0, 0, 10, 2.0, 2, 2, 1.0, None, None, None), (0, 0, 10, 2.0, 3, 1, 6.0, None, None, None),
        (0, 0, 10, 3.0, 2, 2, 1.0, None, None, None),
        (0, 0, 10, 4.0, 2, 2, 1.0, None, 0.9, "ocr"), (0, 0, 10, 4.0, 5, 5, 1.0, None, 0.6, "ocr"),
        (0, 0, 4, 1.5, 6, 6, 20.0, 12.0, None, None),
    ]
    run = lambda **kw: {(r.take_id, r.jersey_number, r.t): (r.track_id, r.signal, r.locked) for r in memory.lock_annotations(spark.createDataFrame(asked, ASKED), spark.createDataFrame(cand, CAND), **kw).collect()}
    got = run()
    assert got == {
        (0, 10, 1.0): (1, "colour", 1), (0, 10, 2.0): (3, "locked_chain", 1), (0, 10, 3.0): (None, "locked_identity_absent_at_instant", 1),
        (0, 10, 4.0): (2, "jersey_ocr_reacquired", 1), (0, 4, 1.5): (6, "colour", 6), (1, 10, 9.0): (None, "none", None),
    }
    assert {k for k, v in run(confirmed=True).items() if v[0] is not None} == {(0, 10, 4.0)}
    locked = memory.lock_annotations(spark.createDataFrame(asked, ASKED), spark.createDataFrame(cand, CAND))
    (take,) = memory.annotated_takes(locked).collect()  # the other take has no track
    assert (take.take_id, take.jersey_number, take.confirmed) == (0, 4, True)
    assert [(t.track_id, t.jersey_number, len(t.windows)) for t in take.tracks] == [(1, 10, 1), (2, 10, 1), (3, 10, 1), (6, 4, 1)]
    times = spark.createDataFrame([(1.0,), (7.0,)], "t double").select(memory.active_at(F.col("t"), F.array(F.struct(F.lit(0.0).alias("t_start"), F.lit(2.0).alias("t_end")))), memory.active_at(F.col("t"), F.lit(None).cast("array<struct<t_start:double,t_end:double>>"))).collect()
    assert [tuple(r) for r in times] == [(True, True), (False, True)]


def test_stitching_prefers_the_same_team_among_equals(spark):
    kind = f"video_id long, take_id long, track_id long, team int, team_confidence double, mean_conf double, t_start double, t_end double, first {AT}, last {AT}"
    rows = [(0, 0, i, team, 0.9, 0.8, s, s + 1, (x, 0.0, 100.0), (x, 0.0, 100.0)) for i, team, s, x in ((1, 1, 0.0, 100.0), (2, 0, 1.5, 110.0), (3, 1, 1.6, 90.0))]
    got = {r.track_id: r.identity for r in identity.stitch_identities(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: 1, 3: 1, 2: 2}
    assert {r.track_id: r.next_id for r in memory.successors(spark.createDataFrame(rows, kind)).collect()} == {1: 3, 2: None, 3: None}


def test_teams_by_embedding(spark):
    rows = [(0, 0, i, 10 * i + k, [10.0 if (i + (k == 0)) % 2 else 0.1, 1.0 + k / 100]) for i in range(4) for k in range(5)]
    rows += [(0, 0, 8, 99, None), (0, 1, 1, 1, [1.0, 0.0]), (0, 2, 1, 1, [0.0, 0.0]), (0, 2, 2, 2, [0.0, 0.0])]
    got = {(r.take_id, r.track_id): (r.team, round(r.team_confidence, 6)) for r in identity.teams_by_embedding(spark.createDataFrame(rows, "video_id long, take_id long, track_id long, crop long, vector array<double>")).collect()}
    assert got == {(0, 0): (0, 0.8), (0, 1): (1, 0.8), (0, 2): (0, 0.8), (0, 3): (1, 0.8), (0, 8): (None, 0.0), (1, 1): (None, 0.0), (2, 1): (0, 1.0), (2, 2): (0, 1.0)}


def test_player_tree(spark, tmp_path):
    cards = spark.createDataFrame([(0, "player_7", "a"), (0, "target_001", "b")], "video_id long, player string, card string")
    lines = spark.createDataFrame([(0, "player_7", 5.0, "Pass"), (0, "player_7", 1.0, "Shot")], "video_id long, player string, t_start double, label string")
    clips = spark.createDataFrame([(0, "player_7", "passes", 1)], "video_id long, player string, category string, rank int")
    records.write_player_tree(cards, lines, clips, str(tmp_path / "out"))
    records.write_player_tree(cards.where("player = 'target_001'").withColumn("card", F.lit("c")), lines.limit(0), clips.limit(0), str(tmp_path / "out"))  # other players stay
    back = spark.read.parquet(str(tmp_path / "out" / "cards")).collect()
    assert sorted((r.player, r.card) for r in back) == [("player_7", "a"), ("target_001", "c")]
    assert [r.t_start for r in spark.read.parquet(str(tmp_path / "out" / "timeline")).collect()] == [1.0, 5.0]


def test_small_rules(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    n = lambda v, kind="int": F.lit(v).cast(kind)
    assert get(text.player_key(n(7), n("T_1", "string"))) == "player_7" and get(text.player_key(n(None), n("T_1", "string"))) == "t_1" and get(text.player_key(n(None), n(None, "string"))) == "player_unknown"
    assert tuple(get(text.touch_player(n(None), F.array(n(9), n(9), n(None))))) == (9, "single_jersey_inferred")
    assert tuple(get(text.touch_player(n(None), F.array(n(9), n(8))))) == (None, "ambiguous_not_attached") and tuple(get(text.touch_player(n(3), F.array(n(9))))) == (3, "typed")
    tier = lambda m, s: get(memory.render_tier(n(m, "string"), n(s, "string")))
    assert [tier("arrow_vote", "verified"), tier("manual_override", "verified"), tier("target_lost", "unverified"), tier("none", "unverified"), tier(None, None)] == ["amber", "red", "lost", "none", "none"]
    take = (F.lit(0.0), F.lit(10.0))
    assert get(series.sample_times(F.lit(2.0), F.lit(4.0), F.lit(3.0), take, 0.5, 2)) == [2.5, 3.5]
    assert get(series.sample_times(F.lit(2.0), F.lit(8.0), F.lit(3.0), take, 0.5, 2, 2.0)) == [2.5, 3.5] and get(series.sample_times(F.lit(2.0), F.lit(4.0), F.lit(3.0), take, 0.5, 1)) == [3.0]
    assert len(get(series.anchor_times(F.lit(0.0), F.lit(100.0), F.lit(5.0)))) == 10 and len(get(series.anchor_times(F.lit(0.0), F.lit(100.0), F.lit(1.0)))) == 4


def test_cards_are_read_back(spark):
    rows = F.array(F.struct(F.lit(65.25).alias("t_start"), F.lit("Pass").alias("label"), F.lit(0.5).alias("confidence")))
    counts = {"passes": F.lit(1), "sprints": F.lit(4), "goals": F.lit(0)}
    card = text.stat_card_text(F.lit(7), counts, F.lit(3.04), F.lit(None).cast("double"), rows, F.lit("not available (x)"), F.lit("Verified"))
    got = spark.range(1).select(text.stat_card(card).alias("c")).first().c
    assert (got.passes, got.sprints, got.goals, got.possession_time, got.distance_covered) == (1, 4, 0, "3.0s", "uncertain")
    assert [tuple(e) for e in got.events] == [("1:05.2", "Pass", 0.5)]


def test_event_table_and_report(spark):
    events = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.0), (0, "c", 2.0)], "video_id long, event_id string, t_start double")
    clips = spark.createDataFrame([(0, "c", 9.0, 1.0, 2.0)], "video_id long, event_id string, rank_score double, clip_start double, clip_end double")
    assert [r.event_id for r in stats.event_table(events, clips).orderBy("place").collect()] == ["c", "b", "a"]
    lines = spark.createDataFrame([(0, True, False, None), (0, False, True, 1), (0, False, True, None), (0, False, False, None)], "video_id long, skipped boolean, parsed boolean, take_id long")
    assert tuple(stats.annotation_report(lines).first()) == (0, 2, 1, 1)


def test_a_whole_tolerance_apart_is_near(spark):
    from pitchflow.operators import timejoin

    left = spark.createDataFrame([(0, 0, k / 25 - 0.2) for k in range(0, 3000, 5)], "video_id long, take_id long, t double")
    right = spark.createDataFrame([(0, 0, k / 25) for k in range(0, 3000, 5)], "video_id long, take_id long, t double").where("t > 0")
    assert timejoin.nearest_in_time(left, right, 0.2).count() == 599
    events = right.selectExpr("video_id", "t as t_start")
    assert timejoin.drop_near(events, left.selectExpr("video_id", "round(t, 9) as t"), 0.21).count() == 0
