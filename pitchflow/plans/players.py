"""Registered queries about players over a whole take or video: memory, locks, pickers, cards and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import identity, memory, series, stats, timejoin
from . import adapters as ad
from .queries import SQL, TRACKLETS, _detections, _happened, query, rounded

HEIGHT = 720.0


def _pieces(spark, sf_dir):
    """Headers of track pieces of two seconds with kit, number and team."""
    piece = "track_id + 20 * cast(floor(frame_index / 50) as bigint)"
    rows = ad.boxes(spark, sf_dir).withColumn("tracker_id", F.expr(piece)).withColumn("cls", F.expr("if(track_id = 11, 'referee', 'player')")).drop("track_id")
    lab = "named_struct('l', 40D + 6 * (track_id % 5), 'a', 0D, 'b', cast(take_id as double))"
    none = "cast(null as struct<l:double,a:double,b:double>)"
    return identity.assemble_tracks(rows).selectExpr(
        "*", "cast(track_id % 2 as int) as team", "0.8D as team_confidence", f"named_struct('torso', if(track_id % 3 = 0, {none}, {lab}), 'shorts', {lab}, 'socks', {none}) as kit",
        "if(track_id % 4 = 0, null, cast(track_id % 5 as string)) as jersey", "90D + track_id % 20 + track_id / 200D as height",
    )


@query()
def t23_resolve_target(spark, sf_dir):
    pieces = _pieces(spark, sf_dir)
    own = pieces.where("take_id = 0 and track_id % 20 = 2").groupBy("video_id").agg(F.min_by(F.struct("take_id", "track_id", "kit", "jersey", "height"), "track_id").alias("p")).select("video_id", "p.*")
    seeds = pieces.where("take_id in (0, 3) and track_id % 20 = 2 or take_id = 3 and track_id % 20 = 7").selectExpr("video_id", "take_id", "track_id", "track_id as place")
    return rounded(memory.resolve_target(ad.takes(spark, sf_dir), pieces, own, seeds))


@query(TRACKLETS + """, heads as (select video_id, take_id, tid, min(t) as t_start, max(t) as t_end, arg_min((x1 + x2) / 2, frame_index) as fx, arg_min((y1 + y2) / 2, frame_index) as fy, arg_max((x1 + x2) / 2, frame_index) as lx, arg_max((y1 + y2) / 2, frame_index) as ly from dets group by 1, 2, 3),
follow as (select a.video_id, a.take_id, a.tid, b.tid as nid, round(sqrt(pow(b.fx - a.lx, 2) + pow(b.fy - a.ly, 2)) / 100, 9) as jump, round(b.t_start - a.t_end, 9) as gap, a.tid % 2 <> b.tid % 2 as other from heads a join heads b on a.video_id = b.video_id and a.take_id = b.take_id and a.tid <> b.tid and round(b.t_start - a.t_end, 9) > 0 and round(b.t_start - a.t_end, 9) < 1.5),
first_ as (select *, row_number() over (partition by video_id, take_id, tid order by jump, other, nid) as rn from follow where jump < 3 and round(jump / gap, 9) < 2.5)
select h.video_id, h.take_id, h.tid as track_id, f.nid as next_id from heads h left join first_ f on f.rn = 1 and f.video_id = h.video_id and f.take_id = h.take_id and f.tid = h.tid""")  # fmt: skip
def t7_successors(spark, sf_dir):
    heads = identity.assemble_tracks(_detections(spark, sf_dir)).selectExpr("*", "cast(track_id % 2 as int) as team", "0.8D as team_confidence")
    return memory.successors(heads).select("video_id", "take_id", "track_id", "next_id")


ASKED = """, asked as (select video_id, take_id, t, cast(floor(frame_index / 20) as bigint) % 3 as jersey_number from frames where frame_index % 20 = 7),
nb as (select a.video_id, a.take_id, a.jersey_number, a.t, b.track_id, row_number() over (partition by a.video_id, a.take_id, a.t, b.track_id order by round(abs(b.t - a.t), 9), b.t desc) as rn from asked a join boxes b on a.video_id = b.video_id and a.take_id = b.take_id and round(abs(b.t - a.t), 9) <= 0.15),
cand as (select video_id, take_id, jersey_number, t, track_id, track_id // 3 as identity, k, case when (k * 3 + track_id * 5) % 17 < 14 then ((k * 3 + track_id * 5) % 17)::double end as colour_dist,
  case when (k + track_id) % 19 = 0 then ((k + track_id) % 50)::double end as arrow_dist, case when (k * 7 + track_id) % 23 < 2 then 0.5 + 0.1 * ((track_id + k) % 5) end as agreement
  from (select *, cast(round(t * 25) as bigint) as k from nb where rn = 1)),
free as (select video_id, take_id, jersey_number, t, min(case when colour_dist <= 8 then struct_pack(d := colour_dist, i := track_id, c := identity) end) as c, min(case when arrow_dist is not null then struct_pack(d := arrow_dist, i := track_id, c := identity) end) as a,
  list(struct_pack(d := agreement, i := track_id, c := identity) order by agreement desc, track_id) filter (agreement is not null) as r from cand group by 1, 2, 3, 4),
inside as (select video_id, take_id, jersey_number, t, identity, coalesce(min(case when colour_dist <= 8 then struct_pack(d := colour_dist, i := track_id) end).i, min(case when arrow_dist is not null then struct_pack(d := arrow_dist, i := track_id) end).i) as i from cand group by 1, 2, 3, 4, 5),
turn as (select a.video_id, a.take_id, a.jersey_number, a.t, row_number() over (partition by a.video_id, a.take_id, a.jersey_number order by a.t) as n, coalesce(f.c.i, f.a.i) as fi, case when f.c is not null then f.c.c else f.a.c end as fc,
  case when len(f.r) = 1 or round(f.r[1].d - f.r[2].d, 9) >= 0.2 then f.r[1].i end as ni, case when len(f.r) = 1 or round(f.r[1].d - f.r[2].d, 9) >= 0.2 then f.r[1].c end as nc from asked a left join free f using (video_id, take_id, jersey_number, t)),
fold as (select video_id, take_id, jersey_number, n, t, coalesce(ni, fi) as track_id, case when ni is not null then 'jersey_ocr' when fi is not null then 'colour' else 'none' end as signal, case when ni is not null then nc else fc end as locked from turn where n = 1
  union all select u.video_id, u.take_id, u.jersey_number, u.n, u.t, case when s.locked is null then coalesce(u.ni, u.fi) else coalesce(p.i, u.ni) end,
  case when s.locked is null then (case when u.ni is not null then 'jersey_ocr' when u.fi is not null then 'colour' else 'none' end) when p.i is not null then 'locked_chain' when u.ni is not null then 'jersey_ocr_reacquired' else 'locked_identity_absent_at_instant' end,
  case when s.locked is not null then s.locked when u.ni is not null then u.nc else u.fc end
  from fold s join turn u on u.video_id = s.video_id and u.take_id = s.take_id and u.jersey_number = s.jersey_number and u.n = s.n + 1
  left join inside p on p.video_id = u.video_id and p.take_id = u.take_id and p.jersey_number = u.jersey_number and p.t = u.t and p.identity = s.locked)
"""


def _locked(spark, sf_dir):
    asked = ad.frames(spark, sf_dir).where("frame_index % 20 = 7").selectExpr("video_id", "take_id", "cast(floor(frame_index / 20) as bigint) % 3 as jersey_number", "t")
    near = timejoin.nearest_in_time(asked, ad.boxes(spark, sf_dir).select("video_id", "take_id", "track_id", "t"), 0.15, by=("track_id",))
    rows = near.selectExpr("video_id", "take_id", "jersey_number", "t", "near.track_id as track_id", "cast(floor(near.track_id / 3) as bigint) as identity", "cast(round(t * 25) as bigint) as k")
    cand = rows.selectExpr(
        "video_id", "take_id", "jersey_number", "t", "track_id", "identity", "if((k * 3 + track_id * 5) % 17 < 14, cast((k * 3 + track_id * 5) % 17 as double), null) as colour_dist",
        "if((k + track_id) % 19 = 0, cast((k + track_id) % 50 as double), null) as arrow_dist", "if((k * 7 + track_id) % 23 < 2, 0.5D + 0.1D * ((track_id + k) % 5), null) as agreement", "'ocr' as source",
    )
    return memory.lock_annotations(asked, cand)


@query(ASKED + "select video_id, take_id, jersey_number, round(t, 6) as t, track_id, signal, locked from fold")
def t24_lock_annotations(spark, sf_dir):
    return rounded(_locked(spark, sf_dir))


@query(ASKED + """select video_id, take_id, min(jersey_number) as jersey_number, bool_or(track_id is not null and starts_with(signal, 'jersey_')) as confirmed, count(distinct track_id) as n_tracks, count(track_id) as n_windows from fold group by 1, 2 having count(track_id) > 0""")
def t26_annotated_takes(spark, sf_dir):
    out = memory.annotated_takes(_locked(spark, sf_dir))
    n = F.aggregate("tracks", F.lit(0).cast("long"), lambda s, k: s + F.size(k["windows"]))
    return out.select("video_id", "take_id", "jersey_number", "confirmed", F.size("tracks").cast("long").alias("n_tracks"), n.alias("n_windows"))


@query()
def t5_teams_by_embedding(spark, sf_dir):
    crops = ad._read(spark, sf_dir, "embeddings").selectExpr("cast(floor(vec_id / 200) as bigint) as video_id", "cast(floor(vec_id / 100) as bigint) % 2 as take_id", "vec_id % 12 as track_id", "vec_id as crop", "embedding as vector")
    return rounded(identity.teams_by_embedding(crops))


@query(""", points as (select video_id, take_id, frame_index, t from frames),
near2 as (select p.video_id, p.take_id, p.frame_index, b.track_id, b.x1, b.y1, b.x2, b.y2, row_number() over (partition by p.video_id, p.frame_index, b.track_id order by round(abs(b.t - p.t), 9), b.t) as rn from points p join boxes b on b.video_id = p.video_id and b.take_id = p.take_id and round(abs(b.t - p.t), 9) <= 0.3 where b.track_id <> 11)
select video_id, take_id, frame_index, track_id, track_id // 3 as chain, round(x1 / 1280, 8) as x1, round(y1 / 720, 8) as y1, round(x2 / 1280, 8) as x2, round(y2 / 720, 8) as y2, round(y2 - y1, 6) as height, (track_id % 2)::int as team from near2 where rn = 1""")
def j16_players_at(spark, sf_dir):
    points = ad.frames(spark, sf_dir).select("video_id", "take_id", "frame_index", "t")
    tracks = ad.tracks(spark, sf_dir).withColumn("identity", F.expr("cast(floor(track_id / 3) as bigint)"))
    out = stats.players_at(points, ad.boxes(spark, sf_dir), tracks, ad.WIDTH, HEIGHT).drop("t", "team_confidence")
    return out.withColumns({c: F.round(c, 8) for c in ("x1", "y1", "x2", "y2")})  # shares of 1280 end at the eighth digit


@query("""select video_id, take_id, i as place, round(t_start + 10 * (i + 0.5) / n, 6) as t from (select *, unnest(range(n)) as i from (select *, case when take_id % 2 = 0 then 1 else 2 end as n from takes))""")
def w22_anchor_times(spark, sf_dir):
    times = series.anchor_times(F.col("t_start"), F.col("t_end"), F.col("take_id") % 2 * 5.0)
    return rounded(ad.takes(spark, sf_dir).select("video_id", "take_id", F.posexplode(times).alias("p", "t")).select("video_id", "take_id", F.col("p").cast("long").alias("place"), "t"))


@query(""", named as (select *, printf('%d-%d-%s-%d', take_id, player_track_id, type, cast(round(t_start * 25) as bigint)) as event_id, round(case when type = 'sprint' then 20 else 0 end * (1 + 0.5 * round(confidence, 6)), 6) as score from happened)
select video_id, event_id, round(t_start, 6) as t_start, case when type = 'sprint' then score end as rank_score, row_number() over (partition by video_id order by coalesce(case when type = 'sprint' then score end, -1) desc, round(t_start, 6), event_id) as place from named""")
def r7_event_table(spark, sf_dir):
    name = F.format_string("%d-%d-%s-%d", "take_id", "player_track_id", "type", F.round(F.col("t_start") * 25).cast("long"))
    named = rounded(_happened(spark, sf_dir).withColumn("event_id", name))
    clips = stats.clip_ranges(rounded(stats.rank_events(named)).where("type = 'sprint'"), ad.takes(spark, sf_dir))
    return rounded(stats.event_table(named, clips).select("video_id", "event_id", "t_start", "rank_score", "place"))


CARDS = """, rws as (select video_id, player_track_id, string_agg(printf('| %d:%04.1f | Sprint | %.2f |', cast(floor(t_start / 60) as int), t_start - floor(t_start / 60) * 60, confidence), chr(10) order by t_start, take_id) as body from (select * from sprints where confidence >= 0.15) group by 1, 2),
cnt as (select video_id, player_track_id, count(*) filter (type = 'sprint') as n, sum(case when type = 'possession' then t_end - t_start else 0 end) as held from happened group by 1, 2)
select c.video_id, case when c.player_track_id % 4 = 0 then 'target_001' else 'player_' || c.player_track_id end as player, array_to_string(['# Player Statistics', '', case when c.player_track_id % 4 = 0 then '## Target player (jersey number not readable)' else '## Player #' || c.player_track_id end, '', '**Identity Status:** Verified', '',
 '**Touches:** 0', '**Passes:** 0', '**Turnovers:** 0', '**Sprints/Runs:** ' || n, '**Goals:** not available (no scoreboard)', '**Assists:** not available (no scoreboard)', '**Shots:** 0', '**Tackles:** 0', '**Saves:** 0', '**Dribbles:** 0',
 '**Possession Time:** ' || printf('%.1fs', held), '**Distance Covered:** uncertain', '', '## Event Timeline', '', '| Time | Event | Confidence |', '|------|-------|------------|', coalesce(body, '| _(no events attributed to this player)_ | | |')], chr(10)) || chr(10) as card, cast(n as int) as sprints
from cnt c left join rws r using (video_id, player_track_id)"""


@query(CARDS)
def s8_stat_card_texts(spark, sf_dir):
    happened = _happened(spark, sf_dir)
    cards = stats.stat_card(happened, ("sprint", "possession"))
    line = F.struct("t_start", "take_id", "label", "confidence")
    rows = stats.timeline(happened).groupBy("video_id", "player_track_id").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    full = cards.join(rows, ["video_id", "player_track_id"], "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<struct<t_start: double, take_id: bigint, label: string, confidence: double>>")))
    number = F.expr("if(player_track_id % 4 = 0, null, player_track_id)")
    card = text.stat_card_text(number, {"sprints": F.col("n_sprint")}, F.col("possession_s"), F.lit(None).cast("double"), F.col("rows"), F.lit("not available (no scoreboard)"), F.lit("Verified"))
    out = full.select("video_id", text.player_key(number, F.lit("TARGET_001")).alias("player"), card.alias("card"))
    return out.withColumn("sprints", text.stat_card(F.col("card"))["sprints"])


@query("""select video_id, '# Annotations of ' || video_id || chr(10) || '# One event a line: MM:SS player #<number> in <colour> <what happens>' || chr(10)
 || coalesce(string_agg(printf('#' || chr(10) || '# Take %d: unverified, confidence %.2f' || chr(10) || '# 00:00 player #0 in white makes a pass', take_id, take_id / 10e0), chr(10) order by take_id) filter (take_id % 2 = 1), '#' || chr(10) || '# Every take is verified.') || chr(10) as template from takes group by 1""")
def x7_annotation_templates(spark, sf_dir):
    take = F.struct("take_id", F.when(F.col("take_id") % 2 == 1, "unverified").otherwise("verified").alias("status"), (F.col("take_id") / 10.0).alias("confidence"))
    held = ad.takes(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(take)).alias("takes"))
    return held.select("video_id", text.annotation_template(F.col("video_id"), F.col("takes")).alias("template"))


@query()
def a10_annotation_report(spark, sf_dir):
    line = F.col("line")
    rows = ad.annotation_lines(spark, sf_dir).select((F.col("line_no") % 40).alias("video_id"), text.skipped(line).alias("skipped"), text.annotation(line).isNotNull().alias("parsed"), F.expr("if(line_no % 5 = 0, null, line_no % 7)").alias("take_id"))
    return stats.annotation_report(rows)


SQL["a10_annotation_report"] = """select event_id % 40 as video_id, count(*) filter (event_id % 3 = 0) as n_parsed, count(*) filter (event_id % 3 = 2) as n_problems, count(*) filter (event_id % 15 = 0) as n_unassigned from events group by 1"""
