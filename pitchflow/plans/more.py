"""More registered queries: duels, goal sources, the followed player, teams, motion and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import geometry as g
from ..functions import text
from ..operators import duels, events as ev
from ..operators import filters, goals, identity, possession, series, stats, target, timejoin
from . import adapters as ad
from .queries import _happened, query, rounded

HEIGHT = 720.0
FEET = """, lines as (select video_id, take_id, t_start + 2 as t, 600e0 as p1, 100e0 as q1, 600e0 as p2, 700e0 as q2 from takes union all select video_id, take_id, t_start + 7, 500e0, 100e0, 500e0, 700e0 from takes),
pairs as (select video_id, take_id, lag(t) over w as ta, lag((x1 + x2) / 2) over w as ua, lag((y1 + y2) / 2) over w as va, lag(conf) over w as ca, t as tb, (x1 + x2) / 2 as ub, (y1 + y2) / 2 as vb, conf as cb from balls window w as (partition by video_id, take_id order by t)),
able as (select p.*, l.p1, l.q1, l.p2, l.q2, row_number() over (partition by p.video_id, p.take_id, p.tb order by abs(l.t - (ta + tb) / 2), l.t) as rn from pairs p join lines l using (video_id, take_id) where ca >= 0.5 and cb >= 0.5 and round(tb - ta, 9) <= 0.3),
met as (select *, (ub - ua) * (q2 - q1) - (vb - va) * (p2 - p1) as det, (p1 - ua) * (q2 - q1) - (q1 - va) * (p2 - p1) as sn, (p1 - ua) * (vb - va) - (q1 - va) * (ub - ua) as un from able where rn = 1)
select video_id, take_id, round(ta, 6) as t_start, round(tb, 6) as t_end from met where abs(det) >= 1e-9 and sn / det between 0 and 1 and un / det between 0 and 1"""


def _lines(spark, sf_dir):
    takes, rows = ad.takes(spark, sf_dir), None
    for after, x in ((2.0, 600.0), (7.0, 500.0)):
        posts = F.array(*[F.struct(F.lit(x).alias("x1"), F.lit(0.0).alias("y1"), F.lit(x).alias("x2"), F.lit(y).alias("y2")) for y in (700.0, 100.0)])
        part = takes.select("video_id", "take_id", (F.col("t_start") + after).alias("t"), g.goal_line(posts).alias("l")).select("video_id", "take_id", "t", "l.*")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _regions(spark, sf_dir):
    corners = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((701.5, 220.5), (1103.5, 220.5), (1103.5, 640.5), (701.5, 640.5))])
    return ad.takes(spark, sf_dir).select("video_id").distinct().withColumn("polygon", corners)


def _seeds(spark, sf_dir):
    return ad.tracks(spark, sf_dir).where("track_id in (2, 5)").select("video_id", "take_id", "track_id")


@query()
def e9_detect_dribbles(spark, sf_dir):
    boxes = ad.boxes(spark, sf_dir)
    x, y = g.cx(), g.cy()
    held = boxes.where("track_id = take_id % 10 + 1").select("video_id", "take_id", "frame_index", "t", (x - 5).alias("x1"), (y - 5).alias("y1"), (x + 5).alias("x2"), (y + 5).alias("y2"), "conf")
    samples = possession.run_samples(possession.possession_series(held, boxes, tracks=ad.tracks(spark, sf_dir)), ad.identities(spark, sf_dir))
    found = duels.detect_dribbles(samples, boxes, ad.tracks(spark, sf_dir), ad.FPS)
    return rounded(found.withColumn("acting", F.array_join(F.transform("raw_track_ids", lambda x: x.cast("string")), ",")).drop("raw_track_ids"))


@query()
def e11_detect_saves(spark, sf_dir):
    return rounded(duels.detect_saves(ad.balls(spark, sf_dir), ad.boxes(spark, sf_dir), ad.tracks(spark, sf_dir), ad.WIDTH))


@query(""", found as (select video_id, take_id, track_id, min(t) as t_start, max(t) as t_end, max(speed) as peak from runs_ group by video_id, take_id, track_id, run having round(max(t) - min(t), 9) >= 0.5)
select video_id, take_id, track_id, round(t_start, 6) as t_start, round(t_end, 6) as t_end, round(peak, 6) as peak, row_number() over (partition by video_id, take_id, track_id order by peak desc, t_start) as rank from found c
where not exists (select 1 from poss h where h.confidence >= 0.15 and h.video_id = c.video_id and h.take_id = c.take_id and h.player_track_id = c.track_id and c.t_end > h.t_start and c.t_start < h.t_end) qualify rank <= 6""")
def e12_candidate_windows(spark, sf_dir):
    taken = _happened(spark, sf_dir).where("type = 'possession'")
    return rounded(ev.candidate_windows(ad.boxes(spark, sf_dir), taken))


@query()
def e15_region_goals(spark, sf_dir):
    balls = ad.balls(spark, sf_dir)
    return rounded(goals.region_goals(balls, _regions(spark, sf_dir), ev.fast_ball(balls, ad.WIDTH)))


@query(FEET)
def e16_line_goals(spark, sf_dir):
    return rounded(goals.line_goals(ad.balls(spark, sf_dir), _lines(spark, sf_dir)).select("video_id", "take_id", "t_start", "t_end"))


@query()
def e18_goal_occurrences(spark, sf_dir):
    balls, lines = ad.balls(spark, sf_dir), _lines(spark, sf_dir).where("take_id % 2 = 0")
    readings = ad.frames(spark, sf_dir).where("frame_index % 5 = 0").selectExpr("video_id", "take_id", "explode(array(0, 1)) as region", "t", "frame_index").selectExpr(
        "video_id", "take_id", "region", "t", "if(region = 0 and take_id % 3 > 0, frame_index % 4, 1) as home", "cast(floor(frame_index / 125) as int) as away")
    inside = goals.region_goals(balls, _regions(spark, sf_dir), ev.fast_ball(balls, ad.WIDTH))
    return rounded(goals.goal_occurrences(goals.scoreboard_goals(readings), goals.line_goals(balls, lines), inside, lines))


@query("""select video_id, case when video_id % 4 = 3 then 'not_attempted' when video_id % 4 = 0 then 'no_scoreboard' when video_id % 4 = 1 then 'no_increment' else 'available' end as status,
case when video_id % 4 = 2 then '2 by scoreboard, 1 in marked regions, 1 unspecified' end as reason, case when video_id % 4 = 2 then 4 else 0 end::bigint as n_goals, case when video_id % 4 = 2 then 1 else 0 end::bigint as n_assists from (select distinct video_id from frames)""")
def p13_goal_availability(spark, sf_dir):
    takes = ad.takes(spark, sf_dir).where("video_id % 4 <> 3")
    videos = ad.frames(spark, sf_dir).select("video_id").distinct()
    found = videos.where("video_id % 4 = 2").selectExpr("video_id", "explode(array('scoreboard', 'scoreboard', 'goal_region', 'goal_line_crossing')) as source")
    return goals.goal_availability(videos, takes, videos.where("video_id % 4 = 1"), found, videos.where("video_id % 4 = 2"))


@query()
def w13_plausible_balls(spark, sf_dir):
    jumpy = ad.balls(spark, sf_dir).withColumns({c: F.expr(f"if(frame_index % 37 < 2, {c} + 900, {c})") for c in ("x1", "x2")})
    return rounded(series.plausible_balls(jumpy, ad.WIDTH))


@query()
def w15_resample_boxes(spark, sf_dir):
    thin = ad.boxes(spark, sf_dir).where("frame_index % 100 < 70")  # with gaps to bridge
    grid = ad.frames(spark, sf_dir).select("video_id", "take_id", "t")
    return rounded(series.resample_boxes(grid, thin, 0.5, 0.3))


@query()
def w19_target_timeline(spark, sf_dir):
    gone = ad.boxes(spark, sf_dir).where("not (track_id in (2, 5) and frame_index % 250 between 90 and 160)")
    return rounded(target.target_timeline(gone, _seeds(spark, sf_dir)))


@query(""", n as (select *, row_number() over w - 1 as i, count(*) over (partition by video_id, take_id, track_id) as n from boxes window w as (partition by video_id, take_id, track_id order by t))
select distinct video_id, take_id, track_id, frame_index from n join (select unnest(range(8)) as j) on n > 8 and i = (j * n) // 8 or n <= 8""")
def w21_evenly_sampled(spark, sf_dir):
    return series.evenly_sampled(ad.boxes(spark, sf_dir), 8).select("video_id", "take_id", "track_id", "frame_index")


#: Steps of camera motion: a quarter turn every fifth frame, and a shift in every frame.
MOVES = """, moves as (select video_id, take_id, frame_index, t, row_number() over (partition by video_id, take_id order by t) as k, case when frame_index % 5 = 0 then 0 else 1 end as a, case when frame_index % 5 = 0 then -1 else 0 end as b, frame_index % 9 as tx, 2 - frame_index % 4 as ty from frames),
way as (select video_id, take_id, frame_index, t, k, a, b, tx, -b as c, a as d, ty from moves where k = 1
  union all select m.video_id, m.take_id, m.frame_index, m.t, m.k, m.a * w.a + m.b * w.c, m.a * w.b + m.b * w.d, m.a * w.tx + m.b * w.ty + m.tx, -m.b * w.a + m.a * w.c, -m.b * w.b + m.a * w.d, -m.b * w.tx + m.a * w.ty + m.ty
  from way w join moves m on m.video_id = w.video_id and m.take_id = w.take_id and m.k = w.k + 1)"""


def _motion(spark, sf_dir):
    turn = "frame_index % 5 = 0"
    steps = ad.frames(spark, sf_dir).selectExpr("video_id", "take_id", "t", f"if({turn}, 0D, 1D) as a", f"if({turn}, -1D, 0D) as b", "frame_index % 9 as tx", f"if({turn}, 1D, 0D) as c", f"if({turn}, 0D, 1D) as d", "2 - frame_index % 4 as ty")
    return series.cumulative_motion(steps)


@query(MOVES + " select video_id, take_id, frame_index, a::bigint as a, b::bigint as b, tx::bigint as tx, ty::bigint as ty from way")
def w23_cumulative_motion(spark, sf_dir):
    cells = [F.col(c).cast("long").alias(c) for c in ("a", "b", "tx", "ty")]
    return _motion(spark, sf_dir).select("video_id", "take_id", F.round(F.col("t") * 25).cast("long").alias("frame_index"), *cells)


@query(MOVES + """ select b.video_id, b.take_id, b.frame_index, round((w.d * (b.x - w.tx) - w.b * (b.y - w.ty)) / (w.a * w.d - w.b * w.c), 6)::double as ref_x, round((w.a * (b.y - w.ty) - w.c * (b.x - w.tx)) / (w.a * w.d - w.b * w.c), 6)::double as ref_y
from (select *, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y from balls) b join way w using (video_id, take_id, frame_index)""")
def t8_to_reference(spark, sf_dir):
    points = ad.balls(spark, sf_dir).select("video_id", "take_id", "frame_index", "t", g.cx().alias("x"), g.cy().alias("y"))
    return rounded(series.to_reference(points, _motion(spark, sf_dir)).select("video_id", "take_id", "frame_index", "ref_x", "ref_y"))


@query()
def t3_assign_teams(spark, sf_dir):
    colours = ad.tracks(spark, sf_dir).selectExpr("video_id", "take_id", "track_id", "40 + 40 * (track_id % 2) + (video_id * 7 + track_id * 3) % 5 as l", "track_id % 3 as a", "0 as b")
    return rounded(identity.assign_teams(colours))


@query(""", tr as (select video_id, take_id, track_id, case when video_id % 2 = 0 then track_id % 2 else (track_id = 3)::int end as team from boxes group by 1, 2, 3)
select video_id, take_id, track_id, case when least(count(*) filter (team = 0) over w, count(*) filter (team = 1) over w) / count(*) over w < 0.25 then 0.3 else 0.8e0 end::double as team_confidence from tr window w as (partition by video_id, take_id)""")
def t4_balance_cap(spark, sf_dir):
    rows = ad.tracks(spark, sf_dir).selectExpr("video_id", "take_id", "track_id", "if(video_id % 2 = 0, track_id % 2, cast(track_id = 3 as int)) as team", "0.8D as team_confidence")
    return identity.balance_cap(rows).select("video_id", "take_id", "track_id", "team_confidence")


@query(""", hints as (select video_id, take_id, frame_index, t, (x1 + x2) / 2 as x, (y1 + y2) / 2 - 60 as y from balls where frame_index % 10 = 0),
hb as (select h.video_id, h.take_id, h.frame_index, h.x, h.y, b.track_id, b.x1, b.x2, b.y1, b.y2, row_number() over (partition by h.video_id, h.take_id, h.frame_index, b.track_id order by round(abs(b.t - h.t), 9), b.t desc) as rn
 from hints h join boxes b on b.video_id = h.video_id and b.take_id = h.take_id and round(abs(b.t - h.t), 9) <= 0.15),
hd as (select *, case when x between x1 and x2 and y between y1 and y2 then 0 else sqrt(pow((x1 + x2) / 2 - x, 2) + pow((y1 + y2) / 2 - y, 2)) end as d, not (x between x1 and x2 and y between y1 and y2) as outside from hb where rn = 1),
hr as (select *, row_number() over (partition by video_id, take_id, frame_index order by outside, d, track_id) as best from hd)
select video_id, take_id, track_id, count(*) as n_votes from hr where best = 1 and d <= 200 group by 1, 2, 3""")
def t9_vote_seed_tracks(spark, sf_dir):
    return target.vote_seed_tracks(_hints(spark, sf_dir), ad.boxes(spark, sf_dir))


def _hints(spark, sf_dir):
    return ad.balls(spark, sf_dir).where("frame_index % 10 = 0").select("video_id", "take_id", "frame_index", "t", g.cx().alias("x"), (g.cy() - 60).alias("y"))


@query(""", fk as (select * from (select video_id, take_id, track_id, max(t) - min(t) as a, avg(conf) as b, -min(sqrt(pow((x1 + x2) / 2 - 640, 2) + pow((y1 + y2) / 2 - 360, 2))) as c from boxes where track_id <> 11 group by 1, 2, 3) where round(a, 9) >= 0.5),
fl as (select *, max(a) over w as ah, min(a) over w as al, max(b) over w as bh, min(b) over w as bl, max(c) over w as ch, min(c) over w as cl from fk window w as (partition by video_id, take_id)),
fs as (select *, round(0.4 * case when ah - al > 1e-9 then (a - al) / (ah - al) else 1 end + 0.3 * case when bh - bl > 1e-9 then (b - bl) / (bh - bl) else 1 end + 0.3 * case when ch - cl > 1e-9 then (c - cl) / (ch - cl) else 1 end, 9) as score from fl)
select video_id, take_id, track_id, round(score, 6) as score from fs qualify row_number() over (partition by video_id, take_id order by score desc, track_id) = 1""")
def t10_fallback_seeds(spark, sf_dir):
    return rounded(target.fallback_seeds(ad.boxes(spark, sf_dir), ad.tracks(spark, sf_dir), ad.WIDTH, HEIGHT))


@query()
def t11_select_targets(spark, sf_dir):
    manual = ad.tracks(spark, sf_dir).where("track_id = 4 and take_id = 1").select("video_id", "take_id", "track_id")
    votes = target.vote_seed_tracks(_hints(spark, sf_dir).where("take_id < 3"), ad.boxes(spark, sf_dir))
    return rounded(target.select_targets(ad.takes(spark, sf_dir), manual, votes, target.fallback_seeds(ad.boxes(spark, sf_dir), ad.tracks(spark, sf_dir), ad.WIDTH, HEIGHT)))


@query()
def t18_extend_chains(spark, sf_dir):
    pieces = ad.boxes(spark, sf_dir).selectExpr("video_id", "take_id", "track_id + 12 * cast(floor(frame_index % 250 / 50) as bigint) as track_id", "t", "y2 - y1 + track_id % 3 as h").groupBy("video_id", "take_id", "track_id").agg(
        F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.percentile("h", 0.5).alias("height"))
    rows = pieces.selectExpr("*", "track_id % 2 as team", "if(track_id % 5 = 0, cast(track_id % 12 as string), null) as digits")
    chain = rows.where("track_id in (2, 5)").selectExpr("video_id", "take_id", "track_id as seed", "track_id")
    return identity.extend_chains(chain, rows)


@query()
def t21_verify_candidates(spark, sf_dir):
    lab = "named_struct('l', 40D + 25 * (track_id % 2) + take_id, 'a', 0D, 'b', 0D)"
    none = "cast(null as struct<l:double,a:double,b:double>)"
    rows = ad.tracks(spark, sf_dir).selectExpr(
        "video_id", "take_id", "track_id", f"named_struct('torso', if(track_id % 3 = 0, {none}, {lab}), 'shorts', {lab}, 'socks', if(track_id % 4 = 0, {lab}, {none})) as kit",
        "if(track_id % 5 = 0, null, cast(track_id % 5 as string)) as jersey", "60D + 5 * track_id as height", "named_struct('x', 100D * track_id, 'y', 300D, 'h', 100D) as first",
    )
    own = rows.where("take_id = 0 and track_id = 2").select("video_id", "kit", "jersey", "height", F.col("first").alias("last"))
    return rounded(target.verify_candidates(rows.where("take_id > 0"), own).drop("kit", "first"))


@query(""", tr as (select distinct video_id, take_id, track_id from boxes), ck as (select *, row_number() over (partition by video_id, take_id order by d, track_id) as rn from (select *, round(sqrt(pow(40 + 3 * track_id - (52 + 20 * (take_id % 3)), 2) + pow(track_id % 3 - 1, 2)), 9) as d from tr))
select video_id, take_id, case when d <= 8 then track_id end as track_id, round(d, 6) as dist from ck where rn = 1""")
def j12_nearest_colour(spark, sf_dir):
    colours = ad.tracks(spark, sf_dir).selectExpr("video_id", "take_id", "track_id", "40D + 3 * track_id as l", "cast(track_id % 3 as double) as a", "0D as b")
    asked = ad.takes(spark, sf_dir).selectExpr("video_id", "take_id", "named_struct('l', 52D + 20 * (take_id % 3), 'a', 1D, 'b', 0D) as ref")
    return rounded(target.nearest_colour(colours, asked).drop("ref"))


@query()
def j15_match_clicks(spark, sf_dir):
    clicks = ad.frames(spark, sf_dir).where("frame_index % 50 = 0").selectExpr("video_id", "take_id", "frame_index", "t", "(frame_index % 100) / 100D as x", "0.45D as y")
    return rounded(target.match_clicks(clicks, ad.boxes(spark, sf_dir), ad.WIDTH, HEIGHT))


@query("""select video_id, frame_index, track_id from boxes where not (frame_index % 5 = 0 and greatest(least(x2, 420) - greatest(x1, 300), 0) * greatest(least(y2, 330) - greatest(y1, 200), 0) / ((x2 - x1) * (y2 - y1)) > 0.3)""")
def p3_filter_overlap(spark, sf_dir):
    arrows = ad.frames(spark, sf_dir).where("frame_index % 5 = 0").selectExpr("video_id", "frame_index", "300D as x1", "200D as y1", "420D as x2", "330D as y2")
    return filters.filter_overlap(ad.boxes(spark, sf_dir), arrows).select("video_id", "frame_index", "track_id")


@query()
def a2_attribute_shots(spark, sf_dir):
    balls = ad.balls(spark, sf_dir)
    return rounded(stats.attribute_shots(ev.detect_shots(balls, ad.WIDTH), ad.boxes(spark, sf_dir), balls, _seeds(spark, sf_dir)))


@query()
def r5_category_clips(spark, sf_dir):
    return rounded(stats.category_clips(_happened(spark, sf_dir), ad.takes(spark, sf_dir)))


@query("select video_id, take_id, player_track_id, round(t_start, 6) as t_start, 'Sprint' as label from sprints where confidence >= 0.15")
def r6_timeline(spark, sf_dir):
    return rounded(stats.timeline(_happened(spark, sf_dir)).select("video_id", "take_id", "player_track_id", "t_start", "label"))


@query("""select event_id, 'Verified' as identity_status, cast(event_id % 13 as int) as touches, cast(0 as int) as goals, case when event_id % 2 = 0 then 'uncertain' else '12.5s' end as possession_time, cast(case when event_id % 3 = 0 then 2 else 1 end as int) as n_events, case when event_id % 3 = 0 then 0.9 else 0.5 end::double as last_confidence from events""")
def s9_stat_card_text(spark, sf_dir):
    card = F.expr(
        r"""concat('**Identity Status:** Verified\n**Touches:** ', event_id % 13, '\n**Goals:** not available (no scoreboard)\n', if(event_id % 2 = 0, '', '**Possession Time:** 12.5s\n'),
        '| Time | Event | Confidence |\n|---|---|---|\n| 0:05.0 | Pass | 0.5 |', if(event_id % 3 = 0, '\n| 0:07.0 | Shot | high |', ''))"""
    )
    rows = ad._read(spark, sf_dir, "events").select("event_id", text.stat_card(card).alias("c"))
    return rows.select("event_id", "c.identity_status", "c.touches", "c.goals", "c.possession_time", F.size("c.events").alias("n_events"), F.element_at("c.events", -1)["confidence"].alias("last_confidence"))


@query("""select event_id, case when event_id % 3 > 0 then cast(event_id % 90 as varchar) end as digits, case event_id % 3 when 0 then 0.15 else 0.75 end::double as confidence, case when event_id % 1000 < 500 then (event_id % 1000) / 1000e0 end as x1, cast(event_id % 10 as int) as home, cast(event_id % 7 as int) as away,
printf('%d:%04.1f', cast(floor(event_id / 25e0 / 60) as int), event_id / 25e0 - floor(event_id / 25e0 / 60) * 60) as clock from events""")
def x4_x6_texts(spark, sf_dir):
    rows = ad._read(spark, sf_dir, "events").selectExpr(
        "event_id", "if(event_id % 3 = 0, 'number=unknown', concat('I read NUMBER=', event_id % 90)) as n", "concat('GOAL=', event_id % 1000, ',10,500,90') as b", "concat('HOME ', event_id % 10, ' - ', event_id % 7, ' AWAY') as s", "event_id / 25D as t",
    )
    out = rows.select("event_id", text.number_answer(F.col("n")).alias("n"), text.goal_box_answer(F.col("b")).alias("b"), text.score(F.col("s")).alias("s"), text.clock(F.col("t")).alias("clock"))
    return out.select("event_id", "n.digits", "n.confidence", "b.x1", "s.home", "s.away", "clock")


_WORDS = list(config.COLOURS)
_NAMED = ", ".join(f"'{w}'" for w in _WORDS)
_LINE = f"""case event_id % 5 when 0 then 'Min ' || clock || ' — Player #' || number || ' in ' || name || ' makes a pass' when 1 then clock || ': In ' || upper(name) || ' player #' || number || '  shoots'
  when 2 then '1:' || clock || ' # ' || number || ' ' || name || ' scores a  goal' when 3 then 'Min ' || clock || '-blues win, #' || number || ' saves' else 'Min ' || clock || ' player in ' || name || ' runs' end"""


@query(f""", said as (select event_id, list_extract([{_NAMED}], cast(event_id % {len(_WORDS)} as int) + 1) as name, printf('%d:%02d', event_id % 90, event_id % 60) as clock, (event_id % 30)::varchar as number from events),
lines as (select event_id, trim({_LINE}) as line from said),
cut as (select event_id, regexp_extract(line, '^(?:Min )?((?:\\d{{1,2}}:)?\\d{{1,2}}:\\d{{2}})(.*)$', 1) as at_, regexp_replace(regexp_replace(regexp_extract(line, '^(?:Min )?((?:\\d{{1,2}}:)?\\d{{1,2}}:\\d{{2}})(.*)$', 2), '^\\s*(?:[—:-]\\s*)?', ''), '^\\s*player\\b\\s*', '', 'i') as rest from lines),
col as (select *, lower(regexp_extract(rest, '\\b(?:in\\s+)?({"|".join(sorted(_WORDS, key=len, reverse=True))})\\b', 1, 'i')) as name, regexp_replace(rest, '\\b(?:in\\s+)?({"|".join(sorted(_WORDS, key=len, reverse=True))})\\b', '', 'i') as plain from cut)
select event_id as line_no, list_reduce(list_transform(string_split(at_, ':'), lambda x: x::int), lambda a, x: a * 60 + x)::double as t, regexp_extract(plain, '#\\s*(\\d+)', 1)::int as jersey_number, case when name = '' then 'unspecified' else name end as team_colour,
trim(regexp_replace(regexp_replace(plain, '#\\s*(\\d+)', ''), '\\s+', ' ', 'g')) as action_phrase, case event_id % 5 when 0 then 'pass' when 1 then 'shot' when 2 then 'goal' when 3 then 'save' end as event_type from col where plain like '%#%'""")
def x1_colours_and_orders(spark, sf_dir):
    """Lines that name every colour, before or after the number."""
    rows = ad._read(spark, sf_dir, "events").selectExpr("event_id", f"element_at(array({_NAMED}), cast(event_id % {len(_WORDS)} as int) + 1) as name", "concat(cast(event_id % 90 as string), ':', lpad(cast(event_id % 60 as string), 2, '0')) as clock", "cast(event_id % 30 as string) as number")
    lines = rows.selectExpr("event_id as line_no", f"{_LINE} as line")
    return lines.select("line_no", text.annotation(F.col("line")).alias("a")).where("a is not null").select("line_no", "a.*")


@query(f""", tr as (select distinct video_id, take_id, track_id from boxes), words(i, name, l, a, b) as (values {", ".join(f"({i}, '{w}', {lab[0]}e0, {lab[1]}e0, {lab[2]}e0)" for i, (w, lab) in enumerate(config.COLOURS.items()))}),
seen as (select t.*, l + track_id - 3 as l, a + take_id as a, b from tr t join words on i = (track_id * 5 + video_id) % {len(_WORDS)}),
asked as (select video_id, take_id, coalesce(name, 'tartan') as colour, l, a, b from takes left join words on i = (video_id * 6 + take_id) % {len(_WORDS) + 1}),
near_ as (select k.video_id, k.take_id, colour, track_id, round(sqrt(pow(s.l - k.l, 2) + pow(s.a - k.a, 2) + pow(s.b - k.b, 2)), 9) as d, row_number() over (partition by k.video_id, k.take_id order by round(sqrt(pow(s.l - k.l, 2) + pow(s.a - k.a, 2) + pow(s.b - k.b, 2)), 9), track_id) as rn from asked k join seen s using (video_id, take_id))
select video_id, take_id, colour, case when d <= 8 then track_id end as track_id, round(d, 6) as dist from near_ where rn = 1""")
def j12_named_colours(spark, sf_dir):
    """Tracks by a colour's name; a name that no table knows finds none."""
    words = F.array(*[F.lit(w) for w in _WORDS])
    word = lambda k: F.element_at(words, (k % len(_WORDS) + 1).cast("int"))
    looks = ad.tracks(spark, sf_dir).select("video_id", "take_id", "track_id", text.colour_reference(word(F.col("track_id") * 5 + F.col("video_id"))).alias("c"))
    colours = looks.select("video_id", "take_id", "track_id", (F.col("c.l") + F.col("track_id") - 3).alias("l"), (F.col("c.a") + F.col("take_id")).alias("a"), F.col("c.b").alias("b"))
    at = (F.col("video_id") * 6 + F.col("take_id")) % (len(_WORDS) + 1)
    asked = ad.takes(spark, sf_dir).select("video_id", "take_id", F.when(at < len(_WORDS), F.upper(F.element_at(words, (at + 1).cast("int")))).otherwise("tartan").alias("named"))
    found = target.nearest_colour(colours, asked.withColumnRenamed("named", "colour"))
    return rounded(found.withColumn("colour", F.lower("colour")).drop("ref"))
