"""SQL for queries registered elsewhere whose rules look at neighbouring runs or at the rows kept before."""

from __future__ import annotations

from . import more  # noqa: F401
from .queries import BASE, SQL

#: Neighbouring runs of possession of different tracks, with the ball's places and the runs' quality.
NEIGHBOURS = """, rq as (select p.video_id, p.take_id, p.run_id, min(p.identity) as id, min(p.t) as s, max(p.t) as e, count(*) as n, avg(p.dist) as md, arg_min((b.x1 + b.x2) / 2, p.t) as fx, arg_min((b.y1 + b.y2) / 2, p.t) as fy,
  arg_max((b.x1 + b.x2) / 2, p.t) as lx, arg_max((b.y1 + b.y2) / 2, p.t) as ly, arg_min(p.track_id, p.t) as ft, arg_max(p.track_id, p.t) as lt from prun p join balls b using (video_id, take_id, frame_index) group by 1, 2, 3),
rqq as (select *, (8 + id % 3) / 10e0 * (0.5 * least(1.0, n / (greatest(1.0, round_even((e - s) * 25, 0)) + 1)) + 0.5 * greatest(0, 1 - md / 70)) as q from rq),
rpair as (select *, lead(id) over w as bid, lead(ft) over w as bt, lead(s) over w as bs, lead(q) over w as bq, lead(fx) over w as bx, lead(fy) over w as by_ from rqq window w as (partition by video_id, take_id order by run_id))"""

#: The ball's smoothed velocity, and whether it changes at a time of ``marks`` (video_id, take_id, t).
STATES = """, st as (select b.*, avg((x1 + x2) / 2) over w as x, avg((y1 + y2) / 2) over w as y from balls b where conf >= 0.3 window w as (partition by video_id, take_id order by t rows between 11 preceding and current row)),
sv as (select *, t - lag(t) over w as d, x - lag(x) over w as ex, y - lag(y) over w as ey from st window w as (partition by video_id, take_id order by t)),
states as (select video_id, take_id, t, case when d > 0 and d <= 0.5 then ex / d / 100 else 0 end as vx, case when d > 0 and d <= 0.5 then ey / d / 100 else 0 end as vy, coalesce(d > 0 and d <= 0.5, true) as known from sv)"""
KICKS = """, sides as (select k.video_id, k.take_id, k.t, g.s, v.vx, v.vy, v.known, row_number() over (partition by k.video_id, k.take_id, k.t, g.s order by round(abs(v.t - (k.t + g.s * 0.2)), 9), v.t desc) as rn
  from (select distinct video_id, take_id, t from marks) k cross join (values (-1), (1)) g(s) join states v on v.video_id = k.video_id and v.take_id = k.take_id and round(abs(v.t - (k.t + g.s * 0.2)), 9) <= 0.2),
kicked as (select a.video_id, a.take_id, a.t from sides a join sides b using (video_id, take_id, t) where a.s = -1 and b.s = 1 and a.rn = 1 and b.rn = 1 and a.known and b.known and sqrt(pow(a.vx - b.vx, 2) + pow(a.vy - b.vy, 2)) >= 2)"""

#: Every candidate for a pass in turn of its passer; the fold carries the time of the passer's last pass.
PASSES = NEIGHBOURS + STATES + ", marks as (select video_id, take_id, e as t from rpair where bid <> id)" + KICKS + """,
shade as (select *, abs(case when lt % 4 < 3 then lt % 3 end - case when bt % 4 < 3 then bt % 3 end) * 15 as d from rpair where bid <> id),
cand as (select s.video_id, s.take_id, id as passer, bid as receiver, lt as passer_track, bt as receiver_track, e as t, bs as t_end, round(bs - e, 9) as gap, round(e - s.s, 9) as len, sqrt(pow(bx - lx, 2) + pow(by_ - ly, 2)) as travel, (q + bq) / 2 as mq,
  case when d <= 8 then true when d >= 24 then false when lt <> 9 and bt <> 9 then lt % 2 = bt % 2 end as same, k.t is not null as kicked from shade s left join kicked k on k.video_id = s.video_id and k.take_id = s.take_id and k.t = s.e),
conf_ as (select *, least(greatest(greatest(0, 1 - travel / 750) * mq, 0.1), 0.35) as confidence from cand),
turn as (select *, case when gap < 0 or gap > 2 then 'gap' when not kicked and len < 0.3 then 'not_kicked' when not kicked and gap < 0.25 then 'flight' end as early,
  case when travel > 750 then 'too_far' when not kicked and travel < 60 then 'too_near' when same is null then 'team_unknown' when confidence < 0.15 then 'confidence' end as late, row_number() over (partition by video_id, take_id, passer order by t) as k from conf_),
fold as (select *, case when early is null and late is null and same then t else -1e18 end as last_, coalesce(early, late) as reject from turn where k = 1
  union all select u.*, case when u.early is null and u.late is null and u.same and round(u.t - f.last_, 9) >= 1.0 then u.t else f.last_ end, coalesce(u.early, case when round(u.t - f.last_, 9) < 1.0 then 'debounce' end, u.late)
  from fold f join turn u on u.video_id = f.video_id and u.take_id = f.take_id and u.passer = f.passer and u.k = f.k + 1),
passes as (select video_id, take_id, case when reject is null then case when same then 'pass' else 'turnover' end end as type, passer, receiver, t as t_start, t_end, travel, confidence, reject, passer_track, receiver_track, kicked from fold)"""

TACKLES = """, born as (select video_id, take_id, track_id, min(t) as b0 from boxes group by 1, 2, 3),
won as (select p.video_id, p.take_id, p.lt as tackled, p.bt as tackler, p.bid as player, p.e as t_a, p.bs as t_b, (p.q + p.bq) / 2 as quality, greatest(p.bs - 1.0, b.b0) as t0 from rpair p join born b on b.video_id = p.video_id and b.take_id = p.take_id and b.track_id = p.bt
  where p.bid <> p.id and p.lt <> 9 and p.bt <> 9 and p.lt % 2 <> p.bt % 2 and round(p.bs - p.e, 9) between 0 and 1.5),
spots as (select distinct video_id, take_id, tackler, t from (select video_id, take_id, tackler, t0 as t from won union all select video_id, take_id, tackler, t_b from won)),
body as (select s.*, (b.x1 + b.x2) / 2 as px, (b.y1 + b.y2) / 2 as py, b.y2 - b.y1 as ph, row_number() over (partition by s.video_id, s.take_id, s.tackler, s.t order by round(abs(b.t - s.t), 9), b.t desc) as rn from spots s join boxes b on b.video_id = s.video_id and b.take_id = s.take_id and b.track_id = s.tackler and round(abs(b.t - s.t), 9) <= 0.15),
where_ as (select s.*, (b.x1 + b.x2) / 2 as qx, (b.y1 + b.y2) / 2 as qy, row_number() over (partition by s.video_id, s.take_id, s.tackler, s.t order by round(abs(b.t - s.t), 9), b.t desc) as rn from spots s join balls b on b.video_id = s.video_id and b.take_id = s.take_id and round(abs(b.t - s.t), 9) <= 0.15),
apart_ as (select b.video_id, b.take_id, b.tackler, b.t, b.ph, sqrt(pow(px - qx, 2) + pow(py - qy, 2)) as d from body b join where_ w using (video_id, take_id, tackler, t) where b.rn = 1 and w.rn = 1),
closed as (select w.*, case when t_b > t0 then (a.d - b.d) / (t_b - t0) / ((a.ph + b.ph) / 2) else 0 end as speed from won w join apart_ a on a.video_id = w.video_id and a.take_id = w.take_id and a.tackler = w.tackler and a.t = w.t0
  join apart_ b on b.video_id = w.video_id and b.take_id = w.take_id and b.tackler = w.tackler and b.t = w.t_b),
tackles as (select video_id, take_id, 'tackle' as type, player as player_track_id, tackler, tackled, t0 as t_start, t_b as t_end, speed as closing_speed, least(greatest(quality * least(1.0, (speed - 1) / 2), 0.1), 0.3) as confidence from closed where speed >= 1)"""

PASS_ROW = "video_id, take_id, type, passer, receiver, round(t_start, 6) as t_start, round(t_end, 6) as t_end, round(travel, 6) as travel, round(confidence, 6) as confidence, reject, passer_track, receiver_track, kicked"
SQL["e7_e8_passes_turnovers"] = BASE + PASSES + f"select {PASS_ROW} from passes"
SQL["p7_pass_rejects"] = BASE + PASSES + "select 'passes' as stage, reject as reason, count(*) as n from passes where reject is not null group by 2"
SQL["e10_detect_tackles"] = BASE + NEIGHBOURS + TACKLES + "select video_id, take_id, type, player_track_id, tackler, tackled, round(t_start, 6) as t_start, round(t_end, 6) as t_end, round(closing_speed, 6) as closing_speed, round(confidence, 6) as confidence from tackles where confidence >= 0.15"
SQL["j9_turnovers_without_tackles"] = BASE + PASSES + TACKLES + f"""select {PASS_ROW} from passes p where type = 'turnover' and not exists
  (select 1 from tackles k where k.confidence >= 0.15 and k.video_id = p.video_id and k.take_id = p.take_id and k.tackler = p.receiver_track and k.tackled = p.passer_track and abs(p.t_end - k.t_end) <= 0.5)"""

TOUCHES = STATES + """, near40 as (select b.video_id, b.take_id, case when n.track_id = 10 then 9 else n.track_id end as id, n.track_id as raw, b.t, b.conf, n.d as dist, row_number() over (partition by b.video_id, b.take_id, case when n.track_id = 10 then 9 else n.track_id end order by b.t) as k from balls b join nearest n on n.best = 1 and b.video_id = n.video_id and b.take_id = n.take_id and b.frame_index = n.frame_index where b.conf >= 0.3 and n.d <= 40),
marks as (select video_id, take_id, t from near40)""" + KICKS + """,
able as (select n.*, least(greatest(0.1 + (1 - n.dist / 40) * n.conf * 0.35, 0.1), 0.45) as c, row_number() over (partition by video_id, take_id, id order by t) as turn from near40 n join kicked using (video_id, take_id, t) where c >= 0.15),
hits as (select *, t as last_ from able where turn = 1
  union all select u.*, case when round(u.t - h.last_, 9) >= 0.3 then u.t else h.last_ end from hits h join able u on u.video_id = h.video_id and u.take_id = h.take_id and u.id = h.id and u.turn = h.turn + 1),
touches as (select * from hits where last_ = t)"""
SQL["e4_detect_touches"] = BASE + TOUCHES + """
select video_id, take_id, 'touch' as type, id as player_track_id, round(t, 6) as t_start, round(t, 6) as t_end, round(dist, 6) as dist, raw as raw_track_id, round(c, 6) as confidence from touches where c >= 0.15"""

_shots = SQL["e2_detect_shots"][len(BASE) :]
_at = _shots.rindex("\nselect ")
SHOTS = f"{_shots[:_at]}, shots as ({_shots[_at:]})"
SQL["a2_attribute_shots"] = BASE + SHOTS + """, person as (select s.video_id, s.take_id, s.t_start, b.track_id, (b.x1 + b.x2) / 2 as px, (b.y1 + b.y2) / 2 as py, b.y2 - b.y1 as ph, round(abs(b.t - s.t_start), 9) as gap, row_number() over (partition by s.video_id, s.take_id, s.t_start, b.track_id order by round(abs(b.t - s.t_start), 9), b.t desc) as rn
  from shots s join boxes b on b.video_id = s.video_id and b.take_id = s.take_id and b.track_id in (2, 5) and round(abs(b.t - s.t_start), 9) <= 1),
who as (select *, row_number() over (partition by video_id, take_id, t_start order by gap, track_id desc) as best from person where rn = 1),
ball_ as (select s.video_id, s.take_id, s.t_start, (b.x1 + b.x2) / 2 as bx, (b.y1 + b.y2) / 2 as by_, row_number() over (partition by s.video_id, s.take_id, s.t_start order by round(abs(b.t - s.t_start), 9), b.t) as rn from shots s join balls b on b.video_id = s.video_id and b.take_id = s.take_id and round(abs(b.t - s.t_start), 9) <= 1)
select s.*, w.track_id as player_track_id from shots s join who w on w.best = 1 and w.video_id = s.video_id and w.take_id = s.take_id and w.t_start = s.t_start join ball_ b on b.rn = 1 and b.video_id = s.video_id and b.take_id = s.take_id and b.t_start = s.t_start
where ph > 0 and sqrt(pow(px - bx, 2) + pow(py - by_, 2)) / ph <= 4"""

SQL["j15_match_clicks"] = BASE + """, clicks as (select video_id, take_id, frame_index, t, (frame_index % 100) / 100e0 * 1280 as x, 0.45e0 * 720 as y from frames where frame_index % 50 = 0),
cb as (select c.*, b.track_id, b.x1, b.y1, b.x2, b.y2, row_number() over (partition by c.video_id, c.take_id, c.frame_index, b.track_id order by round(abs(b.t - c.t), 9), b.t) as rn from clicks c join boxes b on b.video_id = c.video_id and b.take_id = c.take_id and round(abs(b.t - c.t), 9) <= 2),
cd as (select *, not (x between x1 and x2 and y between y1 and y2) as outside, case when x between x1 and x2 and y between y1 and y2 then 0 else sqrt(pow((x1 + x2) / 2 - x, 2) + pow((y1 + y2) / 2 - y, 2)) end as dist from cb where rn = 1)
select video_id, take_id, frame_index, round(t, 6) as t, round(x, 6) as x, round(y, 6) as y, track_id, round(dist, 6) as dist from (select *, row_number() over (partition by video_id, take_id, frame_index order by outside, dist, track_id) as best from cd) where best = 1 and (not outside or dist <= 108)"""

SQL["w15_resample_boxes"] = BASE + """, thin as (select * from boxes where frame_index % 100 < 70),
cell as (select g.video_id, g.take_id, k.track_id, g.t from (select video_id, take_id, t from frames) g join (select distinct video_id, take_id, track_id from thin) k on k.video_id = g.video_id and k.take_id = g.take_id),
held_ as (select c.video_id, c.take_id, c.track_id, c.t, max(b.t) filter (b.t <= c.t) as ta, min(b.t) filter (b.t >= c.t) as tb from cell c join thin b on b.video_id = c.video_id and b.take_id = c.take_id and b.track_id = c.track_id group by 1, 2, 3, 4),
both_ as (select h.*, coalesce(round(tb - ta, 9) > 0 and round(tb - ta, 9) <= 0.5, false) as interpolated, (h.t - ta) / (tb - ta) as f, (tb is null or h.t - ta <= tb - h.t) as left_ from held_ h),
val as (select h.*, a.x1 as ax1, a.x2 as ax2, a.y1 as ay1, a.y2 as ay2, b.x1 as bx1, b.x2 as bx2, b.y1 as by1, b.y2 as by2 from both_ h left join thin a on a.video_id = h.video_id and a.take_id = h.take_id and a.track_id = h.track_id and a.t = h.ta left join thin b on b.video_id = h.video_id and b.take_id = h.take_id and b.track_id = h.track_id and b.t = h.tb)
select video_id, take_id, track_id, round(t, 6) as t, """ + ", ".join(f"round(case when interpolated then a{c} + f * (b{c} - a{c}) when left_ then a{c} else b{c} end, 6) as {c}" for c in ("x1", "y1", "x2", "y2")) + """, interpolated
from val where interpolated or round(case when left_ then t - ta else tb - t end, 9) <= 0.3"""


def _ctes(name: str) -> tuple[str, str]:
    """The parts of a query's SQL before and from its last select."""
    body = SQL[name][len(BASE) :]
    at = body.rindex("\nselect ") if "\nselect " in body else 0
    return body[:at], body[at:]


def _greedy(rows: str, keys: str, hit: str) -> str:
    """Rows of ``rows`` (in turn k of their key) that no kept one k_ hits; a fold carries the kept ones."""
    same = " and ".join(f"u.{c} = g.{c}" for c in keys.split(", "))
    return f""", g as (select {keys}, k, [{rows}] as kept from {rows} where k = 1
  union all select {", ".join("u." + c for c in keys.split(", "))}, u.k, case when len(list_filter(g.kept, lambda k_: {hit})) > 0 then g.kept else list_append(g.kept, u) end from g join {rows} u on {same} and u.k = g.k + 1),
kept_ as (select unnest(arg_max(kept, k), recursive := false) as r from g group by {keys})"""


CLASH = "greatest(least(k_.clip_end, u.clip_end) - greatest(k_.clip_start, u.clip_start), 0) > 0.6 * ((k_.clip_end - k_.clip_start) + (u.clip_end - u.clip_start) - greatest(least(k_.clip_end, u.clip_end) - greatest(k_.clip_start, u.clip_start), 0))"
CUT = "greatest(h.t_start - 3, k.t_start) as clip_start, least(h.t_end + 2, k.t_end) as clip_end"
CLIP = "round(r.clip_start, 6) as clip_start, round(r.clip_end, 6) as clip_end"

SQL["r3_dedupe_clips"] = (
    BASE + f""", rk as ({_ctes("r1_rank_events")[1]}), cl as (select h.*, {CUT} from rk h join takes k using (video_id, take_id)),
cn as (select *, row_number() over (partition by video_id, player_track_id order by rank) as k from cl where clip_end > clip_start)""" + _greedy("cn", "video_id, player_track_id", CLASH)
    + f"select r.video_id, r.take_id, r.player_track_id, r.type, r.t_start, r.t_end, r.confidence, r.rank_score, r.rank, {CLIP} from kept_ qualify row_number() over (partition by r.video_id, r.player_track_id order by r.rank) <= 15"
)
SQL["r5_category_clips"] = (
    BASE + f""", rk as (select *, 'ball_possession' as category, row_number() over (partition by video_id, player_track_id order by confidence desc, t_start, take_id) as rank from happened where type = 'possession'),
cl as (select h.*, {CUT} from rk h join takes k using (video_id, take_id)), cn as (select *, row_number() over (partition by video_id, player_track_id order by rank) as k from cl where clip_end > clip_start)""" + _greedy("cn", "video_id, player_track_id", CLASH)
    + f"select r.video_id, r.take_id, r.player_track_id, r.type, round(r.t_start, 6) as t_start, round(r.t_end, 6) as t_end, round(r.confidence, 6) as confidence, r.category, r.rank, {CLIP} from kept_"
)

SQL["e15_region_goals"] = BASE + SHOTS + """, inside_ as (select b.video_id, b.take_id, b.t, (select max(f.t_end) from bf f where f.video_id = b.video_id and f.take_id = b.take_id and f.t_end <= b.t) as t_before from balls b
  where (x1 + x2) / 2 between 701.5 and 1103.5 and (y1 + y2) / 2 between 220.5 and 640.5),
led as (select *, row_number() over (partition by video_id, take_id order by t) as k from inside_ where t - t_before <= 3),
fold as (select *, t as last_ from led where k = 1
  union all select u.*, case when round(u.t - f.last_, 9) > 3 then u.t else f.last_ end from fold f join led u on u.video_id = f.video_id and u.take_id = f.take_id and u.k = f.k + 1)
select video_id, take_id, 'goal' as type, round(t_before, 6) as t_start, round(t, 6) as t_end, round(t, 6) as t_after, 0.45e0 as confidence, 'goal_region' as source from fold where t = last_"""

SQL["e19_attribute_goals"] = BASE + """, level as (select video_id, take_id, cast(floor(frame_index / 40) as bigint) as score, min(t) as t_after, count(*) as n from frames group by 1, 2, 3),
scored as (select video_id, take_id, t_after from level l where n >= 2 and t_after > (select min(t_after) from level f where f.video_id = l.video_id and f.take_id = l.take_id)),
vote as (select s.video_id, s.take_id, s.t_after, p.raw % 2 as team, sum(p.t_end - p.t_start) as held, min(p.t_start) as seen, arg_max(p.player_track_id, p.t_end) as scorer
  from scored s join poss p on p.video_id = s.video_id and p.take_id = s.take_id and p.confidence >= 0.15 and p.t_end >= s.t_after - 8 and p.t_start <= s.t_after group by 1, 2, 3, 4),
top as (select * from vote qualify row_number() over (partition by video_id, take_id, t_after order by held desc, seen) = 1)
select s.video_id, s.take_id, round(s.t_after, 6) as t_after, round(0.75 * case when team is null then 0.5 else 0.8 end, 6)::double as confidence, team::int as team, scorer from scored s left join top using (video_id, take_id, t_after)"""

_votes, _fallback = _ctes("t9_vote_seed_tracks"), _ctes("t10_fallback_seeds")
SQL["t11_select_targets"] = BASE + _votes[0] + _fallback[0] + f""", votes as (select *, n_votes / sum(n_votes) over (partition by video_id, take_id) as share from ({_votes[1]}) where take_id < 3),
arrow as (select * from votes qualify row_number() over (partition by video_id, take_id order by n_votes desc, track_id) = 1),
rest as ({_fallback[1]})
select k.video_id, k.take_id, case when k.take_id = 1 then 'manual' when a.share >= 0.4 then 'arrow_vote' when r.track_id is not null then 'fallback' else 'none' end as method,
case when k.take_id = 1 then 4 when a.share >= 0.4 then a.track_id else r.track_id end as track_id, round(case when k.take_id = 1 then 1 when a.share >= 0.4 then a.share when r.track_id is not null then least(r.score, 0.35) else 0 end, 6)::double as confidence
from takes k left join arrow a using (video_id, take_id) left join rest r using (video_id, take_id)"""

_joint = "greatest(least(k_.x2, u.x2) - greatest(k_.x1, u.x1), 0) * greatest(least(k_.y2, u.y2) - greatest(k_.y1, u.y1), 0)"
SQL["w24_suppress_overlaps"] = (
    BASE + ", bn as (select *, row_number() over (partition by video_id, frame_index order by conf desc, track_id desc) as k from boxes)"
    + _greedy("bn", "video_id, frame_index", f"{_joint} > 0.1 * ((k_.x2 - k_.x1) * (k_.y2 - k_.y1) + (u.x2 - u.x1) * (u.y2 - u.y1) - {_joint})")
    + "select r.video_id, r.take_id, r.track_id, r.frame_index, round(r.t, 6) as t, r.x1, r.y1, r.x2, r.y2, r.conf::double as conf, 'player' as cls from kept_"
)

SQL["e11_detect_saves"] = BASE + SHOTS + """, moved as (select f.video_id, f.take_id, f.t_start, f.t_end as t_fast, max(m.speed) filter (m.t <= f.t_end) as before_, max(m.speed) filter (m.t > f.t_end) as after_, sum(m.dx) filter (m.t <= f.t_end) as dxb, sum(m.dx) filter (m.t > f.t_end) as dxa,
  max(m.t) filter (m.t > f.t_end) as t_end, arg_max((m.x1 + m.x2) / 2, m.t) filter (m.t <= f.t_end) as x, arg_max((m.y1 + m.y2) / 2, m.t) filter (m.t <= f.t_end) as y
  from bf f join bw m on m.video_id = f.video_id and m.take_id = f.take_id and m.t between f.t_start and f.t_end + 1.0 group by 1, 2, 3, 4),
keep as (select m.*, b.track_id, sqrt(pow((b.x1 + b.x2) / 2 - m.x, 2) + pow((b.y1 + b.y2) / 2 - m.y, 2)) as dist, row_number() over (partition by m.video_id, m.take_id, m.t_start, m.t_fast, b.track_id order by round(abs(b.t - m.t_fast), 9), b.t desc) as rn
  from moved m join boxes b on b.track_id in (0, 6) and b.video_id = m.video_id and b.take_id = m.take_id and round(abs(b.t - m.t_fast), 9) <= 0.15 where m.t_end is not null),
best_ as (select * from keep where rn = 1 and dist <= 300 qualify row_number() over (partition by video_id, take_id, t_start order by dist, track_id) = 1),
told as (select *, before_ > 0 and after_ <= 0.3 * before_ as decelerated, dxb * dxa < 0 as reversed from best_),
sure as (select *, least(greatest(0.1 + 0.1 * least(1, greatest(case when before_ > 0 then greatest(0, 1 - after_ / before_ / 0.3) else 0 end, case when reversed then 1 else 0 end)), 0.1), 0.2) as c from told where decelerated or reversed)
select video_id, take_id, 'save' as type, track_id as player_track_id, round(t_start, 6) as t_start, round(t_end, 6) as t_end, round(before_, 6) as peak_before, round(after_, 6) as peak_after, decelerated, reversed, round(c, 6)::double as confidence from sure where c >= 0.15"""

_lines, _inside = _ctes("e16_line_goals"), _ctes("e15_region_goals")
SQL["e18_goal_occurrences"] = BASE + _lines[0] + _inside[0] + """, shown as (select video_id, take_id, region, t, case when region = 0 and take_id % 3 > 0 then frame_index % 4 else 1 end as home, cast(floor(frame_index / 125) as bigint) as away
  from frames, (values (0), (1)) v(region) where frame_index % 5 = 0),
early_ as (select * from shown qualify row_number() over (partition by video_id, take_id, region order by t) <= 8),
chosen as (select video_id, take_id, min(region) as region from (select video_id, take_id, region from early_ group by video_id, take_id, region, home, away having count(*) >= 5) group by 1, 2),
ra as (select *, sum(case when score = was then 0 else 1 end) over (partition by video_id, take_id order by t) as run from (select video_id, take_id, t, home + away as score, lag(home + away) over (partition by video_id, take_id order by t) as was from shown join chosen using (video_id, take_id, region))),
rs as (select video_id, take_id, run, score, min(t) as t_first from ra group by 1, 2, 3, 4 having count(*) >= 2 or run = 1),
rf as (select *, lag(score) over (partition by video_id, take_id order by run) as prior from rs),
rg as (select *, lag(t_first) over w as came, lag(score) over w as was from rf where prior is null or prior <> score window w as (partition by video_id, take_id order by run))
select video_id, take_id, 'goal' as type, round(came, 6) as t_start, round(t_first, 6) as t_end, round(t_first, 6) as t_after, 0.75e0 as confidence, 'scoreboard' as source from rg where score = was + 1
union all select video_id, take_id, 'goal', t_start, t_end, t_end, 0.5e0, 'goal_line_crossing' from (""" + _lines[1] + """) where take_id % 2 = 0
union all select * from (""" + _inside[1] + ") where take_id % 2 = 1"

_FROM = "case when b.t > f.{0}t then sqrt(pow(b.x - f.{0}x, 2) + pow(b.y - f.{0}y, 2)) / (b.t - f.{0}t) / 1280 <= 10 else b.x = f.{0}x and b.y = f.{0}y end"
SQL["w13_plausible_balls"] = BASE + f""", jumpy as (select * replace (case when frame_index % 37 < 2 then x1 + 900 else x1 end as x1, case when frame_index % 37 < 2 then x2 + 900 else x2 end as x2) from balls),
bb as (select *, (x1 + x2) / 2 as x, (y1 + y2) / 2 as y, row_number() over (partition by video_id order by t, frame_index) as k from jumpy),
fold as (select video_id, k, t as l_t, x as l_x, y as l_y, [k] as kept, false as firm, []::bigint[] as doubt, t as d_t, x as d_x, y as d_y from bb where k = 1
  union all select n.video_id, n.k, case when ok or len(more) >= 5 then n.t else l_t end, case when ok or len(more) >= 5 then n.x else l_x end, case when ok or len(more) >= 5 then n.y else l_y end,
    case when ok then list_append(kept, n.k) when len(more) < 5 then kept when not firm and len(kept) = 1 then more else list_concat(kept, more) end, firm or ok or len(more) >= 5, case when ok or len(more) >= 5 then [] else more end, n.t, n.x, n.y
  from (select b.*, f.l_t, f.l_x, f.l_y, f.kept, f.firm, {_FROM.format("l_")} as ok, case when len(f.doubt) > 0 and {_FROM.format("d_")} then list_append(f.doubt, b.k) else [b.k] end as more
    from fold f join bb b on b.video_id = f.video_id and b.k = f.k + 1) n),
good as (select video_id, unnest(arg_max(kept, k)) as k from fold group by video_id)
select video_id, frame_index, round(t, 6) as t, take_id, round(x1, 6) as x1, round(y1, 6) as y1, round(x2, 6) as x2, round(y2, 6) as y2, round(conf, 6) as conf from bb join good using (video_id, k)"""
