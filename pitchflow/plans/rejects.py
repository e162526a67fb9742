"""What the detectors of a take rejected, and the evidence of what they kept, out of one table of candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, flow
from . import adapters as ad
from .proofs import TOUCHES
from .queries import query, rounded
from .whole import _dribbles, _inner, _saves, _shots, _turned

_fast = _shots[: _shots.rindex("select video_id, take_id, 'shot'")]
_saved = _saves[: _saves.rindex("select video_id, take_id, 'save'")]
_runs = _turned[: _turned.rindex("select video_id, take_id, type, passer")]
_NAMES = " ".join(f"when reject = '{k}' then '{v}'" for k, v in flow.PASS_REASONS.items() if k != "turnover_disabled")
_COVERED = """(select 1 from tackles k where k.confidence >= 0.15 and k.video_id = p.video_id and k.take_id = p.take_id
  and k.tackler = p.receiver_track and k.tackled = p.passer_track and abs(p.t_end - k.t_end) <= 0.5)"""
_EDGES = "(select count(*) from dedge e where e.rn = 1 and e.video_id = d.video_id and e.take_id = d.take_id and e.run_id = d.run_id)"
_CLOSE = """(select * from (select m.video_id, m.take_id, m.t_start, sqrt(pow((b.x1 + b.x2) / 2 - m.x, 2) + pow((b.y1 + b.y2) / 2 - m.y, 2)) as dist,
  row_number() over (partition by m.video_id, m.take_id, m.t_start, b.track_id order by round(abs(b.t - m.t_fast), 9), b.t desc) as rn
  from moved m join boxes b on b.track_id in (0, 6) and b.video_id = m.video_id and b.take_id = m.take_id and round(abs(b.t - m.t_fast), 9) <= 0.15) where rn = 1 and dist <= 300)"""


def _counted(parts: str, *counts: tuple[str, str]) -> str:
    """(reason, n) of each (reason, rows) out of the parts of a query."""
    return _inner(parts, " union all ".join(f"select '{reason}' as reason, count(*) as n from {rows}" for reason, rows in counts))


def _is(a: str, b: str, *more: str) -> str:
    return " and ".join(f"{a}.{c} = {b}.{c}" for c in ("video_id", "take_id", *more))


_TOUCHED = f"""select case when exists (select 1 from touches h where {_is("h", "n", "id")} and h.t < n.t and round(n.t - h.t, 9) < 0.3) then 'touch_debounced'
  when k.t is null then 'touch_no_contact_evidence' else 'touch_below_min_emit_confidence' end, count(*)
  from near40 n left join kicked k using (video_id, take_id, t) where not exists (select 1 from touches h where {_is("h", "n", "id")} and h.t = n.t) group by 1"""
_TACKLED = """select case when round(bs - e, 9) not between 0 and 1.5 then 'tackle_gap_too_large' when lt = 9 or bt = 9 then 'tackle_team_confidence_too_low' else 'tackle_same_team_not_opponent' end, count(*)
  from rpair where bid <> id and (round(bs - e, 9) not between 0 and 1.5 or lt = 9 or bt = 9 or lt % 2 = bt % 2) group by 1
  union all select 'tackle_insufficient_closing_speed', (select count(*) from won) - (select count(*) from tackles) union all select 'tackle_below_min_emit_confidence', count(*) from tackles where confidence < 0.15"""
_dribbled = _counted(
    _dribbles("prun"),
    ("dribble_no_box_near_interval_edge", f"dr d where {_EDGES} < 2"),
    ("dribble_insufficient_travel", f"dr d where {_EDGES} = 2 and not exists (select 1 from dlong l where {_is('l', 'd', 'run_id')})"),
    ("dribble_not_contested", f"dlong l where not exists (select 1 from dmet m where {_is('m', 'l', 'run_id')})"),
    ("dribble_below_min_emit_confidence", "dribbles where c < 0.15"),
)
_kept_out = _counted(
    _saved,
    ("save_no_fast_ball_approach", f"takes t where not exists (select 1 from bf f where {_is('f', 't')})"),
    ("save_approach_not_near_goalkeeper", f"moved m where not exists (select 1 from {_CLOSE} q where {_is('q', 'm', 't_start')})"),
    ("save_no_reaction_window", f"moved m where t_end is null and exists (select 1 from {_CLOSE} q where {_is('q', 'm', 't_start')})"),
    ("save_no_deceleration_or_reversal", "told where not decelerated and not reversed"),
    ("save_below_min_emit_confidence", "sure where c < 0.15"),
)
REJECTS = f""", reasons as (select 'sprint_below_min_emit_confidence' as reason, count(*) as n from sprints where confidence < 0.15
  union all select 'shot_direction_inconsistent', count(*) from {_inner(_fast, "select 1 from bg where direction < 0.7")}
  union all select 'touch_ball_conf_too_low', count(*) from balls where conf < 0.3
  union all select case when n.d is null then 'touch_no_track_near_ball_in_time' else 'touch_ball_too_far_from_any_player' end, count(*)
    from balls b left join nearest n on n.best = 1 and b.video_id = n.video_id and b.take_id = n.take_id and b.frame_index = n.frame_index where b.conf >= 0.3 and (n.d is null or n.d > 40) group by 1
  union all select * from {_inner(TOUCHES, _TOUCHED)}
  union all select 'possession_run_below_min_duration', count(*) from possruns where round(t_end - t_start, 9) < 0.3
  union all select 'possession_below_min_emit_confidence', count(*) from poss where confidence < 0.15
  union all select * from {_dribbled}
  union all select * from {_inner(_runs, f"select case {_NAMES} when same then 'pass_below_min_emit_confidence' else 'turnover_below_min_emit_confidence' end, count(*) from fold where reject is not null group by 1")}
  union all select '{flow.COVERED}', count(*) from {_inner(_runs, f"select 1 from passes p where type = 'turnover' and exists {_COVERED}")}
  union all select * from {_inner(_runs, _TACKLED)}
  union all select * from {_kept_out})
select split_part(reason, '_', 1) as stage, reason, n::bigint as n from reasons where n > 0"""


def _given(spark, sf_dir) -> tuple:
    return ad.balls(spark, sf_dir), ad.boxes(spark, sf_dir), ad.tracks(spark, sf_dir), ad.identities(spark, sf_dir), ad.WIDTH, ad.FPS


@query(REJECTS)
def p7_flow_rejects(spark, sf_dir):
    return flow.take_rejects(*_given(spark, sf_dir))


_DELTA = f"""select h.*, (select sqrt(pow(a.vx - b.vx, 2) + pow(a.vy - b.vy, 2)) from sides a join sides b using (video_id, take_id, t)
  where a.s = -1 and b.s = 1 and a.rn = 1 and b.rn = 1 and {_is("a", "h", "t")}) as dv from touches h"""
_BALL = f"""select video_id, take_id, type, t_start, passer_track, receiver_track, travel, null, round(t_end - t_start, 9), null, case when type = 'turnover' then passer_track % 2 end, case when type = 'pass' then kicked end
  from passes p where type = 'pass' or type = 'turnover' and not exists {_COVERED}
  union all select video_id, take_id, type, t_start, tackler, tackled, null, closing_speed, (select min(round(bs - e, 9)) from rpair q where {_is("q", "k")} and q.bs = k.t_end), null, null, null from tackles k where confidence >= 0.15"""
SPOKEN = f""", spoken as (
  select video_id, take_id, 'sprint' as type, t_start, player_track_id as track_id, null::bigint as other_track_id, null::double as distance, peak_speed as speed, null::double as gap, mean_speed as second, n, null::boolean as sure
    from sprints where confidence >= 0.15
  union all select video_id, take_id, 'shot', t_start, null, null, null, peak, null, direction, null, null from {_inner(_fast, "select * from bg where direction >= 0.7")}
  union all select video_id, take_id, 'touch', t, raw, null, dist, null, null, dv, null, null from {_inner(TOUCHES, _DELTA)}
  union all select video_id, take_id, 'possession', t_start, null, null, mean_dist, null, null, null, n, null from poss where confidence >= 0.15
  union all select video_id, take_id, 'dribble', s, null, null, travel, null, null, null, null, true from {_inner(_dribbles("prun"), "select * from dribbles where c >= 0.15")}
  union all select * from {_inner(_runs, _BALL)}
  union all select video_id, take_id, 'save', t_start, track_id, null, null, before_, null, after_, null, decelerated from {_inner(_saved, "select * from sure where c >= 0.15")})
select video_id, take_id, type, round(t_start, 6) as t_start, track_id, other_track_id, {", ".join(f"round({c}, 6)::double as {c}" for c in ("distance", "speed", "gap", "second"))}, n::bigint as n, sure from spoken"""


@query(SPOKEN)
def x8_event_evidence(spark, sf_dir):
    """Each event of the one table with the evidence of its type read back as columns."""
    read = lambda kind, *of: F.coalesce(*[evidence.field(event, name).cast(kind) for event, name in of])
    found = flow.take_events(*_given(spark, sf_dir))
    return rounded(found.select(
        "video_id", "take_id", "type", "t_start",
        read("bigint", ("pass", "passer_raw_track_id"), ("turnover", "losing_raw_track_id"), ("touch", "raw_track_id"), ("tackle", "tackler_raw_track_id"), ("sprint", "track_id"), ("save", "goalkeeper_track_id")).alias("track_id"),
        read("bigint", ("pass", "receiver_raw_track_id"), ("turnover", "receiving_raw_track_id"), ("tackle", "tackled_raw_track_id")).alias("other_track_id"),
        read("double", ("pass", "ball_travel_px"), ("turnover", "ball_travel_px"), ("dribble", "travel_bbox_heights"), ("touch", "distance_px"), ("possession", "mean_distance_px")).alias("distance"),
        read("double", ("sprint", "peak_speed"), ("shot", "peak_speed"), ("tackle", "closing_speed"), ("save", "peak_speed_before")).alias("speed"),
        read("double", ("pass", "gap_s"), ("turnover", "gap_s"), ("tackle", "gap_s")).alias("gap"),
        read("double", ("touch", "ball_velocity_delta"), ("sprint", "mean_speed"), ("shot", "direction_consistency"), ("save", "peak_speed_after")).alias("second"),
        read("bigint", ("sprint", "n_boxes_in_window"), ("possession", "n_ball_samples"), ("turnover", "losing_team")).alias("n"),
        read("boolean", ("pass", "kick_verified"), ("dribble", "contested"), ("save", "decelerated")).alias("sure"),
    ))
