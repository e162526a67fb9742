"""Registered queries over the derived tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..operators import events as ev
from ..operators import filters, goals, identity, possession, series, stats, timejoin
from ..sources import records
from . import adapters as ad

QUERIES: dict = {}
SQL: dict[str, str] = {}

WAVE = "abs(({n}) % 600 - 300)"
HOLDER = "(cast(floor(frame_index / 20) as bigint) % 12)"
BALL_X = f"(100 + 80 * {HOLDER} + {WAVE.format(n=f'frame_index * ({HOLDER} % 6 + 1)')} + (frame_index * 7) % 60 - 10)"
BALL_Y = f"(250 + 40 * ({HOLDER} % 5) + case when frame_index % 20 >= 12 then 300 else 0 end)"
BASE = f"""with recursive frames as (select event_id, cast(floor(event_id / 1500) as bigint) as video_id, event_id % 1500 as frame_index,
  cast(floor((event_id % 1500) / 250) as bigint) as take_id, (event_id % 1500) / 25e0 as t from events),
takes as (select video_id, take_id, min(t) as t_start, min(t) + 10e0 as t_end from frames group by 1, 2),
boxes as (select video_id, take_id, track_id, frame_index, t, cast(100 + 80 * track_id + {WAVE.format(n='frame_index * (track_id % 6 + 1)')} as double) as x1,
  cast(200 + 40 * (track_id % 5) as double) as y1, cast(140 + 80 * track_id + {WAVE.format(n='frame_index * (track_id % 6 + 1)')} as double) as x2,
  cast(300 + 40 * (track_id % 5) as double) as y2, (5 + track_id % 5) / 10e0 as conf
  from frames, (select unnest(range(12)) as track_id) where (frame_index + 7 * track_id) % 53 <> 0),
balls as (select video_id, take_id, frame_index, t, cast({BALL_X} - 5 as double) as x1, cast({BALL_Y} - 5 as double) as y1,
  cast({BALL_X} + 5 as double) as x2, cast({BALL_Y} + 5 as double) as y2, (2 + event_id % 8) / 10e0 as conf from frames where event_id % 11 <> 0),
smooth as (select *, avg((x1 + x2) / 2) over (partition by video_id, take_id, track_id order by t rows between 4 preceding and current row) as sx,
  avg((y1 + y2) / 2) over (partition by video_id, take_id, track_id order by t rows between 4 preceding and current row) as sy, y2 - y1 as h from boxes),
steps as (select *, t - lag(t) over w as d, (h + lag(h) over w) / 2 as m, sqrt(pow(sx - lag(sx) over w, 2) + pow(sy - lag(sy) over w, 2)) as dist
  from smooth window w as (partition by video_id, take_id, track_id order by t)),
speeds as (select video_id, take_id, track_id, frame_index, t, conf, coalesce(d, 0) as dt, case when d > 0 and m > 0 then round(dist / d / m, 9) else 0 end as speed from steps),
ranked as (select *, row_number() over (partition by video_id, take_id, track_id order by t) as rn from speeds),
hot as (select *, case when rn - lag(rn) over w > 1 and round(t - lag(t) over w, 9) >= 0.5 then 1 else 0 end as apart from ranked where speed >= 1.0
  window w as (partition by video_id, take_id, track_id order by t)),
runs_ as (select *, sum(apart) over (partition by video_id, take_id, track_id order by t) as run from hot),
segs as (select video_id, take_id, track_id, min(t) as t_start, max(t) as t_end from runs_ group by video_id, take_id, track_id, run having round(max(t) - min(t), 9) >= 1.0),
sprints as (select s.video_id, s.take_id, s.track_id as player_track_id, s.t_start, s.t_end, count(*) as n, avg(v.speed) as mean_speed, max(v.speed) as peak_speed,
  (0.5 * least(1.0, count(*) / (greatest(1.0, round_even((s.t_end - s.t_start) * 25, 0)) + 1)) + 0.5 * avg(v.conf)) * 0.5 as confidence
  from segs s join speeds v on s.video_id = v.video_id and s.take_id = v.take_id and s.track_id = v.track_id and v.t between s.t_start - 1e-9 and s.t_end + 1e-9
  group by 1, 2, 3, 4, 5),
near as (select b.video_id, b.take_id, b.frame_index, b.t, (b.x1 + b.x2) / 2 as x, (b.y1 + b.y2) / 2 as y, p.track_id, p.x1, p.y1, p.x2, p.y2,
  row_number() over (partition by b.video_id, b.take_id, b.frame_index, p.track_id order by round(abs(p.t - b.t), 9), p.t desc) as rn
  from balls b join boxes p on b.video_id = p.video_id and b.take_id = p.take_id and round(abs(p.t - b.t), 9) <= 0.15 where b.conf >= 0.3 and p.track_id <> 11),
dists as (select *, sqrt(pow(greatest(x1 - x, x - x2, 0), 2) + pow(greatest(y1 - y, y - y2, 0), 2)) as d from near where rn = 1),
nearest as (select *, row_number() over (partition by video_id, take_id, frame_index order by d, track_id) as best from dists),
series as (select b.video_id, b.take_id, b.frame_index, b.t, b.conf, case when n.d <= 70 then n.track_id end as track_id, n.d as dist
  from balls b left join nearest n on n.best = 1 and b.video_id = n.video_id and b.take_id = n.take_id and b.frame_index = n.frame_index where b.conf >= 0.3),
called as (select *, case when track_id = 10 then 9 else track_id end as identity from series where track_id is not null),
held as (select *, case when identity <> lag(identity) over w or round(t - lag(t) over w, 9) >= 0.5 then 1 else 0 end as fresh from called
  window w as (partition by video_id, take_id order by t)),
prun as (select *, sum(fresh) over (partition by video_id, take_id order by t) as run_id from held),
possruns as (select video_id, take_id, run_id, min(identity) as identity, min(t) as t_start, max(t) as t_end, count(*) as n, avg(dist) as mean_dist, max(track_id) as raw from prun group by 1, 2, 3),
poss as (select video_id, take_id, identity as player_track_id, raw, t_start, t_end, n, mean_dist, least(greatest((8 + identity % 3) / 10e0 * (0.5 * least(1.0, n / (greatest(1.0, round_even((t_end - t_start) * 25, 0)) + 1))
  + 0.5 * greatest(0, 1 - mean_dist / 70)), 0.1), 0.4) as confidence from possruns where round(t_end - t_start, 9) >= 0.3),
happened as (select video_id, take_id, player_track_id, 'sprint' as type, t_start, t_end, confidence from sprints where confidence >= 0.15
  union all select video_id, take_id, player_track_id, 'possession', t_start, t_end, confidence from poss where confidence >= 0.15)
"""


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = BASE + sql
        return f

    return wrap


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _happened(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["video_id", "take_id", "player_track_id", "type", "t_start", "t_end", "confidence"]
    sprints = ev.detect_sprints(ad.boxes(spark, sf_dir), ad.FPS)
    return sprints.select(*cols).unionByName(_possession(spark, sf_dir).select(*cols))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.possession_runs(_series(spark, sf_dir), ad.identities(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.possession_series(ad.balls(spark, sf_dir), ad.boxes(spark, sf_dir), tracks=ad.tracks(spark, sf_dir))


def _passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = series.ball_states(ad.balls(spark, sf_dir), ad.boxes(spark, sf_dir))
    return possession.detect_passes(_runs(spark, sf_dir), ad.tracks(spark, sf_dir), states, ad.FPS)


def _possession(spark: SparkSession, sf_dir: str) -> DataFrame:
    return possession.detect_possession(_runs(spark, sf_dir), ad.FPS)


@query("select video_id, player_track_id, count(*) as n_sprints, round(sum(mean_speed * (t_end - t_start)), 6) as sprint_distance, round(max(peak_speed), 6) as peak_speed, round(avg(confidence), 6) as mean_confidence from sprints where confidence >= 0.15 group by 1, 2")
def player_sprint_stats(spark, sf_dir):
    return rounded(stats.sprint_stats(ev.detect_sprints(ad.boxes(spark, sf_dir), ad.FPS)))


@query("select video_id, take_id, 'sprint' as type, player_track_id, round(t_start, 6) as t_start, round(t_end, 6) as t_end, n, round(mean_speed, 6) as mean_speed, round(peak_speed, 6) as peak_speed, round(confidence, 6) as confidence from sprints where confidence >= 0.15")
def e1_detect_sprints(spark, sf_dir):
    return rounded(ev.detect_sprints(ad.boxes(spark, sf_dir), ad.FPS))


@query("select video_id, take_id, track_id, frame_index, round(speed, 6) as speed from speeds")
def w3_track_speed(spark, sf_dir):
    return rounded(series.track_speed(ad.boxes(spark, sf_dir), 5).select("video_id", "take_id", "track_id", "frame_index", "speed"))


@query("select video_id, take_id, track_id, round(sum(speed * dt), 6) as distance, count(*) as n_samples from speeds group by 1, 2, 3")
def a5_distance_covered(spark, sf_dir):
    return rounded(stats.distance_covered(ad.boxes(spark, sf_dir)))


@query("select f.video_id, f.frame_index, round(f.t, 6) as t, k.take_id from frames f join takes k on f.video_id = k.video_id and f.t >= k.t_start and f.t < k.t_end")
def j1_assign_take(spark, sf_dir):
    points = ad.frames(spark, sf_dir).select("video_id", "frame_index", "t")
    return rounded(timejoin.assign_take(points, ad.takes(spark, sf_dir)))


@query("select video_id, take_id, frame_index, track_id, round(bt, 6) as near_t from (select b.video_id, b.take_id, b.frame_index, p.track_id, p.t as bt, row_number() over (partition by b.video_id, b.take_id, b.frame_index, p.track_id order by round(abs(p.t - b.t), 9), p.t desc) as rn from balls b join boxes p on b.video_id = p.video_id and b.take_id = p.take_id and round(abs(p.t - b.t), 9) <= 0.15) where rn = 1")
def j2_nearest_in_time(spark, sf_dir):
    left = ad.balls(spark, sf_dir).select("video_id", "take_id", "frame_index", "t")
    near = timejoin.nearest_in_time(left, ad.boxes(spark, sf_dir).select("video_id", "take_id", "track_id", "t"), 0.15, by=("track_id",))
    return rounded(near.select("video_id", "take_id", "frame_index", F.col("near.track_id").alias("track_id"), F.col("near.t").alias("near_t")))


@query("select video_id, take_id, frame_index, track_id, round(dist, 6) as dist from series")
def w7_possession_series(spark, sf_dir):
    return rounded(_series(spark, sf_dir).select("video_id", "take_id", "frame_index", "track_id", "dist"))


@query("select video_id, take_id, run_id::bigint as run_id, identity, round(t_start, 6) as t_start, round(t_end, 6) as t_end, n, round(mean_dist, 6) as mean_dist from possruns")
def w8_possession_runs(spark, sf_dir):
    return rounded(_runs(spark, sf_dir).select("video_id", "take_id", "run_id", "identity", "t_start", "t_end", "n", "mean_dist"))


@query("select video_id, take_id, player_track_id, round(t_start, 6) as t_start, round(t_end, 6) as t_end, n, round(mean_dist, 6) as mean_dist, round(confidence, 6) as confidence from poss where confidence >= 0.15")
def e5_detect_possession(spark, sf_dir):
    return rounded(_possession(spark, sf_dir).drop("type", "raw_track_ids"))


@query(""", bs as (select *, avg((x1 + x2) / 2) over w as sx, avg((y1 + y2) / 2) over w as sy from balls where conf >= 0.3 window w as (partition by video_id, take_id order by t rows between 2 preceding and current row)),
bv as (select *, sx - lag(sx) over w as dx0, t - lag(t) over w as d, sqrt(pow(sx - lag(sx) over w, 2) + pow(sy - lag(sy) over w, 2)) as dist, row_number() over w as rn from bs window w as (partition by video_id, take_id order by t)),
bw as (select *, case when d > 0 then round(dist / d / 1280, 9) else 0 end as speed, coalesce(dx0, 0) as dx from bv),
bh as (select *, case when rn - lag(rn) over w > 1 and round(t - lag(t) over w, 9) >= 0.3 then 1 else 0 end as apart from bw where speed >= 0.12 window w as (partition by video_id, take_id order by t)),
br as (select *, sum(apart) over (partition by video_id, take_id order by t) as run from bh),
bf as (select video_id, take_id, min(t) as t_start, max(t) as t_end, count(*) as n, max(speed) as peak, sum(dx) as dx, count(*) filter (dx > 0) as r, count(*) filter (dx < 0) as l from br group by video_id, take_id, run having round(max(t) - min(t), 9) >= 0.3),
bg as (select *, case when r + l > 0 then (case when dx >= 0 then r else l end) / (r + l) else 0 end as direction from bf)
select video_id, take_id, 'shot' as type, round(t_start, 6) as t_start, round(t_end, 6) as t_end, n, round(peak, 6) as peak_speed, round(direction, 6) as direction, round(least(greatest(0.15 + 0.1 * (peak - 0.12), 0.15), 0.4), 6) as confidence from bg where direction >= 0.7""")
def e2_detect_shots(spark, sf_dir):
    return rounded(ev.detect_shots(ad.balls(spark, sf_dir), ad.WIDTH))


@query(""", st as (select b.*, avg((x1 + x2) / 2) over w as x, avg((y1 + y2) / 2) over w as y from balls b where conf >= 0.3 window w as (partition by video_id, take_id order by t rows between 11 preceding and current row)),
sv as (select *, t - lag(t) over w as d, x - lag(x) over w as ex, y - lag(y) over w as ey from st window w as (partition by video_id, take_id order by t))
select video_id, take_id, frame_index, round(x, 6) as x, round(y, 6) as y, round(case when d > 0 and d <= 0.5 then ex / d / 100 else 0 end, 6) as vx, round(case when d > 0 and d <= 0.5 then ey / d / 100 else 0 end, 6) as vy, coalesce(d > 0 and d <= 0.5, true) as known from sv""")
def w6_ball_states(spark, sf_dir):
    out = series.ball_states(ad.balls(spark, sf_dir), ad.boxes(spark, sf_dir))
    return rounded(out.select("video_id", "take_id", "frame_index", "x", "y", "vx", "vy", "known"))


@query("select video_id, player_track_id, type, count(*) as n, round(avg(confidence), 6) as mean_confidence from happened group by 1, 2, 3")
def a3_player_stats(spark, sf_dir):
    return rounded(stats.player_stats(_happened(spark, sf_dir)))


@query("select video_id, player_track_id, count(*) filter (type = 'sprint') as n_sprint, count(*) filter (type = 'possession') as n_possession, round(sum(case when type = 'possession' then t_end - t_start else 0 end), 6) as possession_s from happened group by 1, 2")
def a8_stat_card(spark, sf_dir):
    return rounded(stats.stat_card(_happened(spark, sf_dir), ("sprint", "possession")))


@query("select *, row_number() over (partition by video_id, player_track_id order by rank_score desc, t_start, type) as rank from (select video_id, take_id, player_track_id, type, round(t_start, 6) as t_start, round(t_end, 6) as t_end, round(confidence, 6) as confidence, round(case when type = 'sprint' then 20 else 0 end * (1 + 0.5 * round(confidence, 6)), 6) as rank_score from happened)")
def r1_rank_events(spark, sf_dir):
    return rounded(stats.rank_events(rounded(_happened(spark, sf_dir))))


@query()
def r3_dedupe_clips(spark, sf_dir):
    ranked = stats.rank_events(rounded(_happened(spark, sf_dir)))
    return rounded(stats.select_export(stats.dedupe_clips(stats.clip_ranges(ranked, ad.takes(spark, sf_dir)))))


@query("select h.video_id, h.take_id, h.type, h.player_track_id, round(greatest(h.t_start - 3, k.t_start), 6) as clip_start, round(least(h.t_end + 2, k.t_end), 6) as clip_end from happened h join takes k using (video_id, take_id)")
def r2_clip_ranges(spark, sf_dir):
    out = stats.clip_ranges(_happened(spark, sf_dir), ad.takes(spark, sf_dir))
    return rounded(out.select("video_id", "take_id", "type", "player_track_id", "clip_start", "clip_end"))


@query()
def e4_detect_touches(spark, sf_dir):
    return rounded(_touches(spark, sf_dir))


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    balls, boxes = ad.balls(spark, sf_dir), ad.boxes(spark, sf_dir)
    return possession.detect_touches(balls, boxes, series.ball_states(balls, boxes), tracks=ad.tracks(spark, sf_dir), identities=ad.identities(spark, sf_dir))


@query()
def e7_e8_passes_turnovers(spark, sf_dir):
    return rounded(_passes(spark, sf_dir))


@query()
def e10_detect_tackles(spark, sf_dir):
    boxes, balls = ad.boxes(spark, sf_dir), ad.balls(spark, sf_dir)
    return rounded(possession.detect_tackles(_runs(spark, sf_dir), boxes, balls, ad.tracks(spark, sf_dir), ad.FPS))


@query()
def j9_turnovers_without_tackles(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    tackles = possession.detect_tackles(runs, ad.boxes(spark, sf_dir), ad.balls(spark, sf_dir), ad.tracks(spark, sf_dir), ad.FPS)
    lost = _passes(spark, sf_dir).where("type = 'turnover'")
    return rounded(possession.without_tackled_turnovers(lost, tackles))


@query()
def p7_pass_rejects(spark, sf_dir):
    return possession.drop_counts(_passes(spark, sf_dir), "passes")


def _detections(spark, sf_dir):
    return ad.boxes(spark, sf_dir).withColumn("tracker_id", F.expr("track_id + 20 * cast(floor(frame_index / 50) as bigint)")).withColumn("cls", F.expr("case when frame_index % 9 = 0 then 'referee' else 'player' end")).drop("track_id")


TRACKLETS = """, dets as (select *, track_id + 20 * cast(floor(frame_index / 50) as bigint) as tid, case when frame_index % 9 = 0 then 'referee' else 'player' end as cls from boxes)"""


@query(TRACKLETS + """, votes as (select video_id, take_id, tid, cls, row_number() over (partition by video_id, take_id, tid order by count(*) desc, min(frame_index)) as rn from dets group by 1, 2, 3, 4)
select d.video_id, d.take_id, d.tid as track_id, round(min(t), 6) as t_start, round(max(t), 6) as t_end, count(*) as n_boxes, round(avg(conf), 6) as mean_conf, any_value(v.cls) as dominant_class from dets d join votes v on v.rn = 1 and d.video_id = v.video_id and d.take_id = v.take_id and d.tid = v.tid group by 1, 2, 3""")
def t1_assemble_tracks(spark, sf_dir):
    return rounded(identity.assemble_tracks(_detections(spark, sf_dir)).drop("first", "last"))


@query()
def t6_stitch_identities(spark, sf_dir):
    return rounded(identity.stitch_identities(identity.assemble_tracks(_detections(spark, sf_dir))))


@query("""select video_id, player_track_id, round(sum(e - s), 6) as coverage from (select video_id, player_track_id, i, min(t_start) as s, max(t_end) as e from (select *, sum(case when t_start <= before then 0 else 1 end) over (partition by video_id, player_track_id order by t_start, t_end) as i
from (select *, max(t_end) over (partition by video_id, player_track_id order by t_start, t_end rows between unbounded preceding and 1 preceding) as before from happened)) group by 1, 2, 3) group by 1, 2""")
def t12_coverage_seconds(spark, sf_dir):
    return rounded(identity.coverage_seconds(_happened(spark, sf_dir), ("video_id", "player_track_id")))


SQL_VOTES = """with reads as (select cast(l_suppkey as bigint) as take_id, cast(l_partkey % 4 as bigint) as track_id, case when l_linenumber = 7 then null else cast(l_linenumber % 5 as varchar) end as digits, l_linenumber / 10e0 as confidence from lineitem),
v as (select take_id, track_id, digits, count(*) as n, avg(confidence) as mean from reads where digits is not null group by 1, 2, 3),
r as (select *, (sum(n) over w)::bigint as every, max(n) over w as most from v window w as (partition by take_id, track_id)),
k as (select take_id, track_id, min(digits) as digits, max(n) as n_reads, max(every) as every, count(*) as ties, arg_min(mean, digits) as mean from r where n = most group by 1, 2),
g as (select *, n_reads / every as agreement, ties = 1 and n_reads >= 2 and n_reads / every >= 0.4 and 0.5 * n_reads / every + 0.5 * mean >= 0.3 as good from k)
select take_id, track_id, case when good then digits end as jersey_number, case when good then 'verified' else 'unverified' end as status, round(agreement, 6) as agreement, round(case when good then 0.5 * agreement + 0.5 * mean else 0 end, 6) as confidence, n_reads from g"""


@query()
def t13_digit_votes(spark, sf_dir):
    return rounded(identity.digit_votes(ad.digit_reads(spark, sf_dir), ("take_id", "track_id")))


SQL["t13_digit_votes"] = SQL_VOTES


@query(""", seen as (select f.video_id, f.frame_index, f.t, b.x1, b.conf from frames f left join balls b using (video_id, take_id, frame_index)),
ab as (select *, last_value(case when x1 is not null then frame_index end ignore nulls) over (partition by video_id order by frame_index rows between unbounded preceding and current row) as fa,
 last_value(case when x1 is not null then frame_index end ignore nulls) over (partition by video_id order by frame_index desc rows between unbounded preceding and current row) as fb from seen)
select s.video_id, s.frame_index, round(a.x1 + case when fb = fa then 0 else (s.frame_index - fa) / (fb - fa) * (b.x1 - a.x1) end, 6) as x1, round(case when fb = fa then a.conf else (a.conf + b.conf) / 2 * 0.5 end, 6) as conf, fb > fa as interpolated
from ab s join seen a on a.video_id = s.video_id and a.frame_index = fa join seen b on b.video_id = s.video_id and b.frame_index = fb where fb - fa <= 15""")
def w14_interpolate_ball(spark, sf_dir):
    out = series.interpolate_ball(ad.frames(spark, sf_dir).select("video_id", "frame_index", "t"), ad.balls(spark, sf_dir))
    return rounded(out.select("video_id", "frame_index", "x1", "conf", "interpolated"))


@query("select g.video_id, g.player_track_id, g.type, g.frame_index, count(h.t_start) as n from (select f.video_id, f.frame_index, f.t, k.player_track_id, k.type from frames f join (select distinct video_id, player_track_id, type from happened) k using (video_id)) g left join happened h on h.video_id = g.video_id and h.player_track_id = g.player_track_id and h.type = g.type and h.t_start <= g.t group by 1, 2, 3, 4")
def w16_running_counts(spark, sf_dir):
    happened, keys = _happened(spark, sf_dir), ("video_id", "player_track_id", "type")
    grid = ad.frames(spark, sf_dir).select("video_id", "t").join(happened.select(*keys).distinct(), "video_id")
    out = series.running_counts(grid, happened, keys)
    return out.select(*keys, F.round(F.col("t") * 25).cast("long").alias("frame_index"), "n")


CUTS = """, vids as (select video_id, count(*) as nb from frames group by 1), st as (select distinct video_id, frame_index as f from frames where frame_index % 200 = 0)
select video_id, (row_number() over w - 1) as take_id, round(f / 25e0, 6) as t_start, round(coalesce(lead(f) over w, nb) / 25e0, 6) as t_end from st join vids using (video_id) window w as (partition by video_id order by f)"""


@query(CUTS)
def w20_takes_from_cuts(spark, sf_dir):
    frames = ad.frames(spark, sf_dir)
    videos = frames.groupBy("video_id").agg(F.count("*").cast("int").alias("nb_frames")).withColumn("fps", F.lit(ad.FPS))
    cuts = frames.where("frame_index % 200 = 0").select("video_id", F.col("frame_index").cast("int").alias("frame"))
    out = series.takes_from_cuts(cuts, videos)
    return rounded(out.select("video_id", F.col("take_id").cast("long").alias("take_id"), "t_start", "t_end"))


@query("select a.video_id, a.take_id, a.player_track_id, round(a.t_start, 6) as t_start, b.player_track_id as other, round(b.t_start, 6) as other_start from sprints a join poss b on a.video_id = b.video_id and a.take_id = b.take_id and a.t_end > b.t_start and a.t_start < b.t_end where a.confidence >= 0.15 and b.confidence >= 0.15")
def j6_interval_overlap(spark, sf_dir):
    sprints = ev.detect_sprints(ad.boxes(spark, sf_dir), ad.FPS).select("video_id", "take_id", "player_track_id", "t_start", "t_end")
    pairs = timejoin.overlaps(sprints, _possession(spark, sf_dir).select("video_id", "take_id", "player_track_id", "t_start", "t_end"))
    return rounded(pairs.select("video_id", "take_id", "player_track_id", "t_start", F.col("b_player_track_id").alias("other"), F.col("b_t_start").alias("other_start")))


@query("select b.video_id, b.take_id, b.frame_index, round(max(case when s.t_end <= b.t and b.t - s.t_end <= 3 then s.t_end end), 6) as t_before from balls b left join poss s on b.video_id = s.video_id and b.take_id = s.take_id and s.confidence >= 0.15 group by 1, 2, 3")
def j7_asof_backward(spark, sf_dir):
    ends = _possession(spark, sf_dir).select("video_id", "take_id", F.col("t_end").alias("t"))
    balls = ad.balls(spark, sf_dir).select("video_id", "take_id", "frame_index", "t")
    return rounded(timejoin.asof_backward(balls, ends, 3.0).drop("t"))


@query("select video_id, take_id, player_track_id, type, round(t_start, 6) as t_start from happened h where not exists (select 1 from frames f where f.frame_index % 300 = 0 and f.video_id = h.video_id and abs(f.t - h.t_start) <= 1.0)")
def j10_suppress_near_manual(spark, sf_dir):
    manual = ad.frames(spark, sf_dir).where("frame_index % 300 = 0").select("video_id", "t")
    out = timejoin.drop_near(_happened(spark, sf_dir), manual, 1.0)
    return rounded(out.select("video_id", "take_id", "player_track_id", "type", "t_start"))


@query("select video_id, frame_index, track_id, round((x1 + x2) / 2, 6) as cx, round((y1 + y2) / 2, 6) as cy, round((x2 - x1) * (y2 - y1), 6) as area from boxes where not ((x1 + x2) / 2 / 1280 between 0.2 and 0.4 and (y1 + y2) / 2 / 720 between 0.3 and 0.5)")
def p4_filter_roi(spark, sf_dir):
    out = filters.filter_roi(ad.boxes(spark, sf_dir), (0.2, 0.3, 0.4, 0.5), ad.WIDTH, 720.0)
    return rounded(out.select("video_id", "frame_index", "track_id", g.cx().alias("cx"), g.cy().alias("cy"), g.area().alias("area")))


@query()
def x1_annotations(spark, sf_dir):
    return rounded(ad.annotation_lines(spark, sf_dir).where(~text.skipped(F.col("line"))).select("line_no", text.annotation(F.col("line")).alias("a")).where("a is not null").select("line_no", "a.*"))


SQL["x1_annotations"] = """select event_id as line_no, cast((event_id % 90) * 60 + event_id % 60 as double) as t, cast(event_id % 30 as int) as jersey_number,
case when event_id % 2 = 0 then 'white' else 'unspecified' end as team_colour, 'makes a ' || event_type as action_phrase, 'key_moment' as event_type from events where event_id % 3 = 0"""


@query()
def w10_debounce(spark, sf_dir):
    rows = ad._read(spark, sf_dir, "events").selectExpr("user_id", "event_id * 0.5D as t")
    return rounded(series.debounced(rows, 60.0, ["user_id"]))


SQL["w10_debounce"] = """with recursive e as (select user_id, event_id * 0.5e0 as t from events), d as (select user_id, min(t) as t from e group by 1
 union all select d.user_id, (select min(e.t) from e where e.user_id = d.user_id and e.t - d.t >= 60) as t from d where d.t is not null)
select user_id, round(t, 6) as t from d where t is not null"""


@query(""", rd as (select video_id, take_id, t, cast(floor(frame_index / 40) as int) + case when frame_index % 17 = 0 then 1 else 0 end as score from frames),
ra as (select *, sum(case when score = before then 0 else 1 end) over (partition by video_id, take_id order by t) as run from (select *, lag(score) over (partition by video_id, take_id order by t) as before from rd)),
rs as (select video_id, take_id, run, score, min(t) as t_first from ra group by 1, 2, 3, 4 having count(*) >= 2 or run = 1),
rf as (select *, lag(score) over (partition by video_id, take_id order by run) as prior from rs),
rg as (select *, lag(t_first) over w as came, lag(score) over w as was from rf where prior is null or prior <> score window w as (partition by video_id, take_id order by run))
select video_id, take_id, round(came, 6) as t_before, round(t_first, 6) as t_after, score from rg where score = was + 1""")
def e14_score_increments(spark, sf_dir):
    rows = ad.frames(spark, sf_dir).selectExpr("video_id", "take_id", "t", "cast(floor(frame_index / 40) as int) + if(frame_index % 17 = 0, 1, 0) as score")
    return rounded(ev.score_increments(rows))


@query(""", k as (select video_id, count(*) - 1 as n_cuts from takes group by 1), v as (select video_id, count(*) / 25e0 as duration from frames group by 1), m as (select video_id, round(quantile_cont(sqrt(pow(frame_index % 9, 2) + 16), 0.5), 4) as motion_score from frames group by 1)
select video_id, n_cuts, round(n_cuts * 60 / duration, 4) as cuts_per_min, motion_score, case when round(n_cuts * 60 / duration, 4) >= 3 then 'broadcast' when motion_score < 1.5 then 'single-static' when motion_score > 6 then 'single-panning' when motion_score - 1.5 <= 6 - motion_score then 'single-static' else 'single-panning' end as profile from k join v using (video_id) join m using (video_id)""")
def p8_source_profile(spark, sf_dir):
    frames = ad.frames(spark, sf_dir)
    videos = frames.groupBy("video_id").agg((F.count("*") / 25.0).alias("duration")).withColumns({"width": F.lit(1280), "height": F.lit(720)})
    motion = frames.select("video_id", (F.col("frame_index") % 9).alias("tx"), F.lit(4.0).alias("ty"))
    profile, _, _ = filters.source_profile()
    out = stats.video_profile(ad.takes(spark, sf_dir), videos, motion).withColumn("profile", profile)
    return out.select("video_id", "n_cuts", "cuts_per_min", "motion_score", "profile")


@query(""", v as (select video_id, count(*) / 25e0 as duration from frames group by 1), c as (select video_id, duration, unnest(range(cast(ceil(duration / 7) as bigint))) as chunk_id from v)
select video_id, chunk_id, chunk_id * 35 + i as index, round(chunk_id * 7 + i / 5e0, 6) as t from (select video_id, chunk_id, unnest(range(cast(round_even(least(7, duration - chunk_id * 7) * 5, 0) as bigint))) as i from c)""")
def s6_frame_manifest(spark, sf_dir):
    videos = ad.frames(spark, sf_dir).groupBy("video_id").agg((F.count("*") / 25.0).alias("duration"))
    return rounded(records.frame_manifest(videos, 5.0, 7.0))


@query("select video_id, frame_index, round(x1 + 640 * 0, 6) as x1, round(conf, 6) as conf from (select video_id, frame_index, x1 + (track_id % 3) * 10 as x1, conf, row_number() over (partition by video_id, frame_index order by conf desc, x1 + (track_id % 3) * 10, y1) as rn from boxes) where rn = 1")
def w25_best_ball_per_frame(spark, sf_dir):
    tiles = ad.boxes(spark, sf_dir).withColumns({"tile_x": (F.col("track_id") % 3) * 10, "tile_y": F.lit(0)})
    return rounded(filters.best_ball_per_frame(tiles).select("video_id", "frame_index", "x1", "conf"))


@query()
def w24_suppress_overlaps(spark, sf_dir):
    rows = ad.boxes(spark, sf_dir).withColumn("cls", F.lit("player"))
    return rounded(filters.suppress_overlaps(rows, 0.1))


@query("select f.video_id, f.frame_index, h.player_track_id, h.type, round(h.t_start, 6) as t_start, round((f.t - h.t_start) / (h.t_end - h.t_start), 6) as elapsed from frames f join happened h on f.video_id = h.video_id and f.t between h.t_start and h.t_end")
def w17_active_events(spark, sf_dir):
    grid = ad.frames(spark, sf_dir).select("video_id", "frame_index", "t")
    found = timejoin.active_events(grid, _happened(spark, sf_dir))
    return rounded(found.select("video_id", "frame_index", F.col("e_player_track_id").alias("player_track_id"), F.col("e_type").alias("type"), F.col("e_t_start").alias("t_start"), "elapsed"))


@query(""", pts as (select video_id, take_id, frame_index, t, x1 from balls where frame_index % 5 = 0)
select f.video_id, f.take_id, f.frame_index, round(arg_max(b.t, b.t) filter (b.t <= f.t), 6) as t_before, round(arg_min(b.t, b.t) filter (b.t >= f.t), 6) as t_after from frames f left join pts b on f.video_id = b.video_id and f.take_id = b.take_id group by 1, 2, 3""")
def j5_bracket(spark, sf_dir):
    samples = ad.balls(spark, sf_dir).where("frame_index % 5 = 0").select("video_id", "take_id", "t", "x1")
    grid = ad.frames(spark, sf_dir).select("video_id", "take_id", "frame_index", "t")
    out = timejoin.bracket(grid, samples, ("x1",))
    return rounded(out.select("video_id", "take_id", "frame_index", F.col("before.t").alias("t_before"), F.col("after.t").alias("t_after")))


@query()
def e19_attribute_goals(spark, sf_dir):
    rows = ad.frames(spark, sf_dir).selectExpr("video_id", "take_id", "t", "cast(floor(frame_index / 40) as int) as score")
    scored = ev.score_increments(rows).select("video_id", "take_id", "t_after", F.lit(goals.GOAL["occurrence"]).alias("confidence"))
    return rounded(goals.attribute_goals(scored, _possession(spark, sf_dir), ad.tracks(spark, sf_dir)))
