"""Registered queries over the whole event flow, typed events, crops, chains and metadata texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..config import PHRASES
from ..functions import geometry as g
from ..functions import text
from ..operators import events as ev
from ..operators import filters, flow, goals, identity, manual, memory, possession, stats, target, timejoin
from . import adapters as ad
from .proofs import TOUCHES
from .queries import BASE, QUERIES, SQL, _happened, _passes, _possession, _touches, query, rounded

HEIGHT = 720


def _inner(sql: str, rows: str) -> str:
    """A query's SQL as a part of a larger one that begins with BASE."""
    return "(with recursive " + sql.lstrip(", ") + "\n" + rows + ")"


def _dribbles(runs: str) -> str:
    """Dribbles out of samples with run_id; track 9 has no sure team, track 11 is the referee."""
    near = "round(abs(b.t - {0}), 9)"
    return f""", dr as (select video_id, take_id, run_id, min(identity) as id, min(t) as s, max(t) as e, count(*) as n, avg(dist) as md, arg_min(track_id, t) as ft, arg_max(track_id, t) as lt, string_agg(distinct track_id::varchar, ',' order by track_id::varchar) as acting
  from {runs} group by 1, 2, 3 having round(max(t) - min(t), 9) >= 1.0),
dends as (select d.video_id, d.take_id, d.run_id, side, case when side = 0 then ft else lt end as tr, case when side = 0 then s else e end as at_ from dr d cross join (values (0), (1)) v(side)),
dedge as (select d.*, (b.x1 + b.x2) / 2 as x, (b.y1 + b.y2) / 2 as y, b.y2 - b.y1 as h, row_number() over (partition by d.video_id, d.take_id, d.run_id, side order by {near.format('at_')}, b.t desc) as rn
  from dends d join boxes b on b.video_id = d.video_id and b.take_id = d.take_id and b.track_id = d.tr and {near.format('at_')} <= 0.15),
dlong as (select d.*, sqrt(pow(a.x - z.x, 2) + pow(a.y - z.y, 2)) / ((a.h + z.h) / 2) as travel from dr d join dedge a on a.video_id = d.video_id and a.take_id = d.take_id and a.run_id = d.run_id and a.side = 0 and a.rn = 1
  join dedge z on z.video_id = d.video_id and z.take_id = d.take_id and z.run_id = d.run_id and z.side = 1 and z.rn = 1 where travel >= 1.0),
dplace as (select p.video_id, p.take_id, p.run_id, p.track_id, p.t, row_number() over (partition by p.video_id, p.take_id, p.run_id order by p.t, p.frame_index) - 1 as place, count(*) over (partition by p.video_id, p.take_id, p.run_id) as n
  from {runs} p join dlong d on d.video_id = p.video_id and d.take_id = p.take_id and d.run_id = p.run_id),
dnear as (select s.video_id, s.take_id, s.run_id, s.t, s.track_id as own, b.track_id, (b.x1 + b.x2) / 2 as x, (b.y1 + b.y2) / 2 as y, b.y2 - b.y1 as h, row_number() over (partition by s.video_id, s.take_id, s.run_id, s.t, b.track_id order by {near.format('s.t')}, b.t desc) as rn
  from (select * from dplace where place % greatest(1, cast(floor(n / 20) as bigint)) = 0) s join boxes b on b.video_id = s.video_id and b.take_id = s.take_id and b.track_id <> 9 and {near.format('s.t')} <= 0.15),
dmet as (select distinct a.video_id, a.take_id, a.run_id from dnear a join dnear b using (video_id, take_id, run_id, t) where a.rn = 1 and b.rn = 1 and a.track_id = a.own and b.track_id <> a.own and b.track_id <> 11 and a.track_id % 2 <> b.track_id % 2
  and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / ((a.h + b.h) / 2) <= 2.0),
dribbles as (select d.*, least(greatest((8 + id % 3) / 10e0 * (0.5 * least(1.0, n / (greatest(1.0, round_even((e - s) * 25, 0)) + 1)) + 0.5 * greatest(0, 1 - md / 70)), 0.1), 0.35) as c from dlong d join dmet using (video_id, take_id, run_id))"""


_at, _to = BASE.index("near as ("), BASE.index("possruns as (")
CARRIED = """, carried as (select video_id, take_id, frame_index, t, (x1 + x2) / 2 - 5 as x1, (y1 + y2) / 2 - 5 as y1, (x1 + x2) / 2 + 5 as x2, (y1 + y2) / 2 + 5 as y2, conf from boxes where track_id = take_id % 10 + 1), """ + re.sub(
    r"\b(near|dists|nearest|series|called|held|prun)\b", r"\g<1>_c", BASE[_at:_to].rstrip().rstrip(",")).replace("from balls b", "from carried b")
SQL["e9_detect_dribbles"] = BASE + CARRIED + _dribbles("prun_c") + """
select video_id, take_id, 'dribble' as type, id as player_track_id, round(s, 6) as t_start, round(e, 6) as t_end, round(travel, 6) as travel, acting, round(c, 6) as confidence from dribbles where c >= 0.15"""

_saves, _shots = (SQL[n][len(BASE) :] for n in ("e11_detect_saves", "e2_detect_shots"))
_turned = SQL["j9_turnovers_without_tackles"][len(BASE) :]
_cut = _turned.rindex("select video_id, take_id, type, passer")
FLOW = f""", flow as (select video_id, take_id, 'sprint' as type, player_track_id, t_start, t_end, confidence, player_track_id::varchar as acting from sprints where confidence >= 0.15
  union all select video_id, take_id, 'shot', null, t_start, t_end, confidence, null from {_inner(_shots[: _shots.rindex("select video_id, take_id, 'shot'")], _shots[_shots.rindex("select video_id, take_id, 'shot'") :])}
  union all select * from {_inner(TOUCHES, "select video_id, take_id, 'touch', id, t, t, c, raw::varchar from touches where c >= 0.15")}
  union all select p.video_id, p.take_id, 'possession', p.player_track_id, p.t_start, p.t_end, p.confidence, a.acting from poss p join (select video_id, take_id, min(t) as t0, string_agg(distinct track_id::varchar, ',' order by track_id::varchar) as acting from prun group by video_id, take_id, run_id) a
    on a.video_id = p.video_id and a.take_id = p.take_id and a.t0 = p.t_start where p.confidence >= 0.15
  union all select * from {_inner(_dribbles("prun"), "select video_id, take_id, 'dribble', id, s, e, c, acting from dribbles where c >= 0.15")}
  union all select * from {_inner(_turned[:_cut], "select video_id, take_id, type, passer, t_start, t_end, confidence, passer_track::varchar from passes p where type = 'pass' or type = 'turnover' and not exists (select 1 from tackles k where k.confidence >= 0.15 and k.video_id = p.video_id and k.take_id = p.take_id and k.tackler = p.receiver_track and k.tackled = p.passer_track and abs(p.t_end - k.t_end) <= 0.5) union all select video_id, take_id, type, player_track_id, t_start, t_end, confidence, tackler::varchar from tackles where confidence >= 0.15")}
  union all select video_id, take_id, 'save', player_track_id, t_start, t_end, confidence, player_track_id::varchar from {_inner(_saves[: _saves.rindex("select video_id, take_id, 'save'")], _saves[_saves.rindex("select video_id, take_id, 'save'") :])})"""


def _flow(spark, sf_dir, kinds=flow.KINDS):
    balls, boxes, tracks = ad.balls(spark, sf_dir), ad.boxes(spark, sf_dir), ad.tracks(spark, sf_dir)
    return flow.take_events(balls, boxes, tracks, ad.identities(spark, sf_dir), ad.WIDTH, ad.FPS, kinds)


def _spelled(df):
    """acting_ids as text, in order."""
    return df.withColumn("acting", F.array_join(F.array_sort(F.transform("acting_ids", lambda x: x.cast("string"))), ",")).drop("acting_ids")


@query(FLOW + " select video_id, take_id, type, player_track_id, round(t_start, 6) as t_start, round(t_end, 6) as t_end, round(confidence, 6)::double as confidence, acting from flow")
def e21_take_events(spark, sf_dir):
    return rounded(_spelled(_flow(spark, sf_dir).drop("evidence")))


@query(FLOW + " select video_id, take_id, type, player_track_id, round(t_start, 6) as t_start, round(confidence, 6)::double as confidence from flow where len(list_intersect(string_split(acting, ','), ['2', '9', '10'])) > 0")
def a1_attribute_events(spark, sf_dir):
    wanted = ad.tracks(spark, sf_dir).where("track_id in (2, 9, 10)").select("video_id", "take_id", "track_id")
    return rounded(stats.attribute(_flow(spark, sf_dir), wanted).select("video_id", "take_id", "type", "player_track_id", "t_start", "confidence"))


KINDS = ("touch", "pass", "turnover", "sprint", "shot", "tackle", "save", "dribble", "possession")


@query(FLOW + " select video_id, player_track_id, " + ", ".join(f"count(*) filter (type = '{k}') as n_{k}" for k in KINDS) + ", round(coalesce(sum(t_end - t_start) filter (type = 'possession'), 0), 6)::double as possession_s from flow where player_track_id is not null group by 1, 2")
def a8_full_card(spark, sf_dir):
    return rounded(stats.stat_card(_flow(spark, sf_dir).where("player_track_id is not null"), KINDS))


@query("select video_id, player_track_id, round(sum(coalesce(distance, 0)), 6) as distance, sum(coalesce(n_samples, 0))::bigint as n_samples, count(*) as n_fragments from (select video_id, take_id, track_id, track_id % 4 as player_track_id from (select distinct video_id, take_id, track_id from boxes) union all select video_id, take_id, 99, 0 from takes) m left join (select video_id, take_id, track_id, sum(speed * dt) as distance, count(*) as n_samples from speeds group by 1, 2, 3) using (video_id, take_id, track_id) group by 1, 2")
def a5_player_distance(spark, sf_dir):
    known = ad.tracks(spark, sf_dir).selectExpr("video_id", "take_id", "track_id", "track_id % 4 as player_track_id")
    lost = ad.takes(spark, sf_dir).selectExpr("video_id", "take_id", "99L as track_id", "0L as player_track_id")
    return rounded(stats.player_distance(ad.boxes(spark, sf_dir), known.unionByName(lost)))


TYPED = ", typed as (select video_id, frame_index, cast(floor(frame_index / 25e0) as bigint)::double as t from frames where frame_index % 75 = 30)"


@query(TYPED + """ select video_id, frame_index % 2 as line, 'touch' as type, null::bigint as player_track_id, t as t_start, t + 1 as t_end, 0.95e0 as confidence, 'manual_touch' as source, null::varchar as problem from typed
union all select video_id, frame_index % 2, null, null, null, null, null, null, 'at ' || frame_index from frames where frame_index % 75 = 31""")
def e22_manual_touches(spark, sf_dir):
    lists = ad.frames(spark, sf_dir).where("frame_index % 75 in (30, 31)").groupBy("video_id", F.expr("frame_index % 2 as line"), F.expr("frame_index % 75 as kind")).agg(
        F.concat_ws(", ", F.collect_list(F.expr("if(frame_index % 75 = 30, concat(cast(floor(frame_index / 1500) as string), ':', lpad(cast(floor(frame_index / 25) as int), 2, '0')), concat('at ', frame_index))"))).alias("typed"))
    rows = lists.select("video_id", "line", F.inline(text.touch_times(F.col("typed"))))
    good = manual.manual_touches(rows.where("t is not null"))
    return good.unionByName(rows.where("t is null").select("video_id", "line", "problem"), allowMissingColumns=True)


PLURAL = "case event_id % 18 " + " ".join(f"when {k} then '{key}s it hard'" for k, (key, _) in enumerate(PHRASES)) + " else 'waves' end"
MEANT = "case event_id % 18 " + " ".join(f"when {k} then '{kind}'" for k, (_, kind) in enumerate(PHRASES)) + " else 'key_moment' end"


@query()
def e22_annotation_events(spark, sf_dir):
    said = f"concat('Min ', event_id % 90, ':', lpad(event_id % 60, 2, '0'), ' player #', event_id % 30, ' in red ', {PLURAL})"
    rows = ad._read(spark, sf_dir, "events").select("event_id", text.annotation(F.expr(said)).alias("a")).select("event_id", "a.*")
    return rounded(manual.annotation_events(rows))


SQL["e22_annotation_events"] = f"""select event_id, cast(event_id % 30 as int) as jersey_number, 'red' as team_colour, {PLURAL} as action_phrase, {MEANT} as type, null::bigint as player_track_id,
((event_id % 90) * 60 + event_id % 60)::double as t_start, ((event_id % 90) * 60 + event_id % 60 + 1)::double as t_end, 0.95e0 as confidence, 'manual_annotation' as source from events"""


@query(TOUCHES + TYPED + """, autos as (select video_id, 'touch' as type, id as player_track_id, t as t_start, c as confidence from touches where c >= 0.15 union all select video_id, 'sprint', player_track_id, t_start, confidence from sprints where confidence >= 0.15),
flagged as (select a.*, 'auto' as source, type = 'touch' and exists (select 1 from typed m where m.video_id = a.video_id and abs(m.t - a.t_start) <= 1) as suppressed from autos a union all select video_id, 'touch', null, t, 0.95, 'manual_touch', false from typed)
select video_id, type, source, suppressed, count(*) as n, round(sum(t_start), 6) as at_ from flagged group by 1, 2, 3, 4""")
def j10_merge_touches(spark, sf_dir):
    typed = ad.frames(spark, sf_dir).where("frame_index % 75 = 30").select("video_id", F.floor(F.col("frame_index") / 25).cast("double").alias("t"))
    found = _touches(spark, sf_dir).unionByName(ev.detect_sprints(ad.boxes(spark, sf_dir), ad.FPS), allowMissingColumns=True).withColumn("source", F.lit("auto"))
    out = manual.merge_touches(found, manual.manual_touches(typed))
    return rounded(out.groupBy("video_id", "type", "source", "suppressed").agg(F.count("*").alias("n"), F.sum("t_start").alias("at_")))


@query("select distinct f.video_id, f.take_id, f.frame_index, b.track_id from frames f join (select * from boxes where frame_index % 40 < 9) b on b.video_id = f.video_id and b.take_id = f.take_id and round(abs(b.t - f.t), 9) <= 0.2")
def j11_candidate_tracks(spark, sf_dir):
    points = ad.frames(spark, sf_dir).select("video_id", "take_id", "frame_index", "t")
    return manual.candidate_tracks(points, ad.boxes(spark, sf_dir).where("frame_index % 40 < 9"), 0.2).drop("t")


@query(""", asked as (select video_id, take_id, frame_index, t from frames), hints as (select video_id, take_id, t, (x1 + x2) / 2 as x, (y1 + y2) / 2 - 60 as y from balls where frame_index % 30 < 3),
led as (select a.*, h.t as ht, h.x, h.y, row_number() over (partition by a.video_id, a.take_id, a.frame_index order by round(abs(h.t - a.t), 9), h.t) as rn from asked a join hints h on h.video_id = a.video_id and h.take_id = a.take_id and round(abs(h.t - a.t), 9) <= 0.3),
hb as (select l.*, b.track_id, b.x1, b.x2, b.y1, b.y2, row_number() over (partition by l.video_id, l.take_id, l.frame_index, b.track_id order by round(abs(b.t - l.ht), 9), b.t desc) as r2 from led l join boxes b on l.rn = 1 and b.video_id = l.video_id and b.take_id = l.take_id and round(abs(b.t - l.ht), 9) <= 0.15),
hd as (select *, not (x between x1 and x2 and y between y1 and y2) as outside, case when x between x1 and x2 and y between y1 and y2 then 0 else sqrt(pow((x1 + x2) / 2 - x, 2) + pow((y1 + y2) / 2 - y, 2)) end as d from hb where r2 = 1)
select video_id, take_id, frame_index, track_id, round(d, 6) as dist from (select *, row_number() over (partition by video_id, take_id, frame_index order by outside, d, track_id) as best from hd) where best = 1 and (not outside or d <= 200)""")
def j13_hinted_tracks(spark, sf_dir):
    points = ad.frames(spark, sf_dir).select("video_id", "take_id", "frame_index", "t")
    hints = ad.balls(spark, sf_dir).where("frame_index % 30 < 3").select("video_id", "take_id", "t", g.cx().alias("x"), (g.cy() - 60).alias("y"))
    return rounded(manual.hinted_tracks(points, hints, ad.boxes(spark, sf_dir), 0.3).drop("t"))


@query("""select video_id, frame_index, track_id, greatest(0, round_even(x1 * 1.5 - (x2 - x1) * 0.15, 0))::int as x1, least(1920, round_even(x2 * 1.5 + (x2 - x1) * 0.15, 0))::int as x2,
least(1080, round_even(tall * 1.5 + (tall - y1) * 0.15, 0))::int - greatest(0, round_even(y1 * 1.5 - (tall - y1) * 0.15, 0))::int >= 60.0048 as usable, round(y1 + 0.2 * (tall - y1), 6) as torso_top, round(x2 - 0.25 * (x2 - x1), 6) as torso_right, round((40 + track_id) * 100 / 255e0, 6) as l, (track_id * 20 - 128)::double as a
from (select *, y1 + (y2 - y1) * (1 + frame_index % 9) / 10 as tall from boxes)""")
def p11_crop_gate(spark, sf_dir):
    rows = ad.boxes(spark, sf_dir).withColumn("y2", F.expr("y1 + (y2 - y1) * (1 + frame_index % 9) / 10"))
    crop = g.native_crop(1.5, 1.5, 0.1, 1920, 1080)
    lab = g.cielab(F.expr("40 + track_id"), F.expr("track_id * 20"), F.lit(128))
    out = rows.select("video_id", "frame_index", "track_id", crop.alias("c"), g.band(0.2, 0.6, 0.25, 0.25).alias("torso"), lab.alias("lab"))
    return rounded(out.select("video_id", "frame_index", "track_id", "c.x1", "c.x2", g.large_enough(F.col("c"), 1080).alias("usable"), F.col("torso.y1").alias("torso_top"), F.col("torso.x2").alias("torso_right"), "lab.l", F.col("lab.a").cast("double").alias("a")))


@query("""select video_id, take_id, case when take_id % 2 = 0 then 9 else 3 end::bigint as identity, case when take_id % 2 = 0 then 2 else 1 end::bigint as n_tracks from takes""")
def t25_target_identity(spark, sf_dir):
    rows = ad.tracks(spark, sf_dir).where("track_id in (3, 9, 10) and (take_id % 2 = 0 or track_id < 10)").select("video_id", "take_id", "track_id")
    return manual.target_identity(ad.identities(spark, sf_dir), rows)


CHAIN = ", chain as (select video_id, take_id, track_id from boxes where track_id % 3 = take_id % 3 or track_id < 4 union all select video_id, take_id, 77 from takes)"


@query(CHAIN + ", first_ as (select video_id, take_id, track_id, min(t) as s from boxes group by 1, 2, 3) select video_id, take_id, track_id, row_number() over (partition by video_id, take_id order by s nulls last, track_id) as place from (select distinct * from chain) left join first_ using (video_id, take_id, track_id)")
def u2_union_chains(spark, sf_dir):
    tracks = ad.tracks(spark, sf_dir)
    chains = tracks.where("track_id % 3 = take_id % 3").select("video_id", "take_id", "track_id").unionByName(tracks.where("track_id < 4").select("video_id", "take_id", "track_id"))
    chains = chains.unionByName(ad.takes(spark, sf_dir).selectExpr("video_id", "take_id", "77L as track_id"))
    return manual.union_chains(chains, tracks).withColumn("place", F.col("place").cast("long"))


@query("select video_id, take_id, count(distinct track_id) as n_tracks from boxes group by 1, 2")
def t2_tracks_per_take(spark, sf_dir):
    return identity.tracks_per_take(ad.tracks(spark, sf_dir))


@query("""select video_id, take_id, count(*) filter (frame_index % 3 = 0) as n_too_small, count(*) filter (frame_index % 3 > 0) as n_considered, count(*) filter (frame_index % 3 > 0 and frame_index % 5 > 1) as n_legible,
count(*) filter (frame_index % 3 > 0 and frame_index % 2 = 0 and track_id % 3 = 0) as n_parseq, count(*) filter (frame_index % 3 > 0 and frame_index % 2 = 0 and track_id % 3 = 1) as n_ocr, count(*) filter (frame_index % 3 > 0 and frame_index % 2 = 0 and track_id % 3 = 2) as n_vlm from boxes group by 1, 2""")
def a9_read_counters(spark, sf_dir):
    reads = ad.boxes(spark, sf_dir).selectExpr("video_id", "take_id", "frame_index % 3 > 0 as usable", "frame_index % 5 > 1 as legible", "frame_index % 2 = 0 as confident", "element_at(array('parseq', 'ocr', 'vlm'), cast(track_id % 3 as int) + 1) as source")
    return stats.read_counters(reads)


@query("select take_id % 50 as video_id, count(*) as n_takes, count(*) filter (status = 'verified') as n_verified, coalesce(string_agg(distinct jersey_number, ',' order by jersey_number) filter (status = 'verified'), '') as numbers from votes_ group by 1")
def a9_identity_report(spark, sf_dir):
    votes = identity.digit_votes(ad.digit_reads(spark, sf_dir), ("take_id", "track_id")).withColumn("video_id", F.col("take_id") % 50)
    return stats.identity_report(votes).withColumn("numbers", F.array_join("numbers", ","))


SQL["a9_identity_report"] = "with votes_ as (" + SQL["t13_digit_votes"] + ") " + SQL["a9_identity_report"][len(BASE) :]


_windows = SQL["e12_candidate_windows"][len(BASE) :]
_cut = _windows.rindex("select video_id, take_id, track_id")


@query(_windows[:_cut] + ", cw as (" + _windows[_cut:] + ") select video_id, take_id, 'key_moment' as type, track_id as player_track_id, t_start, t_end, 0.55e0 as confidence from cw where (track_id + take_id) % 3 = 0")
def e13_key_moments(spark, sf_dir):
    windows = ev.candidate_windows(ad.boxes(spark, sf_dir), _possession(spark, sf_dir))
    said = F.expr("case (track_id + take_id) % 3 when 0 then 'seen: VERDICT=YES' when 1 then 'VERDICT = no' else 'unclear, yes' end")
    answers = windows.select("video_id", "take_id", "track_id", "t_start", said.alias("text"))
    return rounded(ev.key_moments(windows, answers).drop("text"))


_runs_sql = SQL["e7_e8_passes_turnovers"][len(BASE) :]
_cut2 = _runs_sql.rindex("select video_id, take_id, type")


@query(_runs_sql[:_cut2] + """, fell as (select video_id, take_id, receiver as scorer, t_end + 1 as t_after from passes where type = 'pass'),
gave as (select f.*, arg_max(p.passer, p.t_end) as giver, max(p.t_end) as pass_end, arg_max(p.t_start, p.t_end) as pass_start, arg_max(p.confidence, p.t_end) as pc from (select distinct * from fell) f join passes p on p.type = 'pass' and p.video_id = f.video_id and p.take_id = f.take_id and p.receiver = f.scorer and p.t_end between f.t_after - 15 and f.t_after group by all)
select video_id, take_id, 'assist' as type, giver as player_track_id, scorer, round(pass_start, 6) as t_start, round(pass_end, 6) as t_end, round(t_after, 6) as t_after, round(least(greatest(pc * 0.6, 0.1), 0.35), 6) as confidence from gave where giver <> 9 and scorer <> 9 and giver % 2 = scorer % 2 and least(greatest(pc * 0.6, 0.1), 0.35) >= 0.15""")
def e20_detect_assists(spark, sf_dir):
    passes = timejoin.settled(_passes(spark, sf_dir).where("type = 'pass'"))
    fell = passes.selectExpr("video_id", "take_id", "receiver as scorer", "t_end + 1 as t_after").distinct()
    return rounded(goals.detect_assists(fell, passes, ad.tracks(spark, sf_dir)))


READS = ", crops as (select l_orderkey as crop, case l_linenumber % 4 when 3 then 'x' || l_linenumber else (l_partkey % 3)::varchar end as digits, l_quantity / 60e0 as confidence from lineitem)"


@query()
def t15_confident_reads(spark, sf_dir):
    reads = ad._read(spark, sf_dir, "lineitem").selectExpr("l_orderkey as crop", "if(l_linenumber % 4 = 3, concat('x', l_linenumber), cast(l_partkey % 3 as string)) as digits", "cast(l_quantity as double) / 60D as confidence")
    return rounded(identity.confident_reads(reads, ("crop",)))


SQL["t15_confident_reads"] = "with " + READS.lstrip(", ") + " select crop, arg_max(digits, struct_pack(c := confidence, d := digits)) as digits, round(max(confidence), 6) as confidence, count(distinct digits) filter (confidence >= 0.4) = 1 as confident from crops where regexp_full_match(digits, '[0-9]{1,2}') group by 1"


@query("select video_id, take_id, track_id, round(agreement, 6) as agreement from (select *, agreement - lead(agreement) over w as ahead, row_number() over w as rn from (select distinct video_id, take_id, track_id, ((track_id * 7 + take_id * 3) % 11) / 11e0 as agreement from boxes where track_id % 4 = take_id % 4) window w as (partition by video_id, take_id order by agreement desc, track_id)) where rn = 1 and (ahead is null or round(ahead, 9) >= 0.2)")
def t16_claimed_track(spark, sf_dir):
    votes = ad.tracks(spark, sf_dir).where("track_id % 4 = take_id % 4").selectExpr("video_id", "take_id", "track_id", "((track_id * 7 + take_id * 3) % 11) / 11D as agreement")
    return rounded(identity.claimed_track(votes, ("video_id", "take_id")))


@query("select distinct video_id, take_id, 1::bigint as seed, track_id from boxes where track_id % 4 = 3 or (take_id + 1) % 4 = 3 or track_id % 3 = 1")
def t17_prune_chain(spark, sf_dir):
    tracks = ad.tracks(spark, sf_dir)
    numbers = tracks.selectExpr("video_id", "take_id", "track_id", "if(track_id % 4 = 3 or (track_id = 1 and (take_id + 1) % 4 = 3), null, cast(track_id % 3 as string)) as digits")
    return identity.prune_chain(tracks.selectExpr("video_id", "take_id", "1L as seed", "track_id"), numbers)


@query("select video_id, take_id, track_id, round(quantile_cont((frame_index * 7 % 50)::double, 0.5), 6) as l, round(quantile_cont(case when frame_index % 2 = 0 then frame_index % 9 end::double, 0.5), 6) as a, round(quantile_cont(x1, 0.5), 6) as b from boxes group by 1, 2, 3")
def t19_kit_median(spark, sf_dir):
    samples = ad.boxes(spark, sf_dir).selectExpr("video_id", "take_id", "track_id", "cast(frame_index * 7 % 50 as double) as l", "if(frame_index % 2 = 0, cast(frame_index % 9 as double), null) as a", "x1 as b")
    return rounded(identity.kit_median(samples, ("video_id", "take_id", "track_id")))


@query("select distinct video_id, take_id, track_id from boxes where (track_id % 3 = 2 or abs(30 * (track_id % 2) - 5 * (take_id % 2)) < 24) and (track_id % 5 = 0 or track_id % 5 = 2)")
def t22_classify_fragments(spark, sf_dir):
    none = "cast(null as struct<l:double,a:double,b:double>)"
    kit = lambda l: f"named_struct('torso', {l}, 'shorts', {none}, 'socks', {none})"  # noqa: E731, E741
    lab = "named_struct('l', 30D * (track_id % 2), 'a', 0D, 'b', 0D)"
    chain = ad.tracks(spark, sf_dir).selectExpr("video_id", "take_id", "track_id", kit(f"if(track_id % 3 = 2, {none}, {lab})") + " as kit", "if(track_id % 5 = 0, null, cast(track_id % 5 as string)) as jersey")
    out = None
    for odd in (0, 1):  # a profile a parity of takes
        own = ad.takes(spark, sf_dir).select("video_id").distinct().selectExpr("video_id", kit(f"named_struct('l', {5 * odd}D, 'a', 0D, 'b', 0D)") + " as kit", "'2' as jersey")
        part = target.without_contradicted(chain.where(f"take_id % 2 = {odd}"), own)
        out = part if out is None else out.unionByName(part)
    return out.select("video_id", "take_id", "track_id")


@query("select video_id, take_id, track_id, round(min(t), 6) as t_start, round(max(t), 6) as t_end from boxes group by 1, 2, 3")
def t26_active_windows(spark, sf_dir):
    return rounded(identity.active_windows(ad.boxes(spark, sf_dir)))


@query("select video_id, take_id, 2::bigint as track_id, frame_index, x1, conf from (select *, row_number() over (partition by video_id, take_id, t order by track_id) as rn from boxes where track_id in (2, 5)) where rn = 1")
def t27_merge_fragments(spark, sf_dir):
    own = ad.tracks(spark, sf_dir).where("track_id in (2, 5)").select("video_id", "take_id", "track_id")
    return identity.merge_fragments(ad.boxes(spark, sf_dir), own).select("video_id", "take_id", "track_id", "frame_index", "x1", "conf")


@query(""", gc as (select video_id, take_id, t, 100 + frame_index % 7 + case when frame_index % 25 = 0 then 900 else 0 end as x1, 200 as y1, 300 + frame_index % 5 + case when frame_index % 25 = 0 then 900 else 0 end as x2, 300 + frame_index % 3 as y2 from frames where frame_index % 5 = 0),
gm as (select video_id, take_id, median(x1) as a, median(y1) as b, median(x2) as c, median(y2) as d from gc group by 1, 2),
gi as (select *, greatest(least(x2, c) - greatest(x1, a), 0) * greatest(least(y2, d) - greatest(y1, b), 0) as i from gc join gm using (video_id, take_id)),
gk as (select * from gi where i / ((x2 - x1) * (y2 - y1) + (c - a) * (d - b) - i) >= 0.3)
select video_id, take_id, round(median(x1), 6) as x1, round(median(y1), 6) as y1, round(median(x2), 6) as x2, round(median(y2), 6) as y2, count(*) as n_inliers from gk group by 1, 2 having count(*) >= 2""")
def t28_structure_votes(spark, sf_dir):
    far = "if(frame_index % 25 = 0, 900, 0)"
    rows = ad.frames(spark, sf_dir).where("frame_index % 5 = 0").selectExpr("video_id", "take_id", "t", f"cast(100 + frame_index % 7 + {far} as double) as x1", "200D as y1", f"cast(300 + frame_index % 5 + {far} as double) as x2", "cast(300 + frame_index % 3 as double) as y2")
    return rounded(identity.structure_votes(rows).drop("n_sampled", "t_anchor", "representative"))


@query("select cls, count(*) as n from (select case when frame_index % 11 = 0 then null when frame_index % 9 = 0 then 'staff ' || track_id when frame_index % 5 = 0 then 'ball' else 'player' end as cls from boxes) where cls is null or cls not in ('player', 'ball') group by 1")
def p2_dropped_classes(spark, sf_dir):
    rows = ad.boxes(spark, sf_dir).selectExpr("case when frame_index % 11 = 0 then null when frame_index % 9 = 0 then concat('staff ', track_id) when frame_index % 5 = 0 then 'ball' else 'player' end as cls")
    return filters.dropped_classes(rows)


@query("""select event_id, case event_id % 4 when 0 then (event_id % 60)::double when 1 then (event_id % 60) / 1.001e0 when 2 then 0 else 29.97e0 end as fps_, case when event_id % 3 = 0 then 0 else (event_id % 500) / 10e0 end as duration,
case when event_id % 5 = 0 then event_id::bigint when event_id % 3 > 0 and (event_id % 500) > 0 and event_id % 4 <> 2 and (event_id % 4 = 3 or event_id % 60 > 0) then round_even((event_id % 500) / 10e0 * case event_id % 4 when 0 then (event_id % 60)::double when 1 then (event_id % 60) * 1000 / 1001e0 else 29.97e0 end, 0)::bigint end as nb_frames,
printf('%d:%02d', (event_id // 60)::int, (event_id % 60)::int) as caption, printf('%02d:%04.1f', (event_id // 60)::int, (event_id % 60)::double) as padded, (event_id % 10) || ' - ' || (event_id % 7) as tokens, '{"n":' || event_id || case when event_id % 2 = 0 then ',"kind":"even"' else '' end || '}' as evidence,
'clip_' || event_id as slug, case when event_id % 3 = 0 then (event_id % 40)::int else 7 end as number, case when event_id % 3 = 0 then 'typed' else 'single_jersey_inferred' end as how from events""")
def x9_texts(spark, sf_dir):
    rows = ad._read(spark, sf_dir, "events").selectExpr(
        "event_id", "case event_id % 4 when 0 then concat(event_id % 60, '/1') when 1 then concat((event_id % 60) * 1000, '/1001') when 2 then '30/0' else '29.97' end as rate", "if(event_id % 3 = 0, 'N/A', cast((event_id % 500) / 10D as string)) as length",
        "if(event_id % 5 = 0, cast(event_id as string), 'N/A') as frames", "array(named_struct('x', 30D, 'text', cast(event_id % 7 as string)), named_struct('x', 10D, 'text', cast(event_id % 10 as string)), named_struct('x', 20D, 'text', '-')) as tokens",
        "event_id as n", "if(event_id % 2 = 0, 'even', null) as kind", "if(event_id % 3 = 0, cast(event_id % 40 as int), null) as typed",
    )
    t = F.col("event_id").cast("double")
    probed = text.probed(F.col("rate"), F.lit("25/1"), F.col("length"), F.lit(None).cast("string"), F.col("frames"))
    who = text.touch_player(F.col("typed"), F.array(F.lit(7), F.lit(None).cast("int"), F.lit(7)))
    out = rows.select("event_id", probed.alias("p"), text.caption_clock(t).alias("caption"), text.padded_clock(t).alias("padded"), text.joined_tokens(F.col("tokens")).alias("tokens"), text.evidence("n", "kind").alias("evidence"), text.slug(F.concat(F.lit(" Clip "), F.col("event_id"))).alias("slug"), who.alias("w"))
    return rounded(out.select("event_id", F.col("p.fps").alias("fps_"), "p.duration", "p.nb_frames", "caption", "padded", "tokens", "evidence", "slug", "w.number", "w.how"))


SQL["x9_texts"] = "select event_id, round(case event_id % 4 when 1 then (event_id % 60) * 1000 / 1001e0 else fps_ end, 6)::double as fps_, * exclude (event_id, fps_) from (" + SQL["x9_texts"][len(BASE) :] + ")"


@query("""select video_id, take_id, track_id, case when track_id % 4 = 0 then 'none' when track_id % 4 in (1, 3) and track_id % 3 = 1 then 'lost' when track_id % 4 <> 2 then 'none' when track_id % 3 = 0 then 'amber' else 'red' end as tier, t_start + 1 between 0 and t_start + 2 or track_id % 2 = 1 as active,
1280 as width, 720 as height, round(1 + 2 * track_id, 6)::double as pitch_x, case when track_id % 5 = 0 then 2 else 1 end as n_overrides from takes, (select unnest(range(12)) as track_id)""")
def p15_expressions(spark, sf_dir):
    rows = ad.takes(spark, sf_dir).withColumn("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    status = F.expr("case track_id % 4 when 0 then null when 2 then 'verified' else 'unverified' end")
    method = F.expr("case track_id % 3 when 0 then 'arrow_vote' when 1 then 'target_lost' else 'manual' end")
    method = F.when(F.expr("track_id % 4 = 2 and track_id % 3 = 1"), "manual").otherwise(method)
    windows = F.expr("if(track_id % 2 = 1, cast(array() as array<struct<t_start:double,t_end:double>>), array(named_struct('t_start', 0D, 't_end', t_start + 2)))")
    m = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in ((2, 0, 1), (0, 2, 1), (0, 0, 1))])
    out = rows.select("video_id", "take_id", "track_id", memory.render_tier(method, status).alias("tier"), memory.active_at(F.col("t_start") + 1, windows).alias("active"), g.scaled_size(F.lit(1920), F.lit(1080), 1280).alias("s"),
        g.to_pitch(F.col("track_id").cast("double"), F.lit(0.0), m).alias("pitch"), F.size(filters.overrides(F.expr("if(track_id % 5 = 0, '3, 1:4,3', '0:3,3,x')"))).alias("n_overrides"))
    return rounded(out.select("video_id", "take_id", "track_id", "tier", "active", "s.width", "s.height", F.col("pitch.x").alias("pitch_x"), "n_overrides"))


@query()
def t13_confirmed_votes(spark, sf_dir):
    reads, keys = ad.digit_reads(spark, sf_dir), ("take_id", "track_id")
    people = reads.where("track_id % 2 = 0").selectExpr("take_id", "track_id", "(take_id + track_id) % 6 as number").distinct()
    people = people.unionByName(reads.selectExpr("take_id", "99L as track_id", "7L as number").distinct())  # tracks without reads
    return rounded(identity.confirmed_votes(identity.digit_votes(reads, keys), reads, people, keys))


SQL["t13_confirmed_votes"] = "with votes_ as (" + SQL["t13_digit_votes"] + """), reads as (select cast(l_suppkey as bigint) as take_id, cast(l_partkey % 4 as bigint) as track_id, case when l_linenumber = 7 then null else cast(l_linenumber % 5 as varchar) end as digits, l_linenumber / 10e0 as confidence from lineitem),
people as (select distinct take_id, track_id, ((take_id + track_id) % 6)::varchar as wanted from reads where track_id % 2 = 0 union all select distinct take_id, 99, '7' from reads),
seen as (select take_id, track_id, digits, count(*) as n, avg(confidence) as mean from reads where digits is not null group by 1, 2, 3),
told as (select p.take_id, p.track_id, wanted, max(n) filter (digits = wanted) as own, max(mean) filter (digits = wanted) as mean, max(n) filter (digits <> wanted) as rival from people p left join seen using (take_id, track_id) group by 1, 2, 3)
select take_id, track_id, case when own is not null then wanted else jersey_number end as jersey_number, case when own is not null then 'verified' else coalesce(status, 'unverified') end as status,
round(case when own is not null then least(1.0, greatest(0.3, mean)) else coalesce(confidence, 0) end, 6)::double as confidence, case when rival > own then 'contradicted' when own is not null then 'accepted' when wanted is not null then 'no_reads' end as note
from votes_ full join told using (take_id, track_id)"""


_picked = SQL["t11_select_targets"][len(BASE) :]
_cut = _picked.rindex("\nselect k.video_id")


@query(_picked[:_cut] + ", chosen_ as (" + _picked[_cut:] + ") select video_id, round(coalesce(avg(confidence) filter (track_id is not null), 0), 5)::double as confidence, count(track_id) as n_usable, coalesce(bool_or(track_id is not null and method <> 'manual'), false) or count(track_id) = 0 as needs_confirmation from chosen_ group by 1")
def t11_overall_selection(spark, sf_dir):
    picked = QUERIES["t11_select_targets"](spark, sf_dir)
    return target.overall_selection(picked).withColumn("confidence", F.round("confidence", 5))


@query(_runs_sql[:_cut2] + " select 'passes' as stage, reject as reason, count(*)::bigint as n from passes where reject is not null group by 2 union all select 'passes again', reject, count(*) from passes where reject = 'flight' group by 2")
def p7_merged_counts(spark, sf_dir):
    rejects = timejoin.settled(_passes(spark, sf_dir).where("reject is not null"))
    more = rejects.where("reject = 'flight'")
    return possession.merged_counts(possession.drop_counts(rejects, "passes"), possession.drop_counts(more, "passes again"))


def _goal_tables(spark, sf_dir):
    """Goals by source, and assists, out of the derived matches."""
    region = QUERIES["e15_region_goals"](spark, sf_dir).selectExpr("video_id", "'goal_region' as source")
    crossed = QUERIES["e16_line_goals"](spark, sf_dir).selectExpr("video_id", "'goal_line_crossing' as source")
    shown = QUERIES["e14_score_increments"](spark, sf_dir).where("take_id = 2").selectExpr("video_id", "'scoreboard' as source")
    return shown.unionByName(region).unionByName(crossed).where("video_id % 3 > 0"), QUERIES["e20_detect_assists"](spark, sf_dir).where("video_id % 2 = 1")


_parts = {n: SQL[n][len(BASE) :] for n in ("e14_score_increments", "e15_region_goals", "e16_line_goals", "e20_detect_assists")}
_split = {n: (b[: b.rindex("\nselect ")], b[b.rindex("\nselect ") :]) for n, b in _parts.items()}


@query(f""", found_ as (select video_id, 'scoreboard' as source from {_inner(*_split["e14_score_increments"])} where take_id = 2 union all select video_id, 'goal_region' from {_inner(*_split["e15_region_goals"])} union all select video_id, 'goal_line_crossing' from {_inner(*_split["e16_line_goals"])}),
kinds_ as (select video_id, count(*) as n, count(*) filter (source = 'scoreboard') as b, count(*) filter (source = 'goal_region') as r from found_ where video_id % 3 > 0 group by 1),
given_ as (select video_id, count(*) as n from {_inner(*_split["e20_detect_assists"])} where video_id % 2 = 1 group by 1)
select v.video_id, case when coalesce(k.n, 0) > 0 then 'available' when v.video_id % 2 = 0 then 'no_increment' else 'no_scoreboard' end as status, case when k.n > 0 then printf('%d by scoreboard, %d in marked regions, %d unspecified', k.b, k.r, k.n - k.b - k.r) end as reason,
coalesce(k.n, 0)::bigint as n_goals, coalesce(g.n, 0)::bigint as n_assists from (select distinct video_id from frames) v left join kinds_ k using (video_id) left join given_ g using (video_id)""")
def p13_goals_told(spark, sf_dir):
    videos, (found, given) = ad.frames(spark, sf_dir).select("video_id").distinct(), _goal_tables(spark, sf_dir)
    return goals.goal_availability(videos, ad.takes(spark, sf_dir), videos.where("video_id % 2 = 0"), found, given)


_voted = SQL["t28_structure_votes"][len(BASE) :]
_last = _voted.rindex("\nselect video_id, take_id, round(median(x1)")


@query(_voted[:_last] + """, gf as (select video_id, take_id, median(x1) as p, median(y1) as q, median(x2) as r, median(y2) as s, count(*) as n from gk group by 1, 2 having count(*) >= 2),
gj as (select k.video_id, k.take_id, k.t, k.x1, k.y1, k.x2, k.y2, n, greatest(least(k.x2, r) - greatest(k.x1, p), 0) * greatest(least(k.y2, s) - greatest(k.y1, q), 0) as j, (k.x2 - k.x1) * (k.y2 - k.y1) + (r - p) * (s - q) as u from gk k join gf using (video_id, take_id))
select video_id, take_id, n as n_inliers, (select count(*) from gc c where c.video_id = g.video_id and c.take_id = g.take_id) as n_sampled, round(t, 6) as t_anchor, x1::double as x1, x2::double as x2, x1 + 10e0 as left_post, x2 - 10e0 as right_post
from gj g qualify row_number() over (partition by video_id, take_id order by round(j / (u - j), 9) desc, t) = 1""")
def t28_representative(spark, sf_dir):
    """The real goal structure nearest to the voted box, with its posts."""
    far = "if(frame_index % 25 = 0, 900, 0)"
    rows = ad.frames(spark, sf_dir).where("frame_index % 5 = 0").selectExpr("video_id", "take_id", "t", f"cast(100 + frame_index % 7 + {far} as double) as x1", "200D as y1", f"cast(300 + frame_index % 5 + {far} as double) as x2", "cast(300 + frame_index % 3 as double) as y2")
    posts = rows.withColumn("posts", F.array(F.col("x1") + 10, F.col("x2") - 10))
    out = identity.structure_votes(posts)
    return rounded(out.select("video_id", "take_id", "n_inliers", "n_sampled", "t_anchor", "representative.x1", "representative.x2", F.expr("representative.posts[0]").alias("left_post"), F.expr("representative.posts[1]").alias("right_post")))


_tracked = re.sub(r"\b(boxes|smooth|steps|speeds|ranked|hot|runs_)\b", r"\g<1>_t", BASE[BASE.index("smooth as (") : BASE.index("segs as (")].rstrip().rstrip(","))


_SHOWN = "(track_id = 3 and frame_index % 80 < 25 or track_id = 0 and frame_index % 80 >= 25)"


@query(FLOW + f""", boxes_t as (select video_id, take_id, (select min(track_id) from boxes m where m.track_id in (0, 3) and m.video_id = b.video_id and m.take_id = b.take_id) as track_id, frame_index, t, x1, y1, x2, y2, conf from boxes b where {_SHOWN}), """ + _tracked + """,
found_t as (select video_id, take_id, track_id, min(t) as t_start, max(t) as t_end, max(speed) as peak from runs__t group by video_id, take_id, track_id, run having round(max(t) - min(t), 9) >= 0.5)
select video_id, take_id, track_id, round(t_start, 6) as t_start, round(t_end, 6) as t_end, round(peak, 6) as peak, row_number() over (partition by video_id, take_id, track_id order by peak desc, t_start) as rank from found_t c
where not exists (select 1 from flow h where (h.type in ('dribble', 'possession') or h.type = 'sprint' and h.video_id % 2 = 1) and len(list_intersect(string_split(h.acting, ','), ['0', '3'])) > 0 and h.video_id = c.video_id and h.take_id = c.take_id and c.t_end > h.t_start and c.t_start < h.t_end) qualify rank <= 6""")
def e12_target_windows(spark, sf_dir):
    """Windows for key moments of the followed player, whose two tracks show in turn and are taken as one."""
    wanted = ad.tracks(spark, sf_dir).where("track_id in (0, 3)").select("video_id", "take_id", "track_id")
    found = _flow(spark, sf_dir, manual.TAKEN).where("type <> 'sprint' or video_id % 2 = 1")
    return rounded(manual.target_windows(ad.boxes(spark, sf_dir).where(_SHOWN), wanted, found))


_AFFINE = "1 + (frame_index % 5) / 50e0 as a, (frame_index % 7 - 3) / 40e0 as b, frame_index % 11 - 5e0 as tx, (track_id % 3 - 1) / 30e0 as c, 1 - (frame_index % 4) / 60e0 as d, track_id - 6e0 as ty"
_CORNERS = [(x, y) for x in ("x1", "x2") for y in ("y1", "y2")]


@query(f""", moved as (select video_id, take_id, track_id, frame_index, x1, y1, x2, y2, {_AFFINE} from boxes)
select video_id, take_id, track_id, frame_index, """ + ", ".join(f"round({f}({', '.join(f'{p} * {x} + {q} * {y} + {t}' for x, y in _CORNERS)}), 6) as {name}" for name, f, (p, q, t) in (("left", "least", ("a", "b", "tx")), ("top", "least", ("c", "d", "ty")), ("right", "greatest", ("a", "b", "tx")), ("bottom", "greatest", ("c", "d", "ty")))) + " from moved")
def g7_warped_boxes(spark, sf_dir):
    """Every box under an affine map of its own."""
    rows = ad.boxes(spark, sf_dir).selectExpr("video_id", "take_id", "track_id", "frame_index", "x1", "y1", "x2", "y2", *_AFFINE.replace("e0", "D").split(", "))
    out = rows.withColumn("w", g.warped(*[F.col(c) for c in ("a", "b", "tx", "c", "d", "ty")]))
    return rounded(out.select("video_id", "take_id", "track_id", "frame_index", F.col("w.x1").alias("left"), F.col("w.y1").alias("top"), F.col("w.x2").alias("right"), F.col("w.y2").alias("bottom")))


@query(""", said as (select video_id, frame_index, case when frame_index % 3 = 0 then null else frame_index % 4 end as colour, case when frame_index % 5 < 2 then null else frame_index % 6 end as hint, frame_index % 7 as candidates from frames)
select video_id, frame_index, case when candidates > 0 then coalesce(colour, hint) end as track_id, case when candidates = 0 then 'no_candidates' when colour = hint then 'corroborated' when colour is not null and hint is not null then 'disagreement'
  when colour is not null then 'colour_only' when hint is not null then 'arrow_fallback' else 'no_confident_signal' end as how from said""")
def j14_colour_and_hint(spark, sf_dir):
    """What a colour and an arrow say together."""
    rows = ad.frames(spark, sf_dir).selectExpr("video_id", "frame_index", "if(frame_index % 3 = 0, null, frame_index % 4) as colour", "if(frame_index % 5 < 2, null, frame_index % 6) as hint", "frame_index % 7 as candidates")
    return rows.select("video_id", "frame_index", target.combined(F.col("colour"), F.col("hint"), F.col("candidates")).alias("c")).select("video_id", "frame_index", "c.*")


@query()
def r4_export_in_budget(spark, sf_dir):
    """The best clips of each player up to some twenty seconds in all."""
    ranked = stats.rank_events(rounded(_happened(spark, sf_dir)))
    return rounded(stats.select_export(stats.dedupe_clips(stats.clip_ranges(ranked, ad.takes(spark, sf_dir))), budget=20.01))


SQL["r4_export_in_budget"] = "select * from (" + SQL["r3_dedupe_clips"] + ") qualify sum(clip_end - clip_start) over (partition by video_id, player_track_id order by rank) <= 20.01 or row_number() over (partition by video_id, player_track_id order by rank) = 1"
