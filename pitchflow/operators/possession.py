"""Possession runs and what follows from neighbouring runs. Every confidence is clamped to its own range, and rows under
``MIN_EMIT`` are dropped; ``reject`` columns name the first rule that a candidate fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.geometry import cx, cy, height, ninth
from .filters import eligible
from .series import debounced
from .timejoin import TAKE, near_boxes, nearest_in_time, nearest_player, of_tracks, settled


def clamp(c: Column, params: dict) -> Column:
    return F.least(F.greatest(c, F.lit(params["min"])), F.lit(params["max"]))

def first_reject(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule that holds, in the order given; null if none does (a rule without answer does not)."""
    return F.coalesce(*[F.when(rule, reason) for rule, reason in rules])

def accepted(candidates: DataFrame) -> DataFrame:
    """The candidates that no rule rejects."""
    return candidates.where("reject is null").drop("reject")

def drop_counts(df: DataFrame, stage: str) -> DataFrame:
    """(stage, reason, n) of the rows with a reject reason."""
    return df.where("reject is not null").groupBy(F.lit(stage).alias("stage"), F.col("reject").alias("reason")).agg(F.count("*").alias("n"))

def merged_counts(*parts: DataFrame) -> DataFrame:
    """(stage, reason, n) of several stages' counts in one table."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("stage", "reason").agg(F.sum("n").alias("n"))

def players_near(balls: DataFrame, boxes: DataFrame, params: dict, tracks: DataFrame | None = None) -> DataFrame:
    """Balls of enough confidence with x, y and the track and distance of the nearest box. With ``tracks`` only players and
    goalkeepers can have the ball."""
    if tracks is not None:
        boxes = of_tracks(boxes, eligible(tracks))
    rows = balls.where(F.col("conf") >= params["conf"]).select(*TAKE, "frame_index", "t", "conf", cx().alias("x"), cy().alias("y"))
    return nearest_player(rows, boxes, params["tolerance"])

def possession_series(balls: DataFrame, boxes: DataFrame, params: dict = config.POSSESSION, tracks: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Balls with x, y and the track in possession: the nearest box, null beyond the distance. ``tracks`` as of
    ``players_near``, or ``near``, what that gives for the same parameters."""
    if near is None:
        near = players_near(balls, boxes, params, tracks)
    return near.withColumn("track_id", F.when(F.col("dist") <= params["distance"], F.col("track_id")))

def run_samples(series: DataFrame, identities: DataFrame | None = None, params: dict = config.POSSESSION) -> DataFrame:
    """The samples with a track, with identity, identity_confidence and run_id. A loose ball does not end a run; another
    identity or a gap of ``merge`` does. ``identities``: video_id, take_id, track_id, identity, and confidence if known;
    tracks that it lacks are identities of their own, and surely so."""
    held = series.where("track_id is not null")
    if identities is not None:
        known = identities.select(*TAKE, "track_id", "identity", (F.col("confidence") if "confidence" in identities.columns else F.lit(1.0)).alias("identity_confidence"))
        held = of_tracks(held, known, "identity", "identity_confidence", keep=True).withColumns({"identity": F.coalesce("identity", "track_id"), "identity_confidence": F.coalesce("identity_confidence", F.lit(1.0))})
    else:
        held = held.withColumns({"identity": F.col("track_id"), "identity_confidence": F.lit(1.0)})
    w = Window.partitionBy(*TAKE).orderBy("t", "frame_index")
    new = (F.col("identity") != F.lag("identity").over(w)) | (ninth(F.col("t") - F.lag("t").over(w)) >= params["merge"])
    return held.withColumn("run_id", F.sum(F.when(new, 1).otherwise(0)).over(w))

def possession_runs(series: DataFrame, identities: DataFrame | None = None, params: dict = config.POSSESSION) -> DataFrame:
    """Runs of samples of one identity, as ``run_samples`` cuts them."""
    return runs_of(run_samples(series, identities, params))

def runs_of(samples: DataFrame) -> DataFrame:
    at = lambda f: f(F.struct("t", "track_id", "x", "y"), F.struct("t", "frame_index"))
    return samples.groupBy(*TAKE, "run_id").agg(
        F.first("identity").alias("identity"), F.first("identity_confidence").alias("identity_confidence"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n"),
        F.avg("dist").alias("mean_dist"), F.sort_array(F.collect_set("track_id")).alias("raw_track_ids"), at(F.min_by).alias("first"), at(F.max_by).alias("last"),
    )

def run_quality(distance: float = config.POSSESSION["distance"], fps: float = 30.0) -> Column:
    """Half continuity, half closeness, times the confidence of the identity."""
    frames = F.greatest(F.lit(1.0), F.bround((F.col("t_end") - F.col("t_start")) * fps)) + 1
    weight = config.CONTINUITY_WEIGHT
    return F.col("identity_confidence") * (weight * F.least(F.lit(1.0), F.col("n") / frames) + (1 - weight) * F.greatest(F.lit(0.0), 1 - F.col("mean_dist") / distance))

def possession_candidates(runs: DataFrame, fps: float = 30.0, params: dict = config.POSSESSION) -> DataFrame:
    """Every run with what a possession event says, and ``reject``."""
    conf = clamp(run_quality(params["distance"], fps), params)
    short = ninth(F.col("t_end") - F.col("t_start")) < params["duration"]
    reject = first_reject((short, "possession_run_below_min_duration"), (conf < config.MIN_EMIT, "possession_below_min_emit_confidence"))
    return runs.select(*TAKE, F.lit("possession").alias("type"), F.col("identity").alias("player_track_id"), "t_start", "t_end", "n", "mean_dist", "raw_track_ids", conf.alias("confidence"), reject.alias("reject"))

def detect_possession(runs: DataFrame, fps: float = 30.0, params: dict = config.POSSESSION) -> DataFrame:
    return accepted(possession_candidates(runs, fps, params))

def contact_evidence(times: DataFrame, states: DataFrame, params: dict = config.TOUCH) -> DataFrame:
    """``times`` with ``kicked``: whether the ball's velocity just before and just after differ by at least delta_v, and
    ``delta_v``, by how much (null where it is not known on both sides). The rows of an instant go along with it, so that they
    need no join with what is found, which would make them twice and move them."""
    w, rest = params["window"], [c for c in times.columns if c not in TAKE]
    held = times.groupBy(*TAKE, F.col("t").alias("__t0")).agg(F.collect_list(F.struct(*rest)).alias("__rows"))
    sides = held.select(*TAKE, "__t0", "__rows", F.explode(F.array(F.lit(-1), F.lit(1))).alias("__s"))
    sides = sides.select(*TAKE, "__t0", "__s", F.when(F.col("__s") == 1, F.col("__rows")).alias("__rows"), (F.col("__t0") + F.col("__s") * w).alias("t"))
    near = nearest_in_time(sides, states.select(*TAKE, "t", "vx", "vy", "known"), w, keep=True)
    at = lambda s: F.max(F.when(F.col("__s") == s, F.struct("near.vx", "near.vy", "near.known")))
    both = near.groupBy(*TAKE, "__t0").agg(at(-1).alias("a"), at(1).alias("b"), F.first("__rows", ignorenulls=True).alias("__rows"))
    known = F.col("a.known") & F.col("b.known") & F.col("video_id").isNotNull() & F.col("take_id").isNotNull()
    delta = F.when(known, F.hypot(F.col("a.vx") - F.col("b.vx"), F.col("a.vy") - F.col("b.vy")))
    rows = both.select(*TAKE, delta.alias("delta_v"), F.inline("__rows")).select(*times.columns, "delta_v")
    return rows.withColumn("kicked", F.coalesce(F.col("delta_v") >= params["delta_v"], F.lit(False)))

def touch_candidates(
    balls: DataFrame, boxes: DataFrame, states: DataFrame | None = None, params: dict = config.TOUCH, tracks: DataFrame | None = None, identities: DataFrame | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """Every ball with what a touch event says, and ``reject``: unsure balls, balls with no player near in time or place,
    balls too soon after the identity's last touch, balls that keep their way, too little confidence. A rejected ball does not
    count as a touch for those after it. ``near`` as of ``possession_series``."""
    if near is None:
        near = players_near(balls, boxes, params, tracks)
    near = near.withColumnRenamed("track_id", "raw_track_id")
    if identities is not None:
        near = of_tracks(near, identities, "identity", key="raw_track_id", keep=True).withColumn("track_id", F.coalesce("identity", "raw_track_id")).drop("identity")
    else:
        near = near.withColumn("track_id", F.col("raw_track_id"))
    if states is not None:
        near = contact_evidence(near, states, config.TOUCH | params)
    else:
        near = near.withColumns({"kicked": F.lit(True), "delta_v": F.lit(None).cast("double")})
    conf = clamp(params["min"] + (1 - F.col("dist") / params["distance"]) * F.col("conf") * (params["max"] - params["min"]), params)
    far = first_reject((F.col("raw_track_id").isNull(), "touch_no_track_near_ball_in_time"), (F.col("dist") > params["distance"], "touch_ball_too_far_from_any_player"))
    weak = first_reject((~F.col("kicked"), "touch_no_contact_evidence"), (conf < config.MIN_EMIT, "touch_below_min_emit_confidence"))
    rows = settled(near.withColumns({"far": far, "weak": weak, "confidence": conf}))
    able = rows.where("far is null")
    key = [*TAKE, "track_id"]
    kept = debounced(able.where("weak is null").select(*key, "t").distinct(), params["debounce"], key)
    # a kept time stands after the balls of its own instant, of which the first good one is the touch
    mark = kept.select(*key, "t", F.lit(1).alias("__mark"))
    both = able.withColumn("__mark", F.lit(0)).unionByName(mark, allowMissingColumns=True)
    w = Window.partitionBy(*key)
    last = F.last(F.when(F.col("__mark") == 1, F.col("t")), ignorenulls=True).over(w.orderBy("t", "__mark"))
    again = F.row_number().over(Window.partitionBy(*key, "t", "__mark", F.col("weak").isNull()).orderBy("frame_index")) > 1
    told = both.withColumns({"__soon": ninth(F.col("t") - last) < params["debounce"], "__again": again & F.col("weak").isNull()}).where("__mark = 0")
    told = told.withColumn("reject", F.when(F.col("__soon") | F.col("__again"), "touch_debounced").otherwise(F.col("weak")))
    columns = [*TAKE, F.lit("touch").alias("type"), F.col("track_id").alias("player_track_id"), F.col("t").alias("t_start"), F.col("t").alias("t_end"), "dist", "raw_track_id", F.col("conf").alias("ball_conf"), "delta_v", "confidence"]
    out = told.select(*columns, "reject").unionByName(rows.where("far is not null").select(*columns, F.col("far").alias("reject")))
    dim = balls.where(F.col("conf") < params["conf"]).select(*TAKE, F.lit("touch").alias("type"), F.col("t").alias("t_start"), F.col("t").alias("t_end"), F.col("conf").alias("ball_conf"), F.lit("touch_ball_conf_too_low").alias("reject"))
    return out.unionByName(dim, allowMissingColumns=True)

def detect_touches(
    balls: DataFrame, boxes: DataFrame, states: DataFrame | None = None, params: dict = config.TOUCH, tracks: DataFrame | None = None, identities: DataFrame | None = None
) -> DataFrame:
    """The ball near a box, once per identity and debounce gap; with ball states only where the ball changes its way.
    ``tracks`` as of ``possession_series``, ``identities`` as of ``run_samples``; ``raw_track_id`` is the track that touched."""
    found = accepted(touch_candidates(balls, boxes, states, params, tracks, identities))
    return found.drop("ball_conf", "delta_v")

def teammates(a: str, b: str, params: dict = config.KIT, team: float = config.PASS["team"]) -> Column:
    """Same team? Kit colours first (struct ``kit``: l, a, b), then team clusters; null when neither says."""
    d = F.sqrt(sum((F.col(f"{a}.kit.{k}") - F.col(f"{b}.kit.{k}")) ** 2 for k in "lab"))
    sure = (F.col(f"{a}.team_confidence") >= team) & (F.col(f"{b}.team_confidence") >= team)
    return F.when(d <= params["same"], True).when(d >= params["different"], False).when(sure, F.col(f"{a}.team") == F.col(f"{b}.team"))

def detect_passes(runs: DataFrame, tracks: DataFrame, states: DataFrame | None = None, fps: float = 30.0, params: dict = config.PASS) -> DataFrame:
    """``pass_candidates`` without the gap and the teams."""
    return pass_candidates(runs, tracks, states, fps, params).drop("gap", "passer_team", "receiver_team", "same")

def pass_candidates(runs: DataFrame, tracks: DataFrame, states: DataFrame | None = None, fps: float = 30.0, params: dict = config.PASS) -> DataFrame:
    """Passes and turnovers between neighbouring runs, and rejects with their reason: one row a candidate, ``type`` null
    for a reject. One scan holds the passer's debounce: an emitted pass re-arms it, a turnover does not. Without
    ``same_colour_required`` a change to the other team is a pass too; without ``turnovers`` it is a reject."""
    w = Window.partitionBy(*TAKE).orderBy("run_id")
    now = F.struct("run_id", "identity", "t_start", "t_end", "n", "mean_dist", "first", "last", run_quality(fps=fps).alias("quality"))
    pairs = runs.select(*TAKE, now.alias("a"), F.lead(now).over(w).alias("b")).where("b is not null and a.identity <> b.identity")
    rows = pairs.select(*TAKE, "a", "b", F.col("a.t_end").alias("t"))
    rows = contact_evidence(rows, states) if states is not None else rows.withColumn("kicked", F.lit(False))
    kit = F.struct(*[F.col(c) for c in tracks.columns if c not in TAKE])
    for name, of in (("ta", "a.last.track_id"), ("tb", "b.first.track_id")):
        rows = of_tracks(rows, tracks.select(*TAKE, "track_id", kit.alias(name)), name, key=of, keep=True)
    gap = ninth(F.col("b.t_start") - F.col("a.t_end"))
    travel = F.hypot(F.col("b.first.x") - F.col("a.last.x"), F.col("b.first.y") - F.col("a.last.y"))
    same = teammates("ta", "tb", team=params["team"])
    same = same if params["same_colour_required"] else F.when(same.isNotNull(), True)
    rows = rows.withColumns({"gap": gap, "travel": travel, "same": same})
    kicked, length = F.col("kicked"), ninth(F.col("a.t_end") - F.col("a.t_start"))
    early = F.when((gap < 0) | (gap > params["gap"]), "gap").when(~kicked & (length < config.POSSESSION["duration"]), "not_kicked").when(~kicked & (gap < params["flight"]), "flight")
    late = F.when(travel > params["travel_max"], "too_far").when(~kicked & (travel < params["travel_min"]), "too_near").when(F.col("same").isNull(), "team_unknown")
    closeness = F.greatest(F.lit(0.0), 1 - travel / params["travel_max"])
    conf = clamp(closeness * (F.col("a.quality") + F.col("b.quality")) / 2, params)
    off = F.when(~F.col("same") & F.lit(not params["turnovers"]), "turnover_disabled")
    rows = rows.withColumns({"early": early, "late": F.coalesce(late, off, F.when(conf < config.MIN_EMIT, "confidence")), "confidence": conf, "passer": F.col("a.identity"), "receiver": F.col("b.identity"), "passer_track": F.col("a.last.track_id"), "receiver_track": F.col("b.first.track_id"), "t_end": F.col("b.t_start")})
    item = F.struct("t", "t_end", "receiver", "travel", "confidence", "same", "early", "late", "passer_track", "receiver_track", "kicked", "gap", F.col("ta.team").alias("passer_team"), F.col("tb.team").alias("receiver_team"))
    held = rows.groupBy(*TAKE, "passer").agg(F.array_sort(F.collect_list(item)).alias("all"))
    scan = F.expr(
        f"""aggregate(all, named_struct('last', cast(-1e18 as double), 'out', transform(slice(all, 1, 0), r -> struct(r, cast(null as string) as reason))),
            (s, r) -> named_struct(
                'last', if(r.early is null and r.late is null and r.same and rint((r.t - s.last) * 1e9D) / 1e9D >= {params['debounce']}, r.t, s.last),
                'out', concat(s.out, array(struct(r, coalesce(r.early, if(rint((r.t - s.last) * 1e9D) / 1e9D < {params['debounce']}, 'debounce', null), r.late) as reason)))),
            s -> s.out)"""
    )
    out = held.select(*TAKE, "passer", F.explode(scan).alias("o")).select(*TAKE, "passer", "o.r.*", F.col("o.reason").alias("reject"))
    kind = F.when(F.col("reject").isNull(), F.when(F.col("same"), "pass").otherwise("turnover"))
    return out.select(*TAKE, kind.alias("type"), "passer", "receiver", F.col("t").alias("t_start"), "t_end", "travel", "confidence", "reject", "passer_track", "receiver_track", "kicked", "gap", "passer_team", "receiver_team", "same")

def tackle_candidates(runs: DataFrame, boxes: DataFrame, balls: DataFrame, tracks: DataFrame, fps: float = 30.0, params: dict = config.TACKLE) -> DataFrame:
    """Every change from a run of A to one of B, and ``reject``: B wins the ball from A of the other team cluster within
    ``gap`` after closing in on it fast enough over the time looked back on, which the event spans."""
    w = Window.partitionBy(*TAKE).orderBy("run_id")
    now = F.struct("identity", "t_start", "t_end", "first", "last", run_quality(fps=fps).alias("quality"))
    pairs = runs.select(*TAKE, now.alias("a"), F.lead(now).over(w).alias("b")).where("b is not null and a.identity <> b.identity")
    pairs = pairs.select(*TAKE, F.col("a.last.track_id").alias("tackled"), F.col("b.first.track_id").alias("tackler"), F.col("a.identity").alias("loser"), F.col("b.identity").alias("player"), ninth(F.col("b.t_start") - F.col("a.t_end")).alias("gap"), F.col("b.t_start").alias("t_b"), ((F.col("a.quality") + F.col("b.quality")) / 2).alias("quality"))
    for name in ("tackled", "tackler"):
        side = tracks.select(*TAKE, "track_id", F.col("team").alias(f"team_{name}"), F.col("team_confidence").alias(f"sure_{name}"), F.col("t_start").alias(f"born_{name}"))
        pairs = of_tracks(pairs, side, f"team_{name}", f"sure_{name}", f"born_{name}", key=name, keep=True)
    sure = (F.col("sure_tackled") >= params["team"]) & (F.col("sure_tackler") >= params["team"]) & (F.col("team_tackled") != F.col("team_tackler")).isNotNull()
    early = first_reject(
        (~F.col("gap").between(0, params["gap"]), "tackle_gap_too_large"), (~F.coalesce(sure, F.lit(False)), "tackle_team_confidence_too_low"),
        (F.col("team_tackled") == F.col("team_tackler"), "tackle_same_team_not_opponent"), (F.col("born_tackler").isNull(), "tackle_missing_tackler_track"),
    )
    pairs = pairs.select(*TAKE, "tackled", "tackler", "loser", "player", "gap", "t_b", "quality", F.greatest(F.col("t_b") - params["lookback"], F.col("born_tackler")).alias("t0"), early.alias("early"))
    tol = config.POSSESSION["tolerance"]
    pairs = settled(pairs)
    at = pairs.where("early is null").select(*TAKE, F.col("tackler").alias("track_id"), F.explode(F.array("t0", "t_b")).alias("t")).distinct()
    near = near_boxes(at, boxes.select(*TAKE, "track_id", "t", "x1", "y1", "x2", "y2"), tol)
    near = near.select(*TAKE, F.col("track_id").alias("tackler"), "t", F.explode(F.filter("near", lambda b: b["track_id"] == F.col("track_id"))).alias("near"))
    box = near.select(*TAKE, "tackler", "t", cx("near.").alias("x"), cy("near.").alias("y"), height("near.").alias("h"))
    ball = nearest_in_time(at.select(*TAKE, "t").distinct(), balls.select(*TAKE, "t", "x1", "y1", "x2", "y2"), tol).select(*TAKE, "t", cx("near.").alias("bx"), cy("near.").alias("by"))
    places = box.join(ball, [*TAKE, "t"])
    ends = pairs
    for name, when in (("p0", "t0"), ("p1", "t_b")):
        side = places.select(*TAKE, "tackler", F.col("t").alias(when), *[F.col(c).alias(f"{name}{c}") for c in ("x", "y", "h", "bx", "by")])
        ends = ends.join(side, [*TAKE, "tackler", when], "left")
    dist = lambda p: F.hypot(F.col(f"{p}x") - F.col(f"{p}bx"), F.col(f"{p}y") - F.col(f"{p}by"))
    dt = F.col("t_b") - F.col("t0")
    speed = F.when(dt > 0, (dist("p0") - dist("p1")) / dt / ((F.col("p0h") + F.col("p1h")) / 2)).when(dist("p0").isNotNull() & dist("p1").isNotNull(), 0.0)
    out = ends.withColumn("closing_speed", speed)
    conf = clamp(F.col("quality") * F.least(F.lit(1.0), (F.col("closing_speed") - params["speed"]) / 2), params)
    slow = F.col("closing_speed").isNull() | (F.col("closing_speed") < params["speed"])
    reject = F.coalesce("early", first_reject((slow, "tackle_insufficient_closing_speed"), (conf < config.MIN_EMIT, "tackle_below_min_emit_confidence")))
    return out.select(*TAKE, F.lit("tackle").alias("type"), F.col("player").alias("player_track_id"), "tackler", "tackled", F.col("t0").alias("t_start"), F.col("t_b").alias("t_end"), "closing_speed", conf.alias("confidence"), reject.alias("reject"), "loser", "gap")

def detect_tackles(runs: DataFrame, boxes: DataFrame, balls: DataFrame, tracks: DataFrame, fps: float = 30.0, params: dict = config.TACKLE) -> DataFrame:
    return accepted(tackle_candidates(runs, boxes, balls, tracks, fps, params)).drop("loser", "gap")

def without_tackled_turnovers(turnovers: DataFrame, tackles: DataFrame, window: float = config.TACKLE_WINDOW) -> DataFrame:
    """Turnovers that are not the loser's side of a tackle between the same tracks."""
    t = tackles.select(F.col("video_id").alias("v_"), F.col("take_id").alias("k_"), F.col("tackler").alias("by_"), F.col("tackled").alias("of_"), F.col("t_end").alias("e_"))
    same = (F.col("video_id") == F.col("v_")) & (F.col("take_id") == F.col("k_")) & (F.col("receiver_track") == F.col("by_")) & (F.col("passer_track") == F.col("of_"))
    return turnovers.join(t, same & (F.abs(F.col("t_end") - F.col("e_")) <= window), "left_anti")
