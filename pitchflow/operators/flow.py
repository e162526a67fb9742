"""Every automatic event of every take in one go, and what was rejected on the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from . import evidence as told
from .duels import dribble_candidates, save_candidates
from .events import shot_candidates, sprint_candidates
from .possession import pass_candidates, players_near, possession_candidates, possession_series, run_samples, runs_of, tackle_candidates, touch_candidates
from .series import ball_states
from .timejoin import TAKE, apart, settled

#: The reasons that rejected candidates for a pass or turnover are counted under.
PASS_REASONS = {
    "gap": "pass_gap_too_large", "not_kicked": "pass_passer_never_played_ball", "flight": "pass_flight_too_short", "debounce": "pass_debounced",
    "too_far": "pass_ball_travel_too_far", "too_near": "pass_ball_travel_too_short", "team_unknown": "pass_team_confidence_too_low",
    "turnover_disabled": "turnover_disabled",
}
COVERED = "turnover_suppressed_by_tackle"
COLUMNS = (*TAKE, "type", "player_track_id", "t_start", "t_end", "confidence", "evidence", "reject")


#: All types of events.
KINDS = ("sprint", "shot", "touch", "possession", "dribble", "pass", "turnover", "tackle", "save")


def _common(df: DataFrame, kind: str, only: str | None, **fields) -> DataFrame:
    held = {c: F.col(c) if c in df.columns else F.lit(None).cast("bigint") for c in ("player_track_id",)}
    evidence = told.pack(kind, **fields)
    if only == "events":
        df = df.where("reject is null")
    elif only == "rejects":  # what was kept counts only where a tackle may cover a turnover
        df = df if kind in ("turnover", "tackle") else df.where("reject is not null")
        evidence = F.when(F.col("reject").isNull(), evidence)
    out = df.withColumns(held).withColumn("evidence", evidence)
    return out.select(*[F.col(c).cast("double").alias(c) if c in ("t_start", "t_end", "confidence") else F.col(c) for c in COLUMNS])


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    out = apart(parts[0])
    for p in parts[1:]:
        out = out.unionByName(apart(p))
    return out


def candidates(
    balls: DataFrame, boxes: DataFrame, tracks: DataFrame, identities: DataFrame | None, frame_width: float, fps: float = 30.0, kinds: Sequence[str] = KINDS, only: str | None = None
) -> DataFrame:
    """One row for everything that a detector looked at, in every take: type (of the detector), player_track_id, t_start,
    t_end, confidence, evidence, and ``reject``: the first rule that it fails, null for an event. A candidate for a pass is a
    turnover once it is known to be one. ``identities`` as of ``possession.run_samples``. Detectors of types that are not in
    ``kinds`` don't run. With ``only`` "events" or "rejects" the others are left out as early as can be (rejects then have no
    evidence), and the table is made by its first reader and not settled."""
    need = lambda *of: bool({*of} & {*kinds})
    parts, on = {}, ("turnover", "tackle") if need("turnover") else ("tackle",)
    if need("touch", "pass", "turnover"):
        states = settled(ball_states(balls, boxes))
    same = all(config.TOUCH[k] == config.POSSESSION[k] for k in ("conf", "tolerance"))  # then both ask for the same players
    near = settled(players_near(balls, boxes, config.POSSESSION, tracks)) if same and need("touch", "possession", "dribble", "pass", "turnover", "tackle") else None
    if need("possession", "dribble", "pass", "turnover", "tackle"):
        samples = settled(run_samples(possession_series(balls, boxes, tracks=tracks, near=near), identities))
        runs = settled(runs_of(samples))
    if need("sprint"):
        parts["sprint"] = _common(sprint_candidates(boxes, fps), "sprint", only, track_id="player_track_id", peak_speed="peak_speed", mean_speed="mean_speed", mean_detection_confidence="det", n_boxes_in_window="n")
    if need("shot"):
        parts["shot"] = _common(shot_candidates(balls, frame_width), "shot", only, peak_speed="peak_speed", direction_consistency="direction")
    if need("touch"):
        found = touch_candidates(balls, boxes, states, tracks=tracks, identities=identities, near=near)
        parts["touch"] = _common(found, "touch", only, raw_track_id="raw_track_id", distance_px="dist", ball_confidence="ball_conf", ball_velocity_delta="delta_v")
    if need("possession"):
        parts["possession"] = _common(possession_candidates(runs, fps), "possession", only, raw_track_ids="raw_track_ids", n_ball_samples="n", mean_distance_px="mean_dist")
    if need("dribble"):
        parts["dribble"] = _common(dribble_candidates(samples, boxes, tracks, fps), "dribble", only, travel_bbox_heights="travel", contested=F.col("reject").isNull(), raw_track_ids="raw_track_ids")
    if need("pass", "turnover"):
        passes = settled(pass_candidates(runs, tracks, states, fps).withColumn("player_track_id", F.col("passer")))
        named = F.create_map(*[F.lit(x) for kv in PASS_REASONS.items() for x in kv])
        lost = (F.col("type") == "turnover") | F.col("reject").isin("turnover_disabled") | ((F.col("reject") == "confidence") & ~F.col("same"))
        weak = F.when(F.col("reject") == "confidence", F.when(F.col("same"), "pass_below_min_emit_confidence").otherwise("turnover_below_min_emit_confidence"))
        passes = passes.withColumns({"type": F.when(F.coalesce(lost, F.lit(False)), "turnover").otherwise("pass"), "reject": F.coalesce(weak, named[F.col("reject")])})
        ball = {"ball_travel_px": "travel", "gap_s": "gap"}
        parts["pass"] = _common(passes.where("type = 'pass'"), "pass", only, passer_identity="passer", receiver_identity="receiver", passer_raw_track_id="passer_track", receiver_raw_track_id="receiver_track", kick_verified="kicked", **ball)
        parts["turnover"] = _common(
            passes.where("type = 'turnover'"), "turnover", only, losing_identity="passer", receiving_identity="receiver", losing_raw_track_id="passer_track", receiving_raw_track_id="receiver_track",
            losing_team="passer_team", receiving_team="receiver_team", **ball,
        )
    if need("tackle", "turnover"):
        parts["tackle"] = _common(
            tackle_candidates(runs, boxes, balls, tracks, fps), "tackle", only, tackler_identity="player_track_id", tackled_identity="loser", tackler_raw_track_id="tackler", tackled_raw_track_id="tackled",
            closing_speed="closing_speed", gap_s="gap",
        )
    if need("save"):
        parts["save"] = _common(save_candidates(balls, boxes, tracks, frame_width), "save", only, goalkeeper_track_id="player_track_id", peak_speed_before="peak_before", peak_speed_after="peak_after", decelerated="decelerated", reversed_direction="reversed")
    wanted = F.col("type").isin(*kinds)
    if only is None:
        every, rest = settled(_together(list(parts.values()))), None
    else:  # turnovers and tackles alone are read more than once
        every = settled(_together([parts[k] for k in on])) if need(*on) else None
        rest = [df.where("reject is not null") if only == "rejects" else df for k, df in parts.items() if k not in on and k in kinds]
        if every is None:
            return _together(rest)
    found = told.turnovers_without_tackles(every.where("reject is null"), config.TACKLE_WINDOW)
    found = found.withColumn("reject", F.when(F.col("covered"), COVERED)).drop("covered")
    judged = [df.where(wanted) for df in (found, every.where("reject is not null"))]
    judged = [df.where(f"reject is {'not ' if only == 'rejects' else ''}null") if only else df for df in judged]
    if only is None:
        return judged[0].unionByName(judged[1])
    return _together([*rest, judged[0], judged[1]] if only == "rejects" else [*rest, judged[0]])


def events_of(every: DataFrame) -> DataFrame:
    """The events among ``candidates``, with ``acting_ids``: the tracks that did them, by their evidence."""
    out = every.where("reject is null").drop("reject")
    return out.withColumn("acting_ids", told.acting_ids(out))


def rejects_of(every: DataFrame) -> DataFrame:
    """(stage, reason, n) of what was rejected; the stage is the type that the detector looks for."""
    return every.where("reject is not null").groupBy(F.substring_index("reject", "_", 1).alias("stage"), F.col("reject").alias("reason")).agg(F.count("*").alias("n"))


def take_events(balls: DataFrame, boxes: DataFrame, tracks: DataFrame, identities: DataFrame | None, frame_width: float, fps: float = 30.0, kinds: Sequence[str] = KINDS) -> DataFrame:
    """The events of all detectors, or of those of ``kinds``, with ``evidence`` and ``acting_ids``; turnovers that a tackle
    covers are left out. ``identities`` as of ``possession.run_samples``."""
    return events_of(candidates(balls, boxes, tracks, identities, frame_width, fps, kinds, "events"))


def take_rejects(balls: DataFrame, boxes: DataFrame, tracks: DataFrame, identities: DataFrame | None, frame_width: float, fps: float = 30.0) -> DataFrame:
    """``rejects_of`` all detectors."""
    return rejects_of(candidates(balls, boxes, tracks, identities, frame_width, fps, only="rejects"))
